"""Prompt text for reranking, generators, and the reading of their answers, all as columns."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PromptConfig
from ..functions.text import safe_text

# The sentences of the evidence block and the prompts.
EXPLORATION = (
    "The observed prefix does not clearly indicate whether the user is repeating stops or exploring new ones.",
    "The observed prefix is mostly exploratory, with little repetition so far.",
    "The observed prefix is moderately exploratory, with some repetition but mostly new stops.",
    "The observed prefix shows noticeable repetition, suggesting a more routine or backtracking pattern.",
)
DENSITY = ("a very dense urban zone", "a moderately dense urban zone", "a relatively sparse local area")
CONNECTIVITY = ("with high local street connectivity", "with moderate local street connectivity", "with limited local street connectivity")
NO_AREA = "The local spatial context of the current stop is not strongly characterized by the available density/connectivity features."
NO_MOVEMENT = "No prior movement is available because the current prefix contains only one observed stop."
MOVEMENT = (
    "The most recent transition was compact and local.",
    "The most recent transition was moderate in both distance and time.",
    "The most recent transition covered a relatively long distance in a limited amount of time.",
    "The most recent transition suggests a longer move or a slower-paced gap between stops.",
)
NO_STOPS = "No observed stops are available."
NO_CASES = "- No closely matched historical decision states were retrieved."
NO_CANDIDATES = "No candidate next POIs were retrieved from historical decision states."
SYSTEM_PROMPT = """You are a next-POI reranking assistant for urban mobility recommendation.

Your task is to rank the provided candidate POIs for the user's next stop.

Rules:
1. You must rank ONLY the provided candidate POIs.
2. Use the evidence block and retrieved-support signals as grounded evidence.
3. Prefer candidates that are coherent with:
   - the observed itinerary so far
   - the current time context
   - recent movement pattern
   - local spatial context
   - retrieved historical decision-state evidence
4. Do NOT invent facts such as budget, mood, or preferences unless directly supported by the evidence.
5. If two candidates are close, prefer the one with stronger retrieved historical support.
6. Return valid JSON only.

Return JSON with this schema:
{
  "selected_poi_id": "<best candidate POI id>",
  "ranking": [
    {
      "rank": 1,
      "poi_id": "<candidate POI id>",
      "justification": "<short grounded explanation>"
    }
  ],
  "summary_reason": "<1-2 sentence overall explanation>"
}

Return exactly the top %d ranked candidates in the ranking list.
"""


def fixed(value, digits: int) -> Column:
    """A number with so many decimals, rounded half to even."""
    return F.format_string(f"%.{digits}f", F.bround(value, digits))


def exploration_text(ratio: Column) -> Column:
    return F.when(ratio.isNull(), EXPLORATION[0]).when(ratio <= 0.10, EXPLORATION[1]).when(ratio <= 0.30, EXPLORATION[2]).otherwise(EXPLORATION[3])


def area_text(density: Column, degree: Column) -> Column:
    zone = F.when(density >= 100, DENSITY[0]).when(density >= 30, DENSITY[1]).when(density.isNotNull(), DENSITY[2])
    streets = F.when(degree >= 4, CONNECTIVITY[0]).when(degree >= 2, CONNECTIVITY[1]).when(degree.isNotNull(), CONNECTIVITY[2])
    return (
        F.when(zone.isNotNull() & streets.isNotNull(), F.concat(F.lit("The current stop is located in "), zone, F.lit(" "), streets, F.lit(".")))
        .when(zone.isNotNull(), F.concat(F.lit("The current stop is located in "), zone, F.lit(".")))
        .when(streets.isNotNull(), F.concat(F.lit("The current stop is located in an area "), streets, F.lit(".")))
        .otherwise(NO_AREA)
    )


def movement_text(metres: Column, gap_s: Column, distance_bin: Column, gap_bin: Column, direction: Column) -> Column:
    pace = metres / F.greatest(gap_s / 60.0, F.lit(1e-6))
    kind = F.when((metres < 250) & (gap_s < 1800), MOVEMENT[0]).when((metres < 1000) & (gap_s < 3600), MOVEMENT[1]).when((metres >= 1000) & (gap_s < 3600), MOVEMENT[2]).otherwise(MOVEMENT[3])
    turn = F.when(direction.isNotNull() & ~direction.isin("unknown", "BOS"), F.concat(F.lit(" Its dominant direction bin was "), direction, F.lit("."))).otherwise("")
    known = F.concat(kind, turn, F.lit(" Approximate recent movement pace was "), fixed(pace, 1), F.lit(" meters per minute."))
    bins = F.concat(F.lit("The most recent transition was in distance bin "), safe_text(distance_bin), F.lit(" with time-gap bin "), safe_text(gap_bin), F.lit("."))
    return F.when(metres.isNull() | gap_s.isNull(), F.when(distance_bin == "BOS", NO_MOVEMENT).otherwise(bins)).otherwise(known)


def time_text(time_bin: Column, elapsed_min: Column) -> Column:
    part = F.concat(F.lit("The current decision point occurs during the "), F.coalesce(time_bin, F.lit("unknown part of day")))
    return F.when(elapsed_min.isNull(), F.concat(part, F.lit("."))).otherwise(F.concat(part, F.lit(", after about "), fixed(elapsed_min / 60.0, 1), F.lit(" hours of observed activity in the current prefix.")))


def summary_text(caption: Column | None = None) -> Column:
    """Summary of a state with the columns of a decision state."""
    c = F.col
    parts = [time_text(c("current_time_bin"), c("prefix_elapsed_min")), movement_text(c("prev1_distance_m"), c("prev1_gap_s"), c("prev1_distance_bin"), c("prev1_gap_bin"), c("prev1_direction_bin")), exploration_text(c("prefix_repeat_ratio")), area_text(c("curr_density_count"), c("curr_node_degree"))]
    if caption is not None:
        parts.insert(0, F.concat(F.lit("The routed behavioral prototype suggests the following broad mobility pattern: "), caption))
    return F.concat_ws(" ", *parts)


def _numbered(rows: DataFrame, key: str, order: list[Column], limit: int, latest: bool = False) -> DataFrame:
    """The first (or last) limit rows of each key with ``_at`` from 1 in ascending order."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = rows.withColumn("_at", F.row_number().over(w))
    if not latest:
        return rows.filter(F.col("_at") <= limit)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).filter(F.col("_at") > F.col("_n") - limit).withColumn("_at", F.col("_at") - F.greatest(F.lit(0), F.col("_n") - limit)).drop("_n")


def _lines(rows: DataFrame, key: str, line: Column, out: str) -> DataFrame:
    return rows.withColumn("_line", line).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_line"))), lambda s: s["_line"]), "\n").alias(out))


def evidence(states: DataFrame, stops: DataFrame, cases: DataFrame, found: DataFrame, meta: DataFrame, cfg: PromptConfig = PromptConfig()) -> DataFrame:
    """(query, evidence): the four-part evidence block of each state.

    states has query and a decision state's columns; stops query, Time, PId, Category; cases and found are the tables
    of retrieve and candidates; meta has poi, name, category, address (one row a place)."""
    meta = meta.dropDuplicates(["poi"])
    of = lambda rows, col: rows.join(meta.select(F.col("poi").alias(col), F.col("name").alias("_name"), F.col("category").alias("_category"), F.col("address").alias("_address"), F.lit(True).alias("_known")), col, "left")
    w = of(_numbered(stops, "query", [F.col("Time"), F.col("PId")], cfg.recent_stops, latest=True), "PId")
    name = F.when(F.col("_known"), safe_text("_name")).otherwise(safe_text("PId"))
    category = F.when(F.col("_known"), safe_text("_category")).otherwise(safe_text("Category"))
    address = F.when(F.col("_known"), safe_text("_address")).otherwise("unknown address")
    when = F.coalesce(F.date_format("Time", "MMM dd HH:mm"), F.lit("unknown time"))
    itinerary = _lines(w, "query", F.concat(F.lit("Stop "), F.col("_at"), F.lit(": "), name, F.lit(", a "), category, F.lit(", at "), address, F.lit(" ("), when, F.lit(")")), "_itinerary")
    c = of(_numbered(cases, "query", [F.col("rank")], cfg.evidence_cases), "next_POIId")
    to = F.when(F.col("_known"), F.concat(safe_text("_name"), F.lit(" ("), safe_text("_category"), F.lit(") at "), safe_text("_address"))).otherwise(F.concat(F.lit("POI "), safe_text("next_POIId", "None")))
    history = _lines(c, "query", F.concat(F.lit("- A closely matched historical decision state continued to "), to, F.lit(" with retrieval score "), fixed(F.col("retrieval_score"), 4), F.lit(".")), "_history")
    p = of(_numbered(found, "query", [F.col("candidate_rank")], cfg.max_candidates), "next_POIId")
    line = F.concat(F.col("_at"), F.lit(". "), safe_text("_name"), F.lit(" ("), safe_text("_category"), F.lit(") — estimated support probability "), fixed(F.col("candidate_prob"), 3), F.lit(", supported by "), F.col("support_case_count"), F.lit(" retrieved cases."))
    support = _lines(p, "query", line, "_support")
    out = states.withColumn("_summary", summary_text()).join(itinerary, "query", "left").join(history, "query", "left").join(support, "query", "left")
    text = F.concat(F.lit("Current mobility summary:\n"), "_summary", F.lit("\n\nObserved itinerary so far:\n"), F.coalesce("_itinerary", F.lit(NO_STOPS)), F.lit("\n\nHistorical decision-state evidence:\n"), F.coalesce("_history", F.lit(NO_CASES)), F.lit("\n\nCandidate next POIs inferred from retrieved historical cases:\n"), F.coalesce("_support", F.lit(NO_CANDIDATES)))
    return out.select("query", F.trim(text).alias("evidence"))


def prompts(blocks: DataFrame, found: DataFrame, meta: DataFrame, cfg: PromptConfig = PromptConfig()) -> DataFrame:
    """(query, system_prompt, user_prompt, fallback_ids): the candidate list after the evidence block."""
    meta = meta.dropDuplicates(["poi"]).select(F.col("poi").alias("next_POIId"), "name", "category", "address", F.lit(True).alias("_known"))
    rows = _numbered(found, "query", [F.col("candidate_rank")], cfg.max_candidates).join(meta, "next_POIId", "left")
    name = F.when(F.col("_known"), safe_text("name")).otherwise(safe_text("next_POIId"))
    category = F.when(F.col("_known"), safe_text("category")).otherwise(safe_text("next_category"))
    address = F.when(F.col("_known"), safe_text("address")).otherwise("unknown address")
    parts = [F.concat(F.lit("Candidate "), F.col("_at")), F.concat(F.lit("POI_ID="), "next_POIId"), F.concat(F.lit("Name="), name), F.concat(F.lit("Category="), category), F.concat(F.lit("Address="), address)]
    parts += [F.concat(F.lit("RetrievedSupportProb="), fixed(F.col("candidate_prob"), 4)), F.concat(F.lit("RetrievedSupportCases="), F.col("support_case_count"))]
    listed = _lines(rows, "query", F.concat_ws(" | ", *parts), "_list")
    ids = found.groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("candidate_rank", "next_POIId"))), lambda s: s["next_POIId"]).alias("fallback_ids"))
    out = blocks.join(listed, "query", "left").join(ids, "query", "left")
    user = F.concat(F.lit("Evidence block:\n"), "evidence", F.lit("\n\nCandidate next POIs:\n"), F.coalesce("_list", F.lit("")), F.lit("\n\nPlease rank the candidates and select the best next POI.\n"))
    return out.select("query", F.lit(SYSTEM_PROMPT % cfg.top_k_return).alias("system_prompt"), user.alias("user_prompt"), F.coalesce("fallback_ids", F.array().cast("array<string>")).alias("fallback_ids"))


class Generator(Protocol):
    """Answers to a batch of (system, user) prompts."""

    def __call__(self, prompts: list[tuple[str, str]]) -> Iterable[str]: ...


def stub_generator(prompts: list[tuple[str, str]]) -> list[str]:
    """The same empty choice each time: the first candidate is then taken."""
    return [json.dumps({"selected_poi_id": "", "ranking": [], "summary_reason": "stub"}) for _ in prompts]


def http_generator(url: str, model: str, temperature: float = 0.2, max_tokens: int = 1024, key: str | None = None) -> Generator:
    """Chat completions over HTTP, one request a prompt, asking for a JSON object."""

    def call(prompts: list[tuple[str, str]]) -> Iterable[str]:
        import urllib.request

        for system, user in prompts:
            body = {"model": model, "temperature": temperature, "max_tokens": max_tokens, "response_format": {"type": "json_object"}, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}]}
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})})
            with urllib.request.urlopen(request, timeout=120) as answer:  # noqa: S310
                yield json.load(answer)["choices"][0]["message"]["content"]

    return call


def engine_generator(load: Callable[[], Callable[[list[str]], list[str]]]) -> Generator:
    """An in-process engine, loaded once a worker; it gets whole batches of rendered prompts."""
    engine: list = []

    def call(prompts: list[tuple[str, str]]) -> list[str]:
        if not engine:
            engine.append(load())
        return engine[0]([f"{s}\n\n{u}" for s, u in prompts])

    return call


def generate(rows: DataFrame, generator: Generator) -> DataFrame:
    """rows with llm_raw_text, or error where a batch failed; batches come as Arrow."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", llm_raw_text string, error string"

    def run(batches):
        for batch in batches:
            asked = list(zip(batch.column("system_prompt").to_pylist(), batch.column("user_prompt").to_pylist(), strict=True))
            try:
                texts, errors = list(generator(asked)), [None] * len(asked)
            except Exception as e:  # noqa: BLE001  one failed batch is data, not the end of the run
                texts, errors = [None] * len(asked), [f"{type(e).__name__}: {e}"] * len(asked)
            t = pa.Table.from_batches([batch])
            yield from t.append_column("llm_raw_text", pa.array(texts, pa.string())).append_column("error", pa.array(errors, pa.string())).to_batches()

    return rows.mapInArrow(run, ddl)


def unfenced(text: Column) -> Column:
    """The inside of a fenced block, or the whole text."""
    inside = F.regexp_extract(text, r"(?i)```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.trim(F.when(text.rlike(r"(?i)```(?:json)?\s*([\s\S]*?)\s*```"), inside).otherwise(text))


def read_answers(rows: DataFrame, text: str = "llm_raw_text", ids: str = "fallback_ids") -> DataFrame:
    """rows with selected_poi_id and parse_error.

    The chosen id, or the first of the ranking, is matched to the candidates as text without outer spaces or as a
    whole number; else, and for texts that are no JSON object, the first candidate is taken (with parse_error set)."""
    body = unfenced(F.coalesce(text, F.lit("")))
    parsed = F.from_json(body, "selected_poi_id string, ranking array<struct<poi_id string>>, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = rows.withColumn("_json", parsed).withColumn("_object", body.startswith("{") & F.col("_json").isNotNull() & F.col("_json._bad").isNull())
    chosen = F.when(F.trim(F.coalesce("_json.selected_poi_id", F.lit(""))) != "", F.col("_json.selected_poi_id")).otherwise(F.get(F.col("_json.ranking"), F.lit(0))["poi_id"])
    same = lambda c, x: (F.trim(c) == F.trim(x)) | F.coalesce(F.trim(c).try_cast("long") == F.trim(x).try_cast("long"), F.lit(False))
    rows = rows.withColumn("_chosen", F.when(F.col("_object"), chosen))
    match = F.get(F.filter(F.col(ids), lambda x: same(F.col("_chosen"), x)), F.lit(0))
    error = F.when(~F.col("_object"), "not a JSON object").when(F.size(ids) == 0, "no candidates")
    return rows.withColumn("selected_poi_id", F.coalesce(match, F.get(F.col(ids), F.lit(0)))).withColumn("parse_error", error).drop("_json", "_object", "_chosen")


def hit_at_1(predictions: DataFrame) -> DataFrame:
    """One row: predictions counted (neither skipped nor failed) and the share that was right."""
    used = predictions.filter(~F.coalesce("skipped", F.lit(False)) & F.col("error").isNull())
    return used.agg(F.count(F.lit(1)).alias("evaluated"), F.avg(F.col("is_correct_at_1").cast("double")).alias("hit_at_1"))
