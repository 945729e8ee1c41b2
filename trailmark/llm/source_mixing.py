"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source with the share p of all tokens gets the weight ``p ** t / sum(p ** t)``.  The exponent t in [0, 1] is
bisected: the largest that reaches ``target_entropy`` (as a part of the entropy of equal weights), or the smallest
that keeps every source within ``repeat_limit`` passes; with both, the limit wins.  Each round sends the driver a few
sums for 33 exponents at once, whatever the number of sources.

The token budget is ``budget``, or, where none is given, the least with which every source is passed at least once,
so that nothing is lost.  A source is then passed ``budget * weight / tokens`` times.  Its texts lie in blocks by a
hash of id and row; each pass has its own permutation of the blocks, and the last, partial pass ends inside a block:
texts follow there in the order of a hash while less than the pass has been drawn before them, so a source is drawn
over its budget by less than one text.  No sort or window sees more than the blocks of one source (BLOCKS at most)
or the texts of one block, even where one source, or one id, holds a third of all rows.

A row is told from its copies by its place in docs, so rows must come in the same order each time, as they do from
files; if they didn't, a partial pass would end at another text.

Defined cases: a null source is a source of its own; null texts and texts without words count as one token, and a
text of any length is drawn whole; rows that repeat or lack an id are drawn one by one; sources of one size get one
weight; an empty table gives no rows; other columns of docs pass through if asked for in ``keep``, whatever their
names, unless named like a column of the result.  Tokens are words outside 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._chunks import cut

#: Blocks of a source at most, and tokens of a block otherwise, if not said otherwise.
BLOCKS, BLOCK_TOKENS = 1 << 16, 250_000
_STEPS = 33


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).cast("long")


def _figures(sources: DataFrame, exponents: list[float], most: float, budget: float | None) -> list[tuple[float, float, float, float]]:
    """For each exponent: itself, entropy, most passes of a source, budget."""
    x = F.log("tokens") - F.lit(math.log(most))
    sums = []
    for i, t in enumerate(exponents):
        w = F.exp(x * F.lit(t))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * x).alias(f"s{i}"), F.max(w / F.col("tokens")).alias(f"m{i}"), F.max(F.col("tokens") / w).alias(f"b{i}")]
    row = sources.agg(*sums).first()
    out = []
    for i, t in enumerate(exponents):
        z, s = row[f"z{i}"], row[f"s{i}"]
        total = budget if budget is not None else row[f"b{i}"] * z
        out.append((t, math.log(z) - t * s / z, total * row[f"m{i}"] / z, total))
    return out


def exponent(sources: DataFrame, budget: float | None = None, target_entropy: float | None = None, repeat_limit: float | None = None) -> tuple[float, float]:
    """(exponent, budget) for a table of sources and tokens."""
    most, n = sources.agg(F.max("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 0.0

    def last(ok, lo: float = 0.0, hi: float = 1.0) -> float:
        """The largest exponent for which ok holds, if it holds up to there."""
        for _ in range(6):
            ts = [lo + (hi - lo) * i / (_STEPS - 1) for i in range(_STEPS)]
            good = [ok(f) for f in _figures(sources, ts, most, budget)]
            k = good.index(False) if False in good else _STEPS
            if k in (0, _STEPS):
                return ts[0] if k == 0 else ts[-1]
            lo, hi = ts[k - 1], ts[k]
        return lo

    def first(ok) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(6):
            ts = [lo + (hi - lo) * i / (_STEPS - 1) for i in range(_STEPS)]
            good = [ok(f) for f in _figures(sources, ts, most, budget)]
            k = good.index(True) if True in good else _STEPS - 1
            if k == 0 or True not in good:
                return ts[k]
            lo, hi = ts[k - 1], ts[k]
        return hi

    t = 1.0
    if target_entropy is not None:
        t = last(lambda f: f[1] >= target_entropy * math.log(n))
    if repeat_limit is not None:
        least = first(lambda f: f[2] <= repeat_limit * (1 + 1e-9))
        t = max(t, least) if target_entropy is not None else least
    return t, _figures(sources, [t], most, budget)[0][3]


def plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, budget: float | None, target_entropy: float | None, repeat_limit: float | None, seed: int, block_tokens: int) -> DataFrame:
    """Blocks of each source and pass: their tokens, those before them and the room of the pass, the place, and, where
    the pass ends inside, the cut: the last hash that is drawn."""
    texts = cut(_rows(docs, id_col, source_col, token_count(F.col(text_col)).alias("n")))
    sources = cut(texts.groupBy("_source").agg(F.sum("n").alias("tokens")))
    t, total = exponent(sources, budget, target_entropy, repeat_limit)
    z = sources.agg(F.sum(F.pow("tokens", F.lit(t)))).first()[0] or 1.0
    weight = F.pow("tokens", F.lit(t)) / F.lit(z)
    sources = sources.withColumn("weight", weight).withColumn("passes", F.col("weight") * F.lit(total) / F.col("tokens"))
    # a hair below a whole number of passes is that number
    sources = sources.withColumn("passes", F.when(F.abs(F.col("passes") - F.round("passes")) < 1e-6, F.round("passes")).otherwise(F.col("passes")))
    sources = cut(sources.withColumn("blocks", F.least(F.lit(BLOCKS), F.ceil(F.col("tokens") / block_tokens)).cast("int")))
    placed = texts.join(_small(sources.select("_source", "blocks")), "_source").withColumn("block", _block(seed))
    sizes = placed.groupBy("_source", "block").agg(F.sum("n").alias("n"))
    blocks = sizes.join(_small(sources), "_source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), (F.ceil("passes") - 1).cast("int")))))
    order = Window.partitionBy("_source", "epoch").orderBy(F.xxhash64("block", "epoch", F.lit(seed)), "block")
    blocks = blocks.withColumn("place", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = cut(blocks.withColumn("room", (F.col("passes") - F.col("epoch")) * F.col("tokens") - F.col("before")).filter("room > 0"))
    last = blocks.filter("room < n").select("_source", "block", "epoch", "room")
    inside = placed.join(_small(last), ["_source", "block"]).withColumn("key", _key(seed))
    run = Window.partitionBy("_source", "epoch").orderBy("key", "_row").rowsBetween(Window.unboundedPreceding, -1)
    cuts = inside.withColumn("drawn", F.coalesce(F.sum("n").over(run), F.lit(0))).filter("drawn < room").groupBy("_source", "block", "epoch").agg(F.max("key").alias("cut"))
    return blocks.join(cuts, ["_source", "block", "epoch"], "left")


def _small(rows: DataFrame) -> DataFrame:
    """rows to join with, broadcast if they are few enough: counted, not guessed; else the join shuffles."""
    return F.broadcast(rows) if rows.count() <= 50_000 else rows


def _rows(docs: DataFrame, id_col: str, source_col: str, *more: Column) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("\u0000"))
    return docs.select(F.col(id_col).alias("_id"), source.alias("_source"), F.monotonically_increasing_id().alias("_row"), *more)


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64("_id", "_row", F.lit(seed)), F.col("blocks")).cast("int")


def _key(seed: int) -> Column:
    return F.xxhash64("_id", "_row", "epoch", F.lit(seed + 1))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: float | None = None, target_entropy: float | None = None, repeat_limit: float | None = 2.0, seed: int = 17, keep: tuple[str, ...] | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each draw: doc_id, source, epoch (the pass it belongs to), block, weight (of the source) and
    position (0 to 1, the order in which all sources mix), then the columns in ``keep``."""
    if (repeat_limit is not None and repeat_limit < 1 and budget is None) or (target_entropy is not None and not 0 <= target_entropy <= 1) or block_tokens < 1:
        raise ValueError("repeat_limit and block_tokens must be 1 at least, and target_entropy from 0 to 1")
    blocks = plan(docs, id_col, text_col, source_col, budget, target_entropy, repeat_limit, seed, block_tokens)
    counts = _small(blocks.select("_source", "blocks").distinct())
    held = _rows(docs, id_col, source_col, F.col(source_col).alias("source"), *([F.struct(*[F.col(c) for c in keep]).alias("_keep")] if keep else []))
    drawn = held.join(counts, "_source").withColumn("block", _block(seed)).join(_small(blocks.drop("blocks")), ["_source", "block"])
    drawn = drawn.withColumn("key", _key(seed)).filter("room >= n or key <= cut")
    low = F.lit(-(2.0**63))
    inner = (F.col("key") - low) / (F.coalesce("cut", F.lit(2.0**63)) - low + 1.0)
    upto = F.col("before") + F.least(F.lit(1.0), inner) * F.least("room", "n")
    drawn = drawn.withColumn("position", F.least(F.lit(1.0), (F.col("epoch") + upto / F.col("tokens")) / F.col("passes")))
    return drawn.select(F.col("_id").alias("doc_id"), "source", "epoch", "block", "weight", "position", *([F.col("_keep")[c].alias(c) for c in keep] if keep else []))
