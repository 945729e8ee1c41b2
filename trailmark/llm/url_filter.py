"""URL filter: host and path rules, and trust spread over the link graph for the rest.

Rules judge a page first: a rule fits its host and all subdomains where the path starts with its path, and the
longest fitting rule wins.  Pages without a rule are judged by their host.  Host edges come from absolute links in
the pages; hosts of allowed pages are trusted seeds and hosts of blocked pages distrusted seeds, weighted by the
share of their pages so judged.  Trust follows the edges and distrust the reversed edges, each as a personalised
PageRank, run until less than ``tolerance`` of a seed is still to come.  Both are in units of a seed.  A host with seeds of its
own is blocked if its distrust exceeds its trust by ``margin``; of another host, whose share of the distrust of a
blocked host falls with the number of hosts that link to that, the two are compared with each other.

The graph stays in Spark: one row for each pair of hosts, aggregated map-side, with lineage cut every few rounds.  Hosts
with many links or pages are joined by a broadcast of bounded size (``hot_join``).

Defined cases: url null or without ``://``: host and path empty, no rule, allowed; null html has no links; links of
a host to itself count for nothing; an html of any length is searched whole; pages that repeat count each; of rules
of one length the one last in order wins, and a rule that is given twice with both verdicts blocks; an empty table
gives no rows; other columns of pages are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import cut
from .components import hot_join, many_rows

#: Rules that are laid out as one expression; more of them, or a table of them, are joined.
FEW_RULES = 1000
#: Rounds of the propagation between two cuts of the lineage.
ROUNDS = 6

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (verdict, host/path) that fits, as a string, else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(html, F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank (host, score, in units of a seed) from seeds (host, seed) along edges (src, dst, n).

    Scores only grow from round to round, by damping times what they grew before at most: the rounds end when all that
    is still to come is below the tolerance, and grow with the logarithm of the seeds over it."""
    out = edges.groupBy("src").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("links"))
    total, most = out.agg(F.coalesce(F.sum("links"), F.lit(0)), F.coalesce(F.max("links"), F.lit(0))).first()
    seeds = cut(seeds.select("host", F.col("seed").alias("score")))
    if not total:
        return seeds
    out = cut(out)
    edges = cut(hot_join(edges, out, "src", "links", total).select(F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("part")))
    links = out.select(F.col("src").alias("host"), "links")
    even = most <= many_rows(total)  # then no host needs a broadcast, and rounds can be planned together
    rank, size = seeds, 0.0
    while True:
        for _ in range(ROUNDS if even else 1):
            met = edges.join(rank, "host") if even else hot_join(edges, rank.join(links, "host"), "host", "links", total)
            moved = met.select(F.col("dst").alias("host"), (damping * F.col("score") * F.col("part")).alias("score"))
            rank = moved.unionByName(seeds).groupBy("host").agg(F.sum("score").alias("score"))
        rank = cut(rank)
        before, size = size, rank.agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
        if (size - before) * damping / (1 - damping) < tolerance:
            return rank


def rules_of(spark: SparkSession, rules: list[tuple[str, str]] | DataFrame) -> list[tuple[str, str]] | DataFrame:
    """Rules without repeats: a list of a few, or a table of (verdict, rule)."""
    if isinstance(rules, DataFrame):
        # "block" is after "allow" in order
        return rules.filter("rule is not null").groupBy("rule").agg(F.max("verdict").alias("verdict"))
    known: dict[str, str] = {}
    for verdict, rule in rules:
        known[rule] = max(verdict, known.get(rule, verdict))
    few = [(v, r) for r, v in known.items()]
    return few if len(few) <= FEW_RULES else spark.createDataFrame(few, "verdict string, rule string")


def _by_table(judged: DataFrame, rules: DataFrame) -> DataFrame:
    """judged with rule and ruled from a table: the rules of each host are found by its suffixes, then those of a page
    by its path."""
    at = F.locate("/", "rule")
    table = rules.select(F.substring_index("rule", "/", 1).alias("suffix"), F.struct(F.length("rule").alias("size"), "rule", F.when(at > 0, F.expr("substring(rule, locate('/', rule))")).otherwise("").alias("start"), "verdict").alias("r"))
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(ends).alias("suffix")).join(table, "suffix").groupBy("host").agg(F.sort_array(F.collect_list("r"), asc=False).alias("fitting"))
    met = hot_join(judged, hosts.join(found, "host", "left"), "host", "n", judged.count())
    best = F.get(F.filter("fitting", lambda r: F.col("path").startswith(r["start"])), F.lit(0))
    return met.withColumn("rule", best["rule"]).withColumn("ruled", best["verdict"]).drop("fitting")


def url_filter(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, margin: float = 0.5, tolerance: float = 1e-4) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null without one), verdict (allow or block), trust and
    distrust of the host (in units of a seed).  ``rules`` are pairs (verdict, host/path) or a table of them."""
    rules = rules_of(pages.sparkSession, rules)
    judged = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if isinstance(rules, DataFrame):
        judged = _by_table(judged, rules)
    else:
        judged = judged.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        ruled = F.lit(None).cast("string")
        for verdict, rule in rules:
            ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
        judged = judged.withColumn("ruled", ruled)
    share = lambda v: F.avg(F.coalesce((F.col("ruled") == v).cast("int"), F.lit(0)))
    hosts = cut(judged.groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad"), F.count(F.lit(1)).alias("n")))
    edges = cut(host_edges(pages, host_of(F.col(url_col)), F.col(html_col)))
    named = hosts.filter("host <> ''")
    trust = spread(edges, named.filter("good > 0").select("host", F.col("good").alias("seed")), damping, tolerance).withColumnRenamed("score", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = spread(back, named.filter("bad > 0").select("host", F.col("bad").alias("seed")), damping, tolerance).withColumnRenamed("score", "distrust")
    scores = hosts.join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bar = F.when(F.col("good") + F.col("bad") > 0, F.lit(margin)).otherwise(F.lit(10 * tolerance))
    scores = cut(scores.select("host", "n", "trust", "distrust", F.when(F.col("distrust") - F.col("trust") > bar, "block").otherwise("allow").alias("_host")))
    total = scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = hot_join(judged, scores, "host", "n", total)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "_host").alias("verdict"), "trust", "distrust")
