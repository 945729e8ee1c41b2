"""Connected components of a link table, by alternating large-star and small-star rounds, and joins with hot keys.

Every round is two aggregates with map-side combine and two joins.  Nodes with many links are joined by a broadcast
whose size is bounded by the count of links, so that no task gets more than a ten-thousandth of them for one node;
nothing is collected but one pair of numbers a round.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import cut

#: Keys that are broadcast at most.
HOT_KEYS = 10_000
#: Rows of one key that a task may take at any rate.
FEW_ROWS = 200


def many_rows(total: int) -> int:
    """More rows than this of one key make it hot: HOT_KEYS keys at most, whatever the rows."""
    return max(FEW_ROWS, math.ceil(total / HOT_KEYS))


def hot_join(rows: DataFrame, sums: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with sums, which has one row a key and in ``n`` how many of the ``total`` rows have it.

    Keys of more than ``many_rows`` are broadcast; the others meet by a shuffle.
    Inner or left; null keys find nothing.
    """
    many = many_rows(total)
    more = [c for c in sums.columns if c not in (key, n)]
    packed = F.struct(*[F.col(c) for c in more])
    hot = F.broadcast(sums.filter(F.col(n) > many).select(key, packed.alias("_hot")))
    cold = sums.filter(F.col(n) <= many).select(key, packed.alias("_cold"))
    tagged = rows.join(hot, key, "left")
    show = lambda df, c: df.select(*[F.col(x) for x in rows.columns], *[F.col(f"{c}.{x}").alias(x) for x in more])
    out = show(tagged.filter("_hot is not null"), "_hot")
    rest = tagged.filter(F.col("_hot").isNull() & F.col(key).isNotNull())
    out = out.unionByName(show(rest.join(cold, key, how), "_cold"))
    if how == "left":
        out = out.unionByName(show(tagged.filter(F.col(key).isNull()), "_hot"))
    return out


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of links; component is the smallest node reached.

    Null ends and self links are ignored; repeated links count once; no links give no rows.  Rounds grow with the
    logarithm of the links; where ``max_rounds`` aren't enough this raises rather than answer with what it has.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    seen, n = None, edges.count()
    for _ in range(max_rounds if n else 0):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = hot_join(both, least, "u", "n", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # read five times below: without a cut a round's plan, and the text that the driver keeps of it, is thrice as long
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = hot_join(large, least, "u", "n", 2 * n)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        edges = cut(small.filter("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, n = now, now[0]
    else:
        if n:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
