"""Vector search: exact top-k by norm-sorted inner products, and a permutation index.

Both keep vectors in blocks of bounded size, as packed matrices, and meet queries and blocks by an equi-join key: a
group holds one block and one band of queries, so a task's memory doesn't depend on the table.

Vectors that are null, hold nulls or non-finite components, have a null id or another length than most rows take no
part.  Rows that repeat an id are one query together, asked with the first of their vectors in the order of its
components, and none of them is a candidate of that query; as candidates of other queries each of them counts.  Ties
go to the smaller id.  An empty table gives no rows.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a block, and queries of a band.
BLOCK, BAND = 8192, 2048
#: Rows that a rotation or pivots are fitted on at most.
SAMPLE = 8192
#: Longest vectors, whose scores a search starts from.
SEEDS = 1024


def usable(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(rows with id and v as doubles, dimension)."""
    v = F.col(vector_col).cast("array<double>")
    found = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    found = found.filter(F.size("v") > 0).filter(F.expr("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"))
    dims = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (found.filter(F.size("v") == dims.d), int(dims.d)) if dims else (found, 0)


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _sample(found: DataFrame, size: int = SAMPLE) -> np.ndarray:
    """The vectors whose ids hash lowest: a bounded sample, the same at each run."""
    rows = found.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toArrow()
    return matrix(rows["v"])


def _best(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top(query: int, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of distinct ids other than the query's own, ties to smaller ids."""
    place = np.flatnonzero(ids != query)
    if len(place) > k:
        bar = np.partition(score[place], len(place) - k)[len(place) - k]
        place = place[score[place] >= bar]
    down = ~score[place] if score.dtype.kind == "i" else -score[place]
    return place[np.lexsort((ids[place], down))][:k]


def _meet(found: DataFrame, queries: DataFrame, n_queries: int, block: Column, search, score: str) -> DataFrame:
    """search(queries, candidates) for every block of candidates and band of queries; queries have the array blocks, of
    those that they visit."""
    bands = max(1, math.ceil(n_queries / BAND))
    asked = queries.withColumn("band", F.pmod(F.xxhash64("id"), F.lit(bands)).cast("int")).withColumn("block", F.explode("blocks")).drop("blocks")
    dealt = found.select("id", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    return asked.groupBy("block", "band").cogroup(dealt.groupBy("block", "band")).applyInArrow(search, f"query_id long, vec_id long, score {score}")


def _queries(found: DataFrame, query_on: Column) -> DataFrame:
    """One row a query; of rows that share an id the first by its components."""
    return found.filter(query_on).groupBy("id").agg(F.min("v").alias("v"))


def _found(out: list, kind) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 3
    return pa.table([pa.array(c.astype(t)) for c, t in zip(cols, (np.int64, np.int64, kind), strict=True)], names=["query_id", "vec_id", "score"])


def exact_top_k(rows: DataFrame, query_on: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", lead: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of the vectors floor(scale * x), exactly.

    ``query_on`` is over the column ``id``.  Blocks hold vectors of like length.  In a block, vectors are taken by
    falling length: the search ends where length times the query's length is below the k-th score so far.  Before
    that, the first ``lead`` coordinates of an SVD rotation give a partial sum, the lengths of the rest bound the
    remainder by Cauchy-Schwarz, and only vectors that can still reach the k-th score get their integer product.
    The k-th score starts from the products with the SEEDS longest vectors, and a query only visits blocks whose
    longest vector can reach it.  Products are integers at any size of the components; a score beyond the range of a
    long counts as the end of that range.
    """
    found, d = usable(rows, id_col, vector_col)
    nothing = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not d:
        return nothing

    def scaled(batches):
        most = np.finfo(np.float64).max
        with np.errstate(over="ignore"):
            for batch in batches:
                x = np.floor(np.clip(matrix(batch.column("v")) * scale, -most, most))
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * d, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), v, pa.array(_lengths(x))], ["id", "v", "length"])

    found = found.mapInArrow(scaled, "id long, v array<double>, length double")
    n, n_queries, longest = found.agg(F.count(F.lit(1)), F.sum(query_on.cast("int")), F.max("length")).first()
    if not n or not n_queries:
        return nothing
    first = found.orderBy(F.desc("length"), "id", "v").limit(SEEDS).toArrow()
    seed_ids, seeds = first["id"].to_numpy(), matrix(first["v"])
    sample = _sample(found)
    sample = sample / np.maximum(1.0, np.abs(sample).max(axis=1, keepdims=True))
    # right singular vectors, the largest first, by way of the small Gram matrix
    turn, lead = np.ascontiguousarray(np.linalg.eigh(sample.T @ sample)[1][:, ::-1]), min(lead, d)
    # blocks: bands of like length, cut further by a hash where many vectors have one length
    blocks = max(1, math.ceil(n / BLOCK))
    levels = min(blocks, 64)
    edges = sorted(set(found.approxQuantile("length", [i / levels for i in range(1, levels)], 0.005))) if levels > 1 else []
    level = F.lit(0)
    for e in edges:
        level = level + (F.col("length") > e).cast("int")
    each = math.ceil(blocks / max(1, len(edges) + 1))
    block = (level * each + F.pmod(F.xxhash64("id"), F.lit(each))).cast("int")
    upper = np.array([*edges, longest])
    shared = rows.sparkSession.sparkContext.broadcast((turn, seed_ids, seeds))

    def prepare(batches):
        _, seed_ids, seeds = shared.value
        with np.errstate(all="ignore"):
            for batch in batches:
                q, bars, visits = matrix(batch.column("v")), [], []
                for own, v, size in zip(batch.column("id").to_pylist(), q, _lengths(q), strict=True):
                    s = exact_products(seeds[seed_ids != own], v)
                    bar = int(np.partition(s, len(s) - k)[len(s) - k]) if len(s) >= k else None
                    near = np.arange(len(upper)) if bar is None else np.flatnonzero(~(size * upper + _slack(size, upper) < bar))
                    bars.append(bar)
                    visits.append((near[:, None] * each + np.arange(each)).ravel().tolist())
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(bars, pa.int64()), pa.array(visits, pa.list_(pa.int32()))], ["id", "v", "bar", "blocks"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            with np.errstate(all="ignore"):
                out = list(_pruned(left, right, shared.value[0], lead, k))
        return _found(out, np.int64)

    asked = _queries(found, query_on).mapInArrow(prepare, "id long, v array<double>, bar long, blocks array<int>")
    return _best(_meet(found, asked, int(n_queries), block, search, "long"), k)


def _pruned(left: pa.Table, right: pa.Table, turn: np.ndarray, lead: int, k: int):
    """(query, ids, scores) of the best candidates of a block for each query.  Bounds that overflow prune nothing."""
    q_ids, q = left["id"].to_numpy(), matrix(left["v"])
    ids, x = right["id"].to_numpy(), matrix(right["v"])
    size = _lengths(x)
    order = np.lexsort((ids, -size))
    ids, x, size = ids[order], x[order], size[order]
    xr, qr, q_size = x @ turn, q @ turn, _lengths(q)
    rest, q_rest = _lengths(xr[:, lead:]), _lengths(qr[:, lead:])
    for i, (own, bar) in enumerate(zip(q_ids, left["bar"].to_pylist(), strict=True)):
        bar = -np.inf if bar is None else bar
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(ids), 2048):
            slack = _slack(q_size[i], size[at])
            if q_size[i] * size[at] + slack < bar:
                break
            cut = slice(at, at + 2048)
            bound = xr[cut, :lead] @ qr[i, :lead] + rest[cut] * q_rest[i]
            live = at + np.flatnonzero(~(bound + slack < bar))
            best_ids, best = np.concatenate((best_ids, ids[live])), np.concatenate((best, exact_products(x[live], q[i])))
            top = _top(own, best_ids, best, k)
            best_ids, best = best_ids[top], best[top]
            if len(best) == k:
                bar = max(bar, int(best[-1]))
        yield np.full(len(best), own), best_ids, best


def _lengths(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, initial=0)
    top[top == 0] = 1.0
    return np.sqrt(((x / top[:, None]) ** 2).sum(axis=1)) * top


def _slack(q_size, size):
    """More than rounding can take from a product of vectors of these lengths."""
    return 1e-6 * (1 + q_size * size)


def exact_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers held in doubles, as longs; those outside the range of a long are its ends."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q)
    if most < 1 << 52:
        return (x @ q).astype(np.int64)
    if most < 1 << 62:
        return x.astype(np.int64) @ q.astype(np.int64)
    whole = [int(b) for b in q]
    sums = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in x.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, m: int) -> np.ndarray:
    """The m pivots with the largest cosine to each vector, nearest first."""
    s = x @ pivots.T
    near = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(x), 1))
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)


def permutation_search(rows: DataFrame, query_on: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 1024, prefix: int = 64, share: float = 0.3) -> DataFrame:
    """query_id, rank, vec_id, score: about the k largest inner products, found through a permutation index.

    A vector is represented by its ``prefix`` nearest of ``pivots`` sample vectors, in order (all by cosine), and
    posted with the place of each in that pivot's inverted file.  A query reads the files of its own pivots, adds up
    the footrule (place differences; ``prefix`` where a pivot is missing), and the ``share`` of each block with the
    smallest footrule (4 k vectors at least) gets its inner product in double precision.  As inner products grow with
    the length of a vector, the closeness by footrule (its largest value less it) is weighed by that length.  Footrules that tie go to the
    smaller id, and so do pivots that tie to the one first in the sample.  Zero vectors take no part.  Every row is
    indexed; only the pivots come from a sample.
    """
    found, d = usable(rows, id_col, vector_col)
    found = found.filter(F.exists("v", lambda x: x != 0))
    n, n_queries = found.agg(F.count(F.lit(1)), F.sum(query_on.cast("int"))).first() if d else (0, 0)
    if not n or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    base = _sample(found, min(SAMPLE, pivots, max(16, n // 2)))
    base = base / np.sqrt((base * base).sum(axis=1, keepdims=True))
    m = min(prefix, max(1, len(base) // 4))
    shared = rows.sparkSession.sparkContext.broadcast(base)
    blocks = max(1, math.ceil(n / BLOCK))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            base = shared.value
            q_ids, q = left["id"].to_numpy(), matrix(left["v"])
            ids, x = right["id"].to_numpy(), matrix(right["v"])
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            size = _lengths(x)
            near = nearest_pivots(x, base, m)
            by = np.argsort(near.ravel(), kind="stable")
            who, place = (by // m).astype(np.int64), (by % m).astype(np.int64)
            edge = np.searchsorted(near.ravel()[by], np.arange(len(base) + 1))
            take = min(len(ids), max(4 * k, math.ceil(share * len(ids))))
            for own, v, mine in zip(q_ids, q, nearest_pivots(q, base, m), strict=True):
                posts = [slice(edge[p], edge[p + 1]) for p in mine]
                at = np.concatenate([who[s] for s in posts])
                gain = np.concatenate([m - np.abs(place[s] - i) for i, s in enumerate(posts)])
                # the footrule is m * m less these sums; a longer vector makes up for a larger one
                near_by = np.bincount(at, weights=gain, minlength=len(ids)) * size
                if take < len(ids):
                    bar = np.partition(near_by, len(ids) - take)[len(ids) - take]
                    some = np.flatnonzero(near_by >= bar)
                    if len(some) > take:  # of those at the bar, the smaller ids
                        some = np.sort(np.concatenate((np.flatnonzero(near_by > bar), np.flatnonzero(near_by == bar)[: take - int((near_by > bar).sum())])))
                else:
                    some = np.arange(len(ids))
                rough = x[some] @ v
                rough[ids[some] == own] = -np.inf
                bar = np.partition(rough, max(0, len(rough) - k))[max(0, len(rough) - k)]
                some = some[rough >= bar - 1e-9 * max(1.0, abs(bar))] if np.isfinite(bar) else some[np.isfinite(rough)]
                score = (x[some] * v).sum(axis=1)
                top = _top(own, ids[some], score, k)
                out.append((np.full(len(top), own), ids[some][top], score[top]))
        return _found(out, np.float64)

    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")
    asked = _queries(found, query_on).withColumn("blocks", F.sequence(F.lit(0), F.lit(blocks - 1)))
    return _best(_meet(found, asked, int(n_queries), block, search, "double"), k)
