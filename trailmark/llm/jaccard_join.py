"""N-gram Jaccard join with size-aware light and heavy sets.

The set of a document is its distinct ``k``-word shingles (A-Z lower-cased; a shorter text is one shingle of all its
words; no words: empty set, linked with nothing).  Two documents link when ``100 * |A & B| >= percent * |A | B|``.

Method.  Documents with equal sets form a class, and only classes are joined.  Shingles have one global order, rare
ones first.  A set of size n that links shares ``c = ceil(percent * n / 100)`` shingles with its partner, so the m
smallest shared shingles lie in its first ``n - c + m``.
* Light sets (n at most the boundary) enumerate all 2-subsets of their first ``n - c + 2`` shingles and meet on
  equal subsets.
* Heavy sets scan the inverted lists of their first ``n - c + 1`` shingles, which all sets large enough to be a
  partner of a heavy set are posted in.
* The boundary is the size at which subsets cost more than scanning, from the counts of sizes and the mean list.

Candidates are checked in two passes.  First, each list links its members to one leader, and components are taken.
Second, members of one list that are still in different components are compared (with ``complete=True`` all of
them).  Both passes drop a pair if its parity bitmaps prove the symmetric difference too large, and decide the rest
on the whole sets, so links are exact but for hashing: a shingle is a 64-bit hash (two of a pair's sets of 10^4 are
taken for one with a chance below 10^-11), and sets are equal if 128 bits say so.  Sets have 64-bit ids; where two
different sets get one id, which the 128 bits tell, all but one of them move to another id.

Skew: shingles known to be in very many sets spread their lists over salted sub-lists in the first pass and over
pairs of blocks in the second; a group of near copies costs its size times the passes, not its square, in rows.  A
list whose members stay in different components is compared in blocks, which is its square in comparisons of
bitmaps.  Joins on sets, lists and components broadcast the few hot keys (``hot_join``).  Only the order (at most
ORDERED shingles; it changes costs, never links), the sizes up to LIGHT_MAX and a few sums reach the driver.

Defined cases: null text is empty; a text of any length is one set; rows that repeat an id are separate documents
whose component is found by their sets; null ids are returned with their component's smallest id, or null, and
connect no two other documents; ties between leaders of a list go to a hash, which changes no component; an empty
table gives no rows; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C
from .components import connected_components, hot_join

#: Shingles whose frequency the order knows; others count as rare.  A bound on the broadcast (1 MB).
ORDERED = 1 << 16
#: Sets of one list handled together.
BLOCK_SETS = 2048
#: Sets above this size are heavy at any cost.
LIGHT_MAX = 64
#: A list longer than this is salted in the first pass.
HOT_LIST = 20_000

#: Sets that may move to another id; at 10^11 different sets about 300 do.
MOVED = 100_000

DOC_DDL = "kind int, doc_id long, n long, set_id long, check long, sig binary"
DOC = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.int64()), ("check", pa.int64()), ("sig", pa.binary())])
PAIR_DDL = "kind int, x long, y long"
PAIR = pa.schema([("kind", pa.int32()), ("x", pa.int64()), ("y", pa.int64())])
TOP = np.uint64(1 << 63)


def sets_of(texts, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    w = C.Words(texts, fold=True)
    at, h = w.ngrams(k)
    edges = np.searchsorted(at, w.first)
    out = []
    for d, n in enumerate(w.counts):
        if n >= k:
            out.append(np.unique(h[edges[d] : edges[d + 1]]))
        elif n:
            own = w.hash[w.first[d] : w.first[d + 1]]
            out.append(C.word_ngrams(own, np.zeros(n, np.int64), int(n))[1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class SetIds:
    """Ids of sets: the upper ``bits`` of a 64-bit hash, and another hash that tells sets of one id apart."""

    def __init__(self, bits: int = 64, moved: dict[tuple[int, int], int] | None = None):
        self.bits, self.moved = bits, moved or {}

    def hashes(self, s: np.ndarray) -> tuple[int, int]:
        sums = [C.mix(s * np.uint64(k) + np.uint64(len(s))).sum(dtype=np.uint64) for k in (0xA24BAED4963EE407, 0x9FB21C651E98DF25)]
        own, check = C.mix(np.array(sums, np.uint64))
        return int((own >> np.uint64(64 - self.bits)).view(np.int64)), int(check.view(np.int64))

    def __call__(self, s: np.ndarray) -> int:
        found = self.hashes(s)
        return self.moved.get(found, found[0])


def signature(s: np.ndarray) -> bytes:
    """Parity of the shingles on each of L places, L the power of two from 2n; halves fold by exclusive or."""
    size = max(64, 1 << math.ceil(math.log2(2 * len(s))))
    places = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(places.astype(bool), bitorder="little").tobytes()


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def light_boundary(sizes: dict[int, int], percent: int, mean_list: float) -> int:
    """The size up to which enumerating subsets costs least; sizes: sets of each size."""

    def cost(x: int) -> float:
        light = sum(m * math.comb(n - least_overlap(n, percent) + 2, 2) for n, m in sizes.items() if n <= x)
        posted = sum(m * (n - least_overlap(n, percent) + 1) * mean_list for n, m in sizes.items() if 100 * n >= percent * (x + 1))
        return light + posted

    return min(range(LIGHT_MAX + 1), key=cost)


def _documents(docs: DataFrame, k: int, ids: SetIds) -> DataFrame:
    """Kind 0: the set of each document.  Kind 1: shingles frequent in a chunk.  Kind 2: sums for the cost."""

    def scan(batches):
        for batch in batches:
            for t in C.slices(batch):
                rows, distinct = [], {}
                for i, s in zip(t["doc_id"].to_pylist(), sets_of(t["text"], k), strict=True):
                    if len(s):
                        x = ids.hashes(s)
                        if x not in distinct:
                            distinct[x] = (s, signature(s))
                        rows.append((0, i, len(s), *x, distinct[x][1]))
                    else:
                        rows.append((0, i, 0, None, None, None))
                if distinct:
                    h, c = np.unique(np.concatenate([s for s, _ in distinct.values()]), return_counts=True)
                    often = c >= 4
                    rows += [(1, None, int(m), int(x), None, None) for x, m in zip(h[often].view(np.int64), c[often], strict=True)]
                    rows.append((2, int(c.sum()), len(h), None, None, None))
                yield from pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), DOC, strict=True)], schema=DOC).to_batches() if rows else ()

    return C.cut(docs.mapInArrow(scan, DOC_DDL))


def _candidates(docs: DataFrame, k: int, percent: int, boundary: int, often: np.ndarray, counts: np.ndarray, bits: int, ids: SetIds) -> DataFrame:
    """Kind 0: pairs of a list's leader and a member.  Kind 1: lists (x) with their members (y)."""
    spark = docs.sparkSession
    by = np.argsort(often)
    shared = spark.sparkContext.broadcast((often[by], np.argsort(np.argsort(counts, kind="stable"))[by], counts[by]))

    def post(batches):
        known, rank, count = shared.value
        for batch in batches:
            for t in C.slices(batch):
                keys, sets, salts, done = [], [], [], set()
                for s in sets_of(t["text"], k):
                    n = len(s)
                    x = ids(s) if n else None
                    if n < 2 or x in done:  # a set of one links with its own class only
                        continue
                    done.add(x)
                    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                    frequent = known[at] == s if len(known) else np.zeros(n, bool)
                    order = s >> np.uint64(1)
                    order[frequent] = TOP + rank[at[frequent]].astype(np.uint64)
                    c = least_overlap(n, percent)
                    first = np.argsort(order, kind="stable")[: n - c + 2]
                    times = np.where(frequent, count[at], 0)[first] if len(known) else np.zeros(len(first), np.int64)
                    s = s[first]
                    if n <= boundary:
                        i, j = np.array(list(combinations(range(len(s)), 2))).T
                        keys.append(C.mix(s[i] * np.uint64(0x9FB21C651E98DF25) + C.mix(s[j])))
                        salts.append(np.minimum(times[i], times[j]))
                    if 100 * n >= percent * (boundary + 1):
                        keys.append(s[: n - c + 1])
                        salts.append(times[: n - c + 1])
                    sets += [x] * (sum(map(len, keys)) - len(sets))
                if not keys:
                    continue
                key, sid, salt = np.concatenate(keys) >> np.uint64(16), np.array(sets, np.int64).view(np.uint64), np.concatenate(salts)
                bucket = (key >> np.uint64(48 - bits)).astype(np.int64)
                hot = salt > HOT_LIST
                bucket[hot] = (bucket[hot] + (C.mix(sid[hot]) % (1 + salt[hot] // HOT_LIST).astype(np.uint64)).astype(np.int64)) % (1 << bits)
                rows = []
                for kind in (1, 2):
                    mine = np.flatnonzero(hot == (kind == 2))
                    mine = mine[np.argsort(bucket[mine], kind="stable")]
                    edge = np.append(C.runs(bucket[mine]), len(mine))
                    for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                        m = mine[lo:hi]
                        rows.append((int(bucket[m[0]]), -1, kind, len(m), C.to_bytes(key[m], 6) + C.to_bytes(sid[m], 8)))
                yield from C.blob_table(rows).to_batches()

    def meet(table: pa.Table) -> pa.Table:
        parts, forced = [], []
        for kind in (1, 2):
            for _, _, n, raw in C.blobs(table, kind):
                parts.append((C.from_bytes(raw, n, 6), C.from_bytes(raw, n, 8, 6 * n)))
                forced.append(np.full(n, kind == 2))
        key, sid, forced = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate(forced)
        by = np.lexsort((sid, key))
        by = by[C.runs(key[by], sid[by])]
        key, sid, forced = key[by], sid[by], forced[by]
        begin = C.runs(key)
        size, run = np.diff(np.append(begin, len(key))), C.run_ids(begin, len(key))
        # the smallest set leads a short list; a long list has a leader of its own, so that members meet several
        turn = np.where(size[run] > 16, C.mix(sid ^ C.mix(key)), np.uint64(0))
        lead = np.lexsort((sid, turn, key))[begin][run] if len(key) else begin
        pair = (size[run] > 1) & (sid != sid[lead])
        a, b = np.minimum(sid[pair].view(np.int64), sid[lead][pair].view(np.int64)), np.maximum(sid[pair].view(np.int64), sid[lead][pair].view(np.int64))
        both = np.unique(np.stack((a, b)), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        listed = (size[run] > 2) | forced
        kinds = np.concatenate((np.zeros(both.shape[1], np.int32), np.ones(int(listed.sum()), np.int32)))
        return pa.Table.from_arrays([pa.array(kinds), pa.array(np.concatenate((both[0], key[listed].view(np.int64)))), pa.array(np.concatenate((both[1], sid[listed].view(np.int64))))], schema=PAIR)

    return C.cut(docs.select("text").mapInArrow(post, C.BLOB_DDL).groupBy("bucket").applyInArrow(meet, PAIR_DDL))


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that sizes and bitmaps allow to link."""
    side = lambda s: classes.select(F.col("set_id").alias(s), F.col("n").alias(f"n{s}"), F.col("sig").alias(f"s{s}"))

    def prune(batches):
        for batch in batches:
            keep = [_close(na, nb, int.from_bytes(sa, "little"), len(sa) * 8, int.from_bytes(sb, "little"), len(sb) * 8, percent) for na, nb, sa, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return joined.mapInArrow(prune, "a long, b long")


def _close(na: int, nb: int, sa: int, la: int, sb: int, lb: int, percent: int) -> bool:
    while la > lb:
        la //= 2
        sa = (sa >> la) ^ (sa & (1 << la) - 1)
    while lb > la:
        lb //= 2
        sb = (sb >> lb) ^ (sb & (1 << lb) - 1)
    return (100 + percent) * (sa ^ sb).bit_count() <= (100 - percent) * (na + nb)


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, ids: SetIds) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    have = classes.join(wanted, "set_id").select("doc_id")

    def expand(batches):
        for batch in batches:
            for t in C.slices(batch):
                sets = [s for s in sets_of(t["text"], k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([ids(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_id", "items"])

    def decide(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    items = docs.join(have, "doc_id", "left_semi").select("text").mapInArrow(expand, "set_id long, items binary").dropDuplicates(["set_id"])
    items = C.cut(items)
    C.release(docs)
    side = lambda s: items.select(F.col("set_id").alias(s), F.col("items").alias(f"x{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(decide, "a long, b long")


def _across(lists: DataFrame, classes: DataFrame, component: DataFrame, percent: int, complete: bool) -> DataFrame:
    """Pairs that share a list, lie in different components (or anywhere) and may link."""
    rows = lists.join(component.withColumnRenamed("node", "y"), "y", "left").withColumn("component", F.coalesce("component", "y"))
    mixed = rows.groupBy("x").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = C.cut(mixed.filter("m > 1" if complete else "lo <> hi").select("x", "m", F.ceil(F.col("m") / BLOCK_SETS).cast("int").alias("blocks")))
    members, copies = mixed.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * F.col("blocks")), F.lit(0))).first()
    own = F.pmod(F.xxhash64("y"), F.col("blocks")).cast("int")
    dealt = hot_join(rows, mixed, "x", "m", members).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
    dealt = dealt.join(classes.select(F.col("set_id").alias("y"), "n", "sig"), "y")
    groups = max(1, math.ceil(copies / 20_000))
    dealt = dealt.select("x", "lo", "hi", "own", "y", "component", "n", "sig", F.pmod(F.xxhash64("x", "lo", "hi"), F.lit(groups)).alias("deal"))

    def compare(table: pa.Table) -> pa.Table:
        t = table.select(["x", "lo", "hi", "own", "y", "component", "n"]).to_pandas()
        sig = table["sig"].to_pylist()
        found = [np.zeros((2, 0), np.int64)]
        for (_, lo, hi), g in t.groupby(["x", "lo", "hi"], sort=False):
            y, comp, n, own, at = g.y.to_numpy(), g.component.to_numpy(), g.n.to_numpy(), g.own.to_numpy(), g.index.to_numpy()
            bits = np.array([len(sig[i]) * 8 for i in at])
            for size in np.unique(bits):
                use = np.flatnonzero((bits == size) | (bits == 2 * size))
                m = np.stack([_folded(sig[at[i]], int(size)) for i in use])
                for p in np.flatnonzero(bits[use] == size):
                    i = use[p]
                    ok = ((bits[use] > size) | (np.arange(len(use)) > p)) & (100 * np.minimum(n[use], n[i]) >= percent * np.maximum(n[use], n[i]))
                    if not complete:
                        ok &= comp[use] != comp[i]
                    if lo != hi:
                        ok &= own[use] != own[i]
                    q = np.flatnonzero(ok)
                    if len(q):
                        far = np.bitwise_count(m[q] ^ m[p]).sum(axis=1, dtype=np.int64)
                        q = use[q[(100 + percent) * far <= (100 - percent) * (n[use[q]] + n[i])]]
                        found.append(np.stack((np.minimum(y[q], y[i]), np.maximum(y[q], y[i]))))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})

    return dealt.groupBy("deal").applyInArrow(compare, "a long, b long").distinct()


def _folded(raw: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 64 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def _moved(own: DataFrame, classes: DataFrame) -> dict[tuple[int, int], int]:
    """New ids for sets that share the id of another set."""
    shared = classes.filter("least_check <> most_check").select("set_id", "least_check")
    if not shared.limit(1).count():
        return {}
    rows = own.join(shared, "set_id").filter("check <> least_check").select("set_id", "check", F.xxhash64("set_id", "check").alias("to")).distinct()
    found = rows.limit(MOVED + 1).collect()
    if len(found) > MOVED:
        raise RuntimeError(f"more than {MOVED} sets share the id of another set")
    return {(r[0], r[1]): r[2] for r in found}


def _classes(own: DataFrame) -> DataFrame:
    sums = [F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.any_value("sig").alias("sig"), F.min("check").alias("least_check"), F.max("check").alias("most_check")]
    return C.cut(own.filter("set_id is not null and doc_id is not null").groupBy("set_id").agg(*sums))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, complete: bool = True, id_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has doc_id, n_shingles and set_id (its class; null if empty); links has pairs
    (a, b) of classes, a < b: all that link, or, without ``complete``, enough of them to connect all that link.
    ``id_bits`` is the length of first ids; those that aren't unique move in any case."""
    if not 50 < percent <= 100 or k < 1:
        raise ValueError("percent must be over 50 and at most 100, and k 1 at least")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids = SetIds(id_bits)
    seen = _documents(docs, k, ids)
    own = seen.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), "set_id", "check", "sig")
    classes = _classes(own)
    if moved := _moved(own, classes):
        ids = SetIds(id_bits, moved)
        table = docs.sparkSession.createDataFrame([(*x, to) for x, to in moved.items()], "set_id long, check long, to long")
        own = own.join(F.broadcast(table), ["set_id", "check"], "left").withColumn("set_id", F.coalesce("to", "set_id")).drop("to")
        classes = _classes(own)
    top = seen.filter("kind = 1").groupBy("set_id").agg(F.sum("n").alias("m")).orderBy(F.desc("m"), "set_id").limit(ORDERED).toArrow()
    posted, distinct = seen.filter("kind = 2").agg(F.coalesce(F.sum("doc_id"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = dict(classes.filter(F.col("n") <= 2 * LIGHT_MAX).groupBy("n").count().collect())
    boundary = light_boundary(sizes, percent, posted / max(1, distinct))
    often, counts = (top[c].to_numpy().astype(np.int64) for c in ("set_id", "m"))
    bits = C.bucket_bits(posted * (100 - percent) // 100 * 2)
    found = _candidates(docs, k, percent, boundary, often.view(np.uint64), counts, bits, ids)
    C.release(docs)
    star = C.cut(_possible(found.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), classes, percent))
    links = C.cut(_linked(star, docs, classes, k, percent, ids))
    C.release(docs)
    more = _across(found.filter("kind = 1").select("x", "y"), classes, connected_components(links), percent, complete)
    more = C.cut(more.join(star, ["a", "b"], "left_anti"))
    C.release(docs)
    return own.drop("sig", "check"), links.unionByName(C.cut(_linked(more, docs, classes, k, percent, ids)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, id_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    own, links = jaccard_links(docs, id_col, text_col, k, percent, complete=False, id_bits=id_bits)
    sizes = own.groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("set_id is not null")
    linked = C.cut(sizes.join(connected_components(links).withColumnRenamed("node", "set_id"), "set_id"))
    least = linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    linked = hot_join(linked, least, "component", "m", linked.count()).select("set_id", "component_id")
    found = sizes.join(linked, "set_id", "left").select("set_id", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = hot_join(own, found, "set_id", "n", own.count(), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
