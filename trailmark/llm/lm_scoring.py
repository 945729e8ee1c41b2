"""N-gram language-model scoring from a log-frequency Bloom filter.

A count c has the level ``1 + floor(2 * log2(c))``; the filter of an order holds an n-gram once for each level up to
its own.  A lookup probes level after level until one is missing and takes the middle of the last level's counts as
the estimate.  The filter is cut by the leading bits of the n-grams: every part of the corpus sends the n-grams of its
texts with their training counts to their buckets, and the reducer of a bucket adds the counts, fills its piece of
the filter and answers each entry with the level found there.  A piece has BITS_EACH bits at least for every level
of every n-gram in it and the number of buckets grows with the corpus, so the filter is never gathered in one place
and no level is left out for size.

Probability of a token after its history h: ``(1 - w) * P(shorter history) + w * min(1, c(h, token) / c(h))`` where
the filter knows h, else P(shorter history); with no history ``(c + 1) / (N + V + 1)``.

Also returned is the exact add-one unigram score: buckets of single tokens answer with the exact count as well.  There
a token is told by 96 bits (10^11 different tokens: a chance below 10^-6 that two are taken for one).

Tokens: words outside 0x20 and 0x09-0x0D, A-Z lower-cased, then one end token a text.  Defined cases: null and
empty texts are one end token; a text of any length is handled whole; null ids pass through; no training text:
N = V = 0; rows that repeat an id or a text count each time; nothing is ranked, so nothing is tied; an empty table
gives no rows; other columns of docs are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _chunks as C

END = C.mix(np.array([0x5EED, 0xE2D], np.uint64)) >> np.array([0, 64 - 8 * 4], np.uint64)
LEVELS = 96
#: Bits of a filter for each entry, and probes for each.
BITS_EACH, PROBES = 8, 5
#: Bits of a key of order 2 and above below those of its bucket: with BUCKET_KEYS keys in a bucket an n-gram is taken
#: for another with a chance of 2^-12, where a filter of BITS_EACH bits errs with 2 %.
KEY_BITS = 32
#: Bytes of the second hash of a single token.
TWO = 4


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(2 * np.log2(np.maximum(counts, 1)) + 1e-9).astype(np.int64)


def _estimates() -> np.ndarray:
    """Count for each level: middle of the integers that have it; 0 for level 0."""
    low = np.ceil(2 ** (np.arange(LEVELS + 1) / 2) - 1e-9)
    out = np.zeros(LEVELS + 1)
    for q in range(1, LEVELS + 1):
        out[q] = math.sqrt(low[q - 1] * max(low[q - 1], low[q] - 1))
    return out


ESTIMATE = _estimates()


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, second hash, text) of each token, end tokens included, and the tokens of each text."""
    w = C.Words(texts, fold=True, two=True)
    counts = w.counts + 1
    at = np.cumsum(counts) - 1
    plain = np.ones(int(counts.sum()), bool)
    plain[at] = False
    out = np.empty((2, len(plain)), np.uint64)
    for h, own, end in zip(out, (w.hash, w.hash2 >> np.uint64(64 - 8 * TWO)), END, strict=True):
        h[plain], h[at] = own, end
    return *out, np.repeat(np.arange(len(counts)), counts), counts


class Filter:
    """A Bloom filter over (n-gram, level) for the n-grams of one bucket, sized by its entries."""

    def __init__(self, key: np.ndarray, q: np.ndarray):
        """Hold each key for the levels from 1 to its own."""
        by = np.argsort(-q, kind="stable")
        key, q = key[by], q[by]
        entries = int(q.sum())
        self.bits = 1 << max(10, math.ceil(math.log2(max(1, entries * BITS_EACH))))
        slots = np.zeros(self.bits, bool)
        for at in range(1, int(q.max(initial=0)) + 1):
            held = key[: int(np.searchsorted(-q, -at, "right"))]
            for i in range(PROBES):
                slots[self.places(held, at, i)] = True
        self.data = np.packbits(slots, bitorder="little")

    def places(self, key: np.ndarray, q: int, i: int) -> np.ndarray:
        h = C.mix(key ^ (np.asarray(q, np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return (h + np.uint64(i) * step) & np.uint64(self.bits - 1)

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Level of each n-gram, 0 where the filter has none; probes go on while they succeed."""
        found, live, q = np.zeros(len(key), np.int64), np.arange(len(key)), 1
        while len(live) and q <= LEVELS:
            for i in range(PROBES):
                p = self.places(key[live], q, i)
                live = live[self.data[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1]
            found[live] = q
            q += 1
        return found


def grams(h: np.ndarray, doc: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first token, key) of each n-gram of two tokens or more inside one text: the bucket and KEY_BITS."""
    at, key = C.word_ngrams(h, doc, n)
    return at, key >> np.uint64(64 - bits - KEY_BITS)


def pack(key: np.ndarray, c: np.ndarray, two: np.ndarray | None = None) -> bytes:
    """Ascending keys as the gaps between them, their counts, as wide as the largest needs, and second hashes."""
    wide = max(1, (int(c.max()).bit_length() + 7) // 8)
    return C.pack_ascending(key) + bytes([wide]) + C.to_bytes(c, wide) + (b"" if two is None else C.to_bytes(two, TWO))


def unpack(raw: bytes, m: int, two: bool) -> tuple[np.ndarray, ...]:
    key, at = C.unpack_ascending(raw, m)
    c = C.from_bytes(raw, m, raw[at], at + 1)
    return key, c, C.from_bytes(raw, m, TWO, at + 1 + raw[at] * m) if two else key


def log10(c: list[np.ndarray], at: list[np.ndarray], size: int, weight: float) -> np.ndarray:
    """Log probability of each token from the counts of the n-grams of each order; size is N + V + 1."""
    p = (c[0] + 1) / size
    before = c[0][:-1]
    for n in range(2, len(c) + 1):
        if not len(at[n - 1]):
            break
        now, past = c[n - 1], before[at[n - 1]]
        last = at[n - 1] + n - 1
        p[last] = np.where(past > 0, (1 - weight) * p[last] + weight * np.minimum(1, now / np.maximum(past, 1)), p[last])
        before = np.zeros(len(p))
        before[at[n - 1]] = now
    return np.log10(p)


def lm_score(docs: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 3, weight: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``train_on`` selects the training rows (null: yes).
    """
    if order < 1:
        raise ValueError("order must be 1 at least")
    learns = F.coalesce(train_on, F.lit(True))
    rows, size = C.corpus_size(docs, text_col)
    parts, bits = C.n_parts(rows, size), C.bucket_bits(size // 6)
    dealt = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), learns.alias("_train"), C.part_of(parts, F.col(id_col), F.col(text_col)).alias("part"))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        h, two, doc, _ = tokens(table["_text"])
        train, rows = table["_train"].to_numpy(zero_copy_only=False).astype(np.uint64), []
        for n in range(1, order + 1):
            if n == 1:
                by, begin = C.sorted_runs(h, two)
                k, own = h[by][begin], train[doc[by]]
            else:
                at, k = grams(h, doc, n, bits)
                by = np.argsort(k)
                begin = C.runs(k[by])
                k, own = k[by][begin], train[doc[at[by]]]
            c = np.add.reduceat(own, begin) if len(begin) else own
            kept = 64 if n == 1 else bits + KEY_BITS
            for b, lo, hi in C.bucket_cuts(k, bits, kept):
                raw = pack(k[lo:hi] - (np.uint64(b) << np.uint64(kept - bits)), c[lo:hi], two[by[begin[lo:hi]]] if n == 1 else None)
                rows.append((b + ((n - 1) << bits), key[0].as_py(), n, hi - lo, raw))
        return C.blob_table(rows)

    def answer(table: pa.Table) -> pa.Table:
        sent = C.blobs(table)
        n = (sent[0][0] >> bits) + 1
        k, c, two = (np.concatenate(x) for x in zip(*(unpack(raw, m, n == 1) for _, _, m, raw in sent), strict=True))
        by, begin = C.sorted_runs(k, two)
        k, total = k[by][begin], np.add.reduceat(c[by], begin)
        seen = total > 0
        found = Filter(k[seen], np.minimum(level(total[seen]), LEVELS)).levels(k)
        back = np.empty(len(c), np.int64)
        back[by] = C.run_ids(begin, len(c))
        # All parts get the training tokens and distinct tokens of a bucket of single tokens.
        tail = C.to_bytes(np.array([total.sum(), seen.sum()], np.uint64), 8) if n == 1 else b""
        rows, at = [], 0
        for b, part, m, _ in sent:
            own = back[at : at + m]
            raw = C.to_bytes(found[own], 1) + (C.to_bytes(total[own], 6) if n == 1 else b"") + tail
            rows.append((b, part, n, m, pa.compress(raw, "zstd", asbytes=True)))
            at += m
        if n == 1:
            has = {part for _, part, *_ in sent}
            rows += [(sent[0][0], part, n, 0, pa.compress(tail, "zstd", asbytes=True)) for part in range(parts) if part not in has]
        return C.blob_table(rows)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return OUT.empty_table()
        h, two, doc, counts = tokens(left["_text"])
        c, starts, exact = [], [], None
        for n in range(1, order + 1):
            at, k = (np.arange(len(h)), h) if n == 1 else grams(h, doc, n, bits)
            by, begin = C.sorted_runs(k, two if n == 1 else k)
            back = np.empty(len(k), np.int64)
            back[by] = C.run_ids(begin, len(k))
            got = [(b, part, m, pa.decompress(raw, m * 7 + 16 if n == 1 else m, "zstd", asbytes=True)) for b, part, m, raw in C.blobs(right, n)]
            q = np.concatenate([np.frombuffer(raw, np.uint8, m) for _, _, m, raw in got] or [np.zeros(0, np.uint8)])
            c.append(ESTIMATE[q][back])
            starts.append(at)
            if n == 1:
                n_tokens, n_types = np.sum([C.from_bytes(raw, 2, 8, 7 * m) for _, _, m, raw in got], axis=0).tolist()
                exact = np.concatenate([C.from_bytes(raw, m, 6, m) for _, _, m, raw in got])[back].astype(np.float64)
        sum_of = lambda x: np.add.reduceat(x, np.cumsum(counts) - counts)  # noqa: E731  every text has a token
        base = sum_of(np.log10((exact + 1) / (n_tokens + n_types + 1)))
        own = sum_of(log10(c, starts, n_tokens + n_types + 1, weight))
        out = [left["_id"].combine_chunks(), pc_not(left["_train"]), pa.array(counts, pa.int64()), pa.array(sum_of((exact > 0).astype(np.int64))), pa.array(np.full(len(counts), n_tokens, np.int64)), pa.array(base), pa.array(own)]
        return pa.Table.from_arrays(out, schema=OUT)

    answers = dealt.groupBy("part").applyInArrow(count, C.BLOB_DDL).groupBy("bucket").applyInArrow(answer, C.BLOB_DDL)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def pc_not(x) -> pa.Array:
    return pa.compute.invert(x.combine_chunks())


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
