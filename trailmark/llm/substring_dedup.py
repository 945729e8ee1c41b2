"""Exact substring deduplication with fixed-block anchors.

A window is ``window`` consecutive words of one document.  A word goes if it is covered by a window whose word
sequence also starts in a document with a smaller id.  Windows are judged on the input.

Method.  With blocks of ``(window + 1) // 2`` words, every window holds a whole block whose place is a multiple of
the block length.  (1) Index these non-overlapping reference blocks and probe them with every rolling block: a
block hash is a hit if it stands at a reference place somewhere and in two documents.  (2) Extend: the windows
around hits are matched by 128-bit fingerprints, and each learns whether a smaller document holds it: among 10^13
different windows two are taken for one with a chance below 10^-12.  (3) Windows
that overlap join into maximal repeats, and the words they cover go.

Both exchanges carry one entry per distinct key and part, so passages shared by a third of all documents cost no
more than rare ones.  No pairs of documents are made.

Defined cases: null and empty texts have no words; a null id is never trimmed and never a reference; rows that
repeat an id, with one text or several, are no copies of each other (an id is not smaller than itself), so nothing
is ever tied; a text of any length is handled whole, in a part of its own if it is longer than a part; an empty
table gives no rows; other columns are passed through only if asked for in ``keep``, whatever their names, unless
they are named like a column of the result, which is an error.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C

#: Bits of a block hash that go over the wire beside its bucket; errors cost time only, since windows decide.
ANCHOR_BITS = 38
NO_ID = np.iinfo(np.int64).max


class _Part:
    """Words of a part with its sorted distinct block hashes."""

    def __init__(self, table: pa.Table, window: int, bits: int, two: bool = True):
        self.words = w = C.Words(table["_text"], two=two)
        self.ids = table["_id"].combine_chunks().fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.block = (window + 1) // 2
        self.at, h = w.ngrams(self.block)
        key = h >> np.uint64(64 - bits - ANCHOR_BITS)
        self.order = np.argsort(key)
        key = key[self.order]
        self.begin = C.runs(key)
        self.keys = key[self.begin]
        self.cuts = C.bucket_cuts(self.keys, bits, bits + ANCHOR_BITS)

    def anchors(self) -> np.ndarray:
        """Hash, then whether it stands at a reference place, then whether two documents of the part have it."""
        if not len(self.keys):
            return self.keys
        doc = self.words.doc[self.at][self.order]
        place = self.at[self.order] - self.words.first[doc]
        aligned = np.bitwise_or.reduceat((place % self.block == 0), self.begin)
        several = np.minimum.reduceat(doc, self.begin) != np.maximum.reduceat(doc, self.begin)
        low = self.keys & np.uint64((1 << ANCHOR_BITS) - 1)
        return low << np.uint64(2) | aligned.astype(np.uint64) << np.uint64(1) | several.astype(np.uint64)

    def windows(self, answers: list, window: int):
        """Starts, fingerprints, order and runs of the windows around hits."""
        w, hit = self.words, np.zeros(len(self.keys), bool)
        for (_, lo, hi), (_, _, n, raw) in zip(self.cuts, answers, strict=True):
            hit[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        near = np.zeros(len(w.starts) + 1, np.int64)
        near[self.at[self.order] + 1] = hit[C.run_ids(self.begin, len(self.at))]
        near = np.cumsum(near)
        at, one = w.ngrams(window)
        near = near[at + window - self.block + 1] > near[at]
        two = w.ngrams(window, second=True)[1][near]
        at, one = at[near], one[near]
        order, begin = C.sorted_runs(one, two)
        least = np.minimum.reduceat(self.ids[w.doc[at[order]]], begin) if len(begin) else np.zeros(0, np.int64)
        return at, one, two, order, begin, least


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (kept words joined by one space) and removed
    (word ranges that went, as structs of first and end), then the columns named in ``keep``."""
    if window < 2:
        raise ValueError("window must be 2 words at least")
    rows, size = C.corpus_size(docs, text_col)
    parts, bits = C.n_parts(rows, size), C.bucket_bits(size // 6)
    # one exchange of the texts by part; the three passes below reuse it
    dealt = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *([F.struct(*[F.col(c) for c in keep]).alias("_keep")] if keep else []), C.part_of(parts, F.col(id_col), F.col(text_col)).alias("part")
    )

    def index(key: tuple, table: pa.Table) -> pa.Table:
        p = _Part(table, window, bits, two=False)
        x = p.anchors()
        return C.blob_table([(b, key[0].as_py(), 1, hi - lo, C.to_bytes(x[lo:hi], 5)) for b, lo, hi in p.cuts])

    def probe(table: pa.Table) -> pa.Table:
        sent = C.blobs(table)
        x = np.concatenate([C.from_bytes(raw, n, 5) for _, _, n, raw in sent])
        key = x >> np.uint64(2)
        order = np.argsort(key)
        begin = C.runs(key[order])
        either = np.bitwise_or.reduceat(x[order], begin)
        hit = (either & np.uint64(2) > 0) & ((np.diff(np.append(begin, len(x))) > 1) | (either & np.uint64(1) > 0))
        back = np.empty(len(x), bool)
        back[order] = hit[C.run_ids(begin, len(x))]
        return _answer(sent, back, 1)

    def extend(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return C.blob_table([])
        _, one, two, order, begin, least = _Part(left, window, bits).windows(C.blobs(right, 1), window)
        one, two, rows = one[order][begin], two[order][begin], []
        for b, lo, hi in C.bucket_cuts(one, bits):
            base = int(least[lo:hi].min())
            wide = max(1, (int(least[lo:hi].max() - base).bit_length() + 7) // 8)
            raw = base.to_bytes(8, "little", signed=True) + bytes([wide]) + C.pack_ascending(one[lo:hi]) + C.to_bytes(two[lo:hi], 8) + C.to_bytes((least[lo:hi] - base).view(np.uint64), wide)
            rows.append((b, key[0].as_py(), 2, hi - lo, raw))
        return C.blob_table(rows)

    def least_of(table: pa.Table) -> pa.Table:
        sent = C.blobs(table)
        one, two, ids = [], [], []
        for _, _, n, raw in sent:
            x, at = C.unpack_ascending(raw, n, 9)
            one.append(x)
            two.append(C.from_bytes(raw, n, 8, at))
            ids.append(C.from_bytes(raw, n, raw[8], at + 8 * n).view(np.int64) + int.from_bytes(raw[:8], "little", signed=True))
        one, two, ids = np.concatenate(one), np.concatenate(two), np.concatenate(ids)
        order, begin = C.sorted_runs(one, two)
        back = np.empty(len(one), bool)
        back[order] = np.minimum.reduceat(ids[order], begin)[C.run_ids(begin, len(one))] < ids[order]
        return _answer(sent, back, 2)

    def trim(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return out_schema(left).empty_table()
        p = _Part(left, window, bits)
        w = p.words
        at, one, _, order, begin, least = p.windows(C.blobs(right, 1), window)
        smaller = np.zeros(len(begin), bool)
        for (_, lo, hi), (_, _, n, raw) in zip(C.bucket_cuts(one[order][begin], bits), C.blobs(right, 2), strict=True):
            smaller[lo:hi] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n)
        run, start = C.run_ids(begin, len(at)), at[order]
        mine = p.ids[w.doc[start]]
        start = start[(smaller[run] | (least[run] < mine)) & (mine != NO_ID)]
        step = np.zeros(len(w.starts) + 1, np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + window, -1)
        gone = np.cumsum(step)[:-1] > 0
        removed = np.bincount(w.doc[gone], minlength=len(w.counts))
        data, texts, spans = w.data.tobytes(), [], []
        for d in range(len(w.counts)):
            words = data[w.offs[d] : w.offs[d + 1]].split()
            span = []
            if removed[d]:
                g = gone[w.first[d] : w.first[d + 1]]
                words = compress(words, ~g)
                edge = np.flatnonzero(np.diff(np.concatenate(([False], g, [False]))))
                span = [{"first": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
            texts.append(b" ".join(words).decode())
            spans.append(span)
        cols = [left["_id"].combine_chunks(), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, SPANS)]
        return pa.Table.from_arrays(cols + ([left["_keep"].combine_chunks()] if keep else []), schema=out_schema(left))

    def out_schema(left: pa.Table) -> pa.Schema:
        fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", SPANS)]
        return pa.schema(fields + ([("_keep", left.schema.field("_keep").type)] if keep else []))

    answers = dealt.groupBy("part").applyInArrow(index, C.BLOB_DDL).groupBy("bucket").applyInArrow(probe, C.BLOB_DDL)
    fingers = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(extend, C.BLOB_DDL)
    answers = answers.unionByName(fingers.groupBy("bucket").applyInArrow(least_of, C.BLOB_DDL))
    ddl = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:int,end:int>>"
    if keep:
        ddl += f", _keep {dealt.schema['_keep'].dataType.simpleString()}"
    out = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(trim, ddl)
    return out.select("doc_id", "n_words", "n_removed", "kept_text", "removed", *[F.col("_keep")[c].alias(c) for c in keep])


SPANS = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _answer(sent: list, bit: np.ndarray, kind: int) -> pa.Table:
    """A bit for each entry, sent back to the part it came from."""
    rows, at = [], 0
    for b, part, n, _ in sent:
        rows.append((b, part, kind, n, np.packbits(bit[at : at + n]).tobytes()))
        at += n
    return C.blob_table(rows)
