"""Shared machinery of the corpus operators: chunks of documents, word hashes and bucketed exchanges.

A corpus is dealt into *parts*, each about ``PART_BYTES`` of text, by a hash of id and text.  A part is handled
as one Arrow table with NumPy, so no row is made per word.  What parts must learn from each other goes through a
*bucketed exchange*: a part sorts and deduplicates its 64-bit keys, cuts them by their leading bits into buckets
and sends one packed blob per bucket; the reducer of a bucket answers each blob, entry by entry.  A key that is
in a third of all documents costs one entry per part, whatever its frequency, so hot keys need no special case.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Null texts count as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text bytes of a part; with its NumPy arrays a part takes about 100 MB in a Python worker.
PART_BYTES = 4 << 20
#: Rows of a part, on average at most.
PART_ROWS = 10_000
#: Keys that the reducer of one bucket holds, about.
BUCKET_KEYS = 1_000_000
#: Bytes hashed at once.
BLOCK = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Ranges of more bytes are hashed one by one.
LONG_RANGE = 256
#: Odd factors of the left and right half of a run of words; they differ by 2 modulo 4.
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)


_libc = ctypes.CDLL(None)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that every bit depends on all bits; no two inputs have one output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their offsets (one more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


class Words:
    """Words of many texts: byte ranges, hashes, and which text each belongs to."""

    def __init__(self, texts, fold: bool = False, two: bool = False):
        """With ``two`` there is a second hash of each word, ``hash2``, which depends on the first no more than chance."""
        trim()  # what the chunk before has left
        self.data, self.offs = text_bytes(texts)
        n = len(self.data)
        inside = ~_SPACE[self.data]
        begin, stop = inside.copy(), inside.copy()
        if n:
            begin[1:] &= ~inside[:-1]
            stop[:-1] &= ~inside[1:]
            at = self.offs[:-1][self.offs[:-1] < n]
            begin[at] = inside[at]
            at = self.offs[1:][self.offs[1:] > 0] - 1
            stop[at] = inside[at]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.starts, self.offs)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        found = range_hashes(_FOLD[self.data] if fold else self.data, self.starts, self.ends, 2 if two else 1)
        self.hash, self.hash2 = found[0], found[-1]
        self._joined: dict[bool, dict[int, np.ndarray]] = {False: {}, True: {}}

    def ngrams(self, n: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words inside one text; ``second``: from the second hashes."""
        return word_ngrams(self.hash2 if second else self.hash, self.doc, n, self._joined[second])


def word_ngrams(h: np.ndarray, doc: np.ndarray, n: int, joined: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of n words, put together from runs of 1, 2, 4, ... words, which ``joined`` keeps for the next n."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    joined = {} if joined is None else joined
    joined[1] = h
    size = 1
    while 2 * size <= n:
        if 2 * size not in joined:
            half = joined[size]
            joined[2 * size] = mix(half[:-size] * _LEFT + half[size:] * _RIGHT)
        size *= 2
    acc, at = joined[size][:m], size
    while at < n:
        while size > n - at:
            size //= 2
        acc = mix(acc * _LEFT + joined[size][at : at + m] * _RIGHT)
        at += size
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return at, mix(acc[at] ^ np.uint64(n))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: int = 1) -> list[np.ndarray]:
    """One or two 64-bit hashes of byte ranges.

    A range is read eight bytes at a time, and each step mixes all that came before, so ranges up to eight bytes never
    share a hash with others of their length, and longer ones by chance only (2^-64; 2^-128 for both hashes).
    """
    size = ends - starts
    out = [mix(size.astype(np.uint64) * _LEFT + np.uint64(s)) for s in _SEEDS[:hashes]]
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    lane = lanes[starts] & keep[np.minimum(size, 8)]
    out = [mix(h ^ lane) for h in out]
    long = np.flatnonzero(size > LONG_RANGE)
    live, done = np.flatnonzero((size > 8) & (size <= LONG_RANGE)), 8
    while len(live):
        lane = lanes[starts[live] + done] & keep[np.minimum(size[live] - done, 8)]
        for h in out:
            h[live] = mix(h[live] * _LEFT ^ lane)
        done += 8
        live = live[size[live] > done]
    for i in long:
        digest = xxhash.xxh3_128_intdigest(data[starts[i] : ends[i]].tobytes())
        for h, x in zip(out, (digest >> 64, digest & (1 << 64) - 1), strict=False):
            h[i] = x
    return out


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(rows, text bytes): two numbers from one aggregate over all rows."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()
    return int(n), int(size)


def n_parts(rows: int, size: int) -> int:
    return max(1, math.ceil(size / PART_BYTES), math.ceil(rows / PART_ROWS))


def bucket_bits(keys: int) -> int:
    """Leading bits that cut keys into buckets of about BUCKET_KEYS."""
    return max(4, math.ceil(math.log2(max(1, keys / BUCKET_KEYS))))


def part_of(parts: int, *cols: Column) -> Column:
    """The part of a row.  Equal rows of different input partitions go to different parts, so rows that repeat a million
    times, or null ids with null texts, are spread as well; a row's part is the same at each run over the same files."""
    return F.pmod(F.xxhash64(*cols, F.spark_partition_id()), F.lit(parts)).cast("int")


def to_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def pack_ascending(x: np.ndarray) -> bytes:
    """Ascending numbers as the gaps between them, as wide as the largest needs; the width comes first."""
    gap = np.diff(x, prepend=np.uint64(0))
    wide = max(1, (int(gap.max(initial=0)).bit_length() + 7) // 8)
    return bytes([wide]) + to_bytes(gap, wide)


def unpack_ascending(raw: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    """(n ascending numbers, place after them)."""
    wide = raw[at]
    return np.cumsum(from_bytes(raw, n, wide, at + 1), dtype=np.uint64), at + 1 + wide * n


def from_bytes(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    return out.view("<u8").ravel()


def bucket_cuts(sorted_keys: np.ndarray, bits: int, key_bits: int = 64) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket that the sorted keys have something in, in order."""
    top = (sorted_keys >> np.uint64(key_bits - bits)).astype(np.int64)
    begin = runs(top)
    return list(zip(top[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(top)], strict=False))


def runs(sorted_keys: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def sorted_runs(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, where each run of equal pairs begins in it): by the first numbers, and by both if that isn't enough."""
    order = np.argsort(one)
    a, b = one[order], two[order]
    if np.any((a[1:] == a[:-1]) & (b[1:] != b[:-1])):
        order = np.lexsort((two, one))
    return order, runs(one[order], two[order])


def run_ids(begin: np.ndarray, n: int) -> np.ndarray:
    """The run of each of n sorted entries."""
    return np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))


BLOB = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("blob", pa.binary())])
BLOB_DDL = "bucket int, part int, kind int, n int, blob binary"


def blob_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, BLOB, strict=True)], schema=BLOB)


def blobs(table: pa.Table, kind: int | None = None):
    """Rows of a blob table as tuples (bucket, part, n, blob), in order of bucket and part."""
    trim()
    rows = zip(*(table[c].to_pylist() for c in ("bucket", "part", "kind", "n", "blob")), strict=True)
    return sorted((b, p, n, raw) for b, p, k, n, raw in rows if kind is None or k == kind)


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared checkpoint folder so that lineage ends here.

    The folder is the session's ``spark.checkpoint.dir``; only where none is set (as in tests on one machine) a
    folder under the working directory's warehouse is taken.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Have Spark delete the shuffle files of steps that are over now, not at the driver's next full collection."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def slices(batch, text: str = "text", limit: int = 0):
    """Tables of consecutive rows of a record batch with about PART_BYTES (or limit) of text each, or one row."""
    limit = limit or PART_BYTES
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    sizes = np.cumsum(pc.fill_null(pc.binary_length(table[text]), 0).to_numpy().astype(np.int64))
    at, done = 0, 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield table.slice(at, end - at)
        at, done = end, sizes[end - 1]
        trim()


def trim() -> None:
    """Give freed memory back to the system: after a peak the driver or worker would keep it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        _libc.malloc_trim(0)
