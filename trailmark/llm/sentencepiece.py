"""SentencePiece encoding and decoding as a relational lattice.

Texts become marked texts (a mark before a text, spaces as marks) and fall into *units* at every place that no piece
spans, so units can be encoded apart and each distinct unit once.  Over the table of distinct units:

1. explode the substrings of bounded length (the longest piece),
2. equi-join them to the piece table: the matches are the edges of the unit's lattice,
3. group the edges by unit, and
4. fold them with higher-order functions into the unit's pieces.

For models of type unigram the fold is Viterbi: best score for each end, then the way back.  For models of type BPE
a best-scoring path is not what the model means and gives other ids than its own encoder, so there the fold applies
the edges as merges: over and over the best-ranked edge, leftmost first, that spans exactly two current pieces.  One
pass over the edges by rank does that, unless a merge makes an edge fit that has a better rank (``Pieces.late``); units
with such an edge look through all edges at each merge.

Chunks of texts travel once, compressed.  They ask for their distinct units through a bucketed exchange and are
answered through another one, so the vocabulary is never broadcast and a unit in a third of all texts costs one
entry a chunk.  Characters outside the pieces are spelt in byte pieces where the model has them, else unknown.

The chunks are cut from the record batches of ``docs``, twice in one plan.  Rows must therefore come in the same
order each time, as they do from files; if they didn't, the operator would fail rather than mix answers.

Defined cases: null and empty texts have no ids and decode to the empty text; a text that holds the mark U+2581
itself decodes to spaces there; a text of any length is encoded whole; rows that repeat an id or a text are encoded
each; null ids pass through; of equal best paths the one whose last edge starts first counts, of equal merges the
leftmost; an empty table gives no rows; other columns pass through if asked for in ``keep``, whatever their names.
A unit is told by 128 bits of hash; the lattice knows it by its bucket and its number there.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _chunks as C

MARK = "▁"
#: Text bytes of a chunk: few enough for a worker, enough that most units repeat.
CHUNK_BYTES = 3 << 20
#: Most pieces that are broadcast (with at most 64 characters each, 32 MB); larger tables are joined by shuffle.
BROADCAST_PIECES = 250_000
#: Units up to this many characters are folded; their boundaries fit the bits of one long.
LONGEST_UNIT = 62
#: Bits of the number of a unit in its bucket; the bucket lies above.
NUMBER_BITS = 40


class Pieces:
    """What is needed of a model file: pieces with scores, byte pieces, the unknown piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            m = proto.ModelProto.FromString(f.read())
        self._read(m)

    @classmethod
    def of(cls, proto) -> Pieces:
        self = cls.__new__(cls)
        self._read(proto)
        return self

    @classmethod
    def as_unigram(cls, path: str) -> Pieces:
        """The pieces of a BPE model as a unigram table: the log of a probability that falls with the rank."""
        self = cls(path)
        total = float(np.log(np.sum(1.0 / (10.0 + np.arange(len(self.ranked))))))
        self.unigram = True
        self.rows = [(p, i, float(-np.log(10.0 + r) - total)) for r, (p, i, _) in enumerate(self.ranked)]
        self.ranked = self.rows
        return self

    def _read(self, m) -> None:
        norm, kind = m.normalizer_spec, m.trainer_spec.model_type
        if kind not in (1, 2) or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models of type unigram or BPE with identity normalisation and a leading mark are supported")
        if any(p.type == 4 for p in m.pieces):
            raise ValueError("models with user-defined symbols are not supported")
        self.unigram = kind == 1
        self.text = [p.piece for p in m.pieces]
        self.rows = [(p.piece, i, float(p.score)) for i, p in enumerate(m.pieces) if p.type == 1]
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == 2)
        self.bytes = [i for i, p in enumerate(m.pieces) if p.type == 6]
        self.ranked = sorted(self.rows, key=lambda p: -p[2])
        self.longest = max(len(p) for p, _, _ in self.rows)
        self.spelling = [bytes([self.bytes.index(i)]) if p.type == 6 else b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode() for i, p in enumerate(m.pieces)]

    def late(self) -> set[str]:
        """BPE: pieces that their own text comes to by a merge of a worse rank.

        Only such a piece can fit after its rank has passed: where no merge crosses its ends, its text is merged as it
        is alone, so by ranks up to its own, and once one has crossed them it never fits."""
        rank = {p: r for r, (p, _, _) in enumerate(self.ranked)}
        return {p for p, r in rank.items() if len(p) > 1 and _merges(p, rank, r)}

    def join_table(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of each code point, whether a piece has the two places side by side)."""
        chars = sorted({c for p, _, _ in self.rows for c in p})
        place = np.zeros(0x110000, np.uint16)
        place[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        spans = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        pairs = {(a, b) for p, _, _ in self.rows for a, b in zip(p, p[1:], strict=False)}
        for a, b in pairs:
            spans[place[ord(a)], place[ord(b)]] = True
        return place, spans


_tables: dict[int, tuple] = {}


class Units:
    """Units of many texts: code point ranges, their hashes, and which are single unknown characters."""

    def __init__(self, texts: list[str | None], pieces: Pieces, key: int, bits: int):
        C.trim()  # what the chunk before has left
        if key not in _tables:
            _tables[key] = pieces.join_table()
        place, spans = _tables[key]
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        self.marked = "".join(marked)
        sizes = [len(t) for t in marked]
        del marked
        self.x = np.frombuffer(self.marked.encode("utf-32-le"), np.uint32)
        self.offs = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        # by blocks: index arrays take eight bytes a character
        k, begin = np.empty(len(self.x), np.uint16), np.ones(len(self.x), bool)
        for at in range(0, len(k), C.BLOCK):
            k[at : at + C.BLOCK] = place[self.x[at : at + C.BLOCK]]
        for at in range(1, len(k), C.BLOCK):
            begin[at : at + C.BLOCK] = ~spans[k[at - 1 : min(at + C.BLOCK, len(k)) - 1], k[at : at + C.BLOCK]]
        begin[self.offs[:-1][self.offs[:-1] < len(k)]] = True
        self.starts = np.flatnonzero(begin)
        self.ends = np.append(self.starts[1:], len(k))[: len(self.starts)]
        self.first = np.searchsorted(self.starts, self.offs)
        self.unknown = k[self.starts] == 0
        del begin, k
        h, other = C.range_hashes(self.x.view(np.uint8), 4 * self.starts, 4 * self.ends, 2)
        order, run = C.sorted_runs(h, other)
        index = order[run]
        # distinct units by bucket, then by their first characters, so that their texts compress
        bucket = (h[index] >> np.uint64(64 - bits)).astype(np.int64)
        size = (self.ends - self.starts)[index]
        head = np.zeros(len(index), np.uint64)
        for i in range(4):
            at = np.minimum(self.starts[index] + i, max(0, len(self.x) - 1))
            head = head << np.uint64(16) | np.where(size > i, self.x[at] & np.uint32(0xFFFF), 0).astype(np.uint64)
        by = np.lexsort((head, bucket))
        self.index, place = index[by], np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.edges = np.searchsorted(bucket[by], np.arange((1 << bits) + 1))
        self.back = np.empty(len(h), np.int64)
        self.back[order] = place[C.run_ids(run, len(h))]
        # of the distinct units: whether the lattice gives the ids
        self.known = ~self.unknown[self.index] & (self.ends - self.starts <= LONGEST_UNIT)[self.index]

    def texts(self, at: np.ndarray) -> list[str]:
        """The distinct units at some places."""
        at = self.index[at]
        return [self.marked[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def _edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(u, size, edges): for each unit w its length and an edge (rank, i, l, ...) for each piece in it, by rank and place.

    ``ends`` and ``span`` are the bits of its two ends and of all its boundaries.  The words lie in partitions by u, so
    the grouping needs no further exchange.
    """
    spark = words.sparkSession
    late = set() if pieces.unigram else pieces.late()
    # scores are for Viterbi; merges need ranks only
    columns = "score" if pieces.unigram else "late" if late else ""
    table = spark.createDataFrame([(p, r, s, p in late) for r, (p, _, s) in enumerate(pieces.ranked)], "s string, rank int, score double, late boolean").select("s", "rank", *columns.split())
    if len(pieces.ranked) <= BROADCAST_PIECES:
        table = F.broadcast(table)
    # two plain explodes run as generated code; one over an array of structs would be interpreted
    found = words.select("u", "w", F.explode(F.expr("sequence(0, length(w) - 1)")).alias("i"))
    found = found.select("u", "w", "i", F.explode(F.expr(f"sequence(1, least({pieces.longest}, length(w) - i))")).alias("l"))
    found = found.select("u", "w", "i", "l", F.expr("substring(w, i + 1, l)").alias("s")).join(table, "s")
    edge = F.expr(f"struct(rank, i, l, {columns + ',' if columns else ''} shiftleft(1L, i) | shiftleft(1L, i + l) AS ends, shiftleft(shiftleft(1L, l + 1) - 1L, i) AS span)")
    grouped = found.groupBy("u").agg(F.any_value("w").alias("w"), F.sort_array(F.collect_list(edge)).alias("edges"))
    return grouped.select("u", F.length("w").alias("size"), "edges")


def _merged(lattice: DataFrame) -> DataFrame:
    """BPE: ranks of the pieces of each unit; the state of the fold holds the boundaries as bits of a long.

    The edges are bound to lambda variables: a column would be computed anew at every use inside a lambda."""
    fits = "(state & e.ends) = e.ends AND bit_count(state & e.span) = 3"
    begin = "shiftleft(1L, size + 1) - 1L"
    again = f"""aggregate(sequence(1, size - 1), {begin}, (state, n) -> coalesce(get(transform(slice(filter(merges, e -> {fits}), 1, 1), e -> state & (e.ends | ~e.span)), 0), state))"""
    once = f"aggregate(merges, {begin}, (state, e) -> IF({fits}, state & (e.ends | ~e.span), state))"
    fields = lattice.schema["edges"].dataType.elementType.fieldNames()
    state = f"IF(exists(merges, e -> e.late), {again}, {once})" if "late" in fields else once
    fold = f"""get(transform(array(edges), lattice -> get(transform(array(filter(lattice, e -> e.l > 1)), merges -> get(transform(array({state}),
        state -> transform(sort_array(transform(filter(lattice, e -> (state & e.span) = e.ends), e -> struct(e.i, e.rank))), p -> p.rank)), 0)), 0)), 0)"""
    first = "array(edges[0].rank)"
    return lattice.select("u", F.expr(f"IF(size = 1, {first}, {fold})").alias("ranks"))


def _viterbi(lattice: DataFrame) -> DataFrame:
    """Unigram: ranks of the pieces along each unit's best path; ties keep the edge that starts first."""
    back = """aggregate(sequence(1, size), struct(size AS at, CAST(array() AS array<int>) AS ranks),
        (s, n) -> IF(s.at <= 0, s, struct(best[s.at].back AS at, concat(array(best[s.at].rank), s.ranks) AS ranks)), s -> s.ranks)"""
    forward = f"""aggregate(sort_array(transform(edges, e -> struct(e.i + e.l AS j, e.i AS i, e.rank AS rank, e.score AS score))),
        transform(sequence(0, size), k -> struct(IF(k = 0, 0D, CAST(NULL AS DOUBLE)) AS score, -1 AS back, -1 AS rank)),
        (best, e) -> IF(best[e.i].score IS NULL OR best[e.j].score >= best[e.i].score + e.score, best,
            transform(best, (b, k) -> IF(k = e.j, struct(best[e.i].score + e.score AS score, e.i AS back, e.rank AS rank), b))),
        best -> {back})"""
    return lattice.select("u", F.expr(forward).alias("ranks"))


def _long_unit(unit: str, p: Pieces) -> np.ndarray:
    """Ids of a unit too long for the fold, whose cost grows with the square of the length, by the same rule."""
    ids = {piece: i for piece, i, _ in p.ranked}
    if p.unigram:
        scores = {piece: s for piece, _, s in p.ranked}
        best: list[tuple] = [(0.0, -1)] + [(-np.inf, -1)] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(max(0, j - p.longest), j):
                s = best[i][0] + scores.get(unit[i:j], -np.inf)
                if s > best[j][0]:
                    best[j] = (s, i)
        out, j = [], len(unit)
        while j > 0:
            out.append(ids[unit[best[j][1] : j]])
            j = best[j][1]
        return np.array(out[::-1], np.int32)
    ends = _merged_ends(unit, {piece: r for r, (piece, _, _) in enumerate(p.ranked)})[0]
    out, i = [], 0
    while i < len(unit):
        out.append(ids[unit[i : ends[i]]])
        i = ends[i]
    return np.array(out, np.int32)


def _merged_ends(unit: str, rank: dict[str, int]) -> tuple[list[int], int]:
    """(where the piece that begins at each character ends, the worst rank before the last merge) after all merges."""
    ends, back = list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))  # of the piece that begins here
    heap: list[tuple] = []
    worst = last = -1

    def offer(i: int) -> None:
        j = ends[i] if i >= 0 else len(unit)
        if j < len(unit) and (r := rank.get(unit[i : ends[j]])) is not None:
            heapq.heappush(heap, (r, i, j, ends[j]))

    for i in range(len(unit)):
        offer(i)
    while heap:
        r, i, j, k = heapq.heappop(heap)
        if ends[i] == j and ends[j] == k:
            worst, last = max(worst, last), r
            ends[i], ends[j] = k, -1
            if k < len(unit):
                back[k] = i
            offer(i)
            offer(back[i])
    return ends, worst


def _merges(piece: str, rank: dict[str, int], own: int) -> bool:
    """Whether the piece's text is merged to the piece, with a rank worse than its own on the way."""
    ends, worst = _merged_ends(piece, rank)
    return ends[0] == len(piece) and worst > own


def encode(docs: DataFrame, model: Pieces | str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), check: bool = False) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), with ``check`` round_trip (whether the ids decode to the text),
    then the columns in ``keep``."""
    pieces = model if isinstance(model, Pieces) else Pieces(model)
    spark = docs.sparkSession
    rows, size = C.corpus_size(docs, text_col)
    bits = C.bucket_bits(size // 40)
    shared = spark.sparkContext.broadcast(pieces)
    key = xxhash.xxh3_64_intdigest(repr(pieces.rows).encode())
    more = [c for c in keep if c != text_col]  # the text itself is packed once
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *([F.struct(*[F.col(c) for c in more]).alias("_keep")] if more else []))

    def chunks(batches):
        for batch in batches:
            for t in C.slices(batch, "_text", CHUNK_BYTES):
                t = t.combine_chunks()
                data, offs = C.text_bytes(t["_text"])
                ids = np.asarray(t["_id"].combine_chunks().fill_null(-1))
                x = xxhash.xxh3_64(data.tobytes())
                x.update(offs.tobytes())
                x.update(ids.tobytes())
                yield x.intdigest() - (1 << 63), t

    def pack(batches):
        for chunk, t in chunks(batches):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as w:
                w.write_table(t)
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int64()), "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})

    def ask(batches):
        for chunk, t in chunks(batches):
            u = Units(t["_text"].to_pylist(), shared.value, key, bits)
            found = []
            for b in np.flatnonzero(np.diff(u.edges)):
                at = np.arange(u.edges[b], u.edges[b + 1])[u.known[u.edges[b] : u.edges[b + 1]]]
                lens = (u.ends - u.starts)[u.index[at]].astype(np.uint32)
                found.append((int(b), chunk, len(at), _pack(lens.tobytes() + "".join(u.texts(at)).encode())))
            yield from _rows(found).to_batches()

    def asked_units(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """(hashes, second hashes, ends, joined text) of the units that a chunk asks for in one bucket."""
        raw = _unpack(body)
        end = np.cumsum(np.frombuffer(raw, np.uint32, n), dtype=np.int64)
        text = raw[4 * n :].decode()
        begin = np.concatenate((np.zeros(1, np.int64), end[:-1])) if n else end
        return *C.range_hashes(np.frombuffer(text.encode("utf-32-le"), np.uint8), 4 * begin, 4 * end, 2), end, text

    def numbered(sent: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each unit asked for, an entry of each number): a bucket's units by their hashes, in whatever order
        the chunks came, so both reducers of a bucket, run again or not, number them alike."""
        order, run = C.sorted_runs(*(np.concatenate([x[k] for x in sent]) for k in (0, 1)))
        number = np.empty(len(order), np.int64)
        number[order] = C.run_ids(run, len(order))
        return number, order[run]

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        C.trim()
        sent = [asked_units(n, body) for n, body in zip(table["n"].to_pylist(), table["body"].to_pylist(), strict=True)]
        number, entry = numbered(sent)
        first = np.sort(entry)
        from_ = np.cumsum([0, *(len(x[0]) for x in sent)])
        words = []
        for (_, _, end, text), lo, hi in zip(sent, from_[:-1], from_[1:], strict=True):
            at = first[np.searchsorted(first, lo) : np.searchsorted(first, hi)] - lo
            words += [text[a:b] for a, b in zip(np.where(at > 0, end[at - 1], 0).tolist(), end[at].tolist(), strict=True)]
        return pa.table({"u": pa.array((key[0].as_py() << NUMBER_BITS) + number[first]), "w": pa.array(words, pa.string())})

    def answer(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        C.trim()
        sent = [asked_units(n, body)[:2] for n, body in zip(left["n"].to_pylist(), left["body"].to_pylist(), strict=True)]
        number, entry = numbered(sent)
        u = right["u"].to_numpy() & ((1 << NUMBER_BITS) - 1)
        place = np.argsort(u)
        if not np.array_equal(u[place], np.arange(len(entry))):
            raise RuntimeError("units of a bucket were lost; the rows of docs must come in the same order each time")
        ranks = right["ranks"].combine_chunks()
        by_rank = np.array([i for _, i, _ in shared.value.ranked], np.int32)
        flat, offs = by_rank[np.asarray(ranks.flatten(), np.int64)], np.asarray(ranks.offsets, np.int64)
        offs = offs - offs[0] if len(offs) else np.zeros(1, np.int64)
        found, done = [], 0
        for chunk, n in zip(left["chunk"].to_pylist(), left["n"].to_pylist(), strict=True):
            at = place[number[done : done + n]]
            done += n
            count = offs[at + 1] - offs[at] if n else at
            ids = flat[_ragged(offs[at], count)].astype(np.int32)
            found.append((key[0].as_py(), chunk, n, _pack(count.astype(np.uint16).tobytes() + ids.tobytes())))
        return _rows(found)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        p = shared.value
        answers = {b: (n, raw) for b, n, raw in zip(right["bucket"].to_pylist(), right["n"].to_pylist(), right["body"].to_pylist(), strict=True)}
        out = []
        for raw in left["rows"].to_pylist():
            t = pa.ipc.open_stream(raw).read_all()
            u = Units(t["_text"].to_pylist(), p, key, bits)
            count, flat = np.zeros(len(u.index), np.int64), []
            odd = np.flatnonzero(~u.known)
            own_ids = {i: _spell(w, p) if u.unknown[u.index[i]] else _long_unit(w, p) for i, w in zip(odd, u.texts(odd), strict=True)}
            for b in np.flatnonzero(np.diff(u.edges)):
                at = np.arange(u.edges[b], u.edges[b + 1])
                n, body = answers[int(b)]
                body = _unpack(body)
                if n != int(u.known[at].sum()):
                    raise RuntimeError("the rows of docs came in another order the second time; write them to a table first")
                some = np.frombuffer(body, np.uint16, n).astype(np.int64)
                ids = np.frombuffer(body[2 * n :], np.int32)
                count[at[u.known[at]]] = some
                odd = at[~u.known[at]]
                if len(odd):
                    count[odd] = [len(own_ids[i]) for i in odd]
                    mine = np.empty(int(count[at].sum()), np.int32)
                    own = np.repeat(u.known[at], count[at])
                    mine[own] = ids
                    mine[~own] = np.concatenate([own_ids[i] for i in odd])
                    ids = mine
                flat.append(ids)
            flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            begin = np.cumsum(count) - count
            ids = flat[_ragged(begin[u.back], count[u.back])]
            ends = np.concatenate(([0], np.cumsum(count[u.back])))[u.first]
            cols = [t["_id"].combine_chunks(), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
            if check:
                texts = t["_text"].to_pylist()
                cols.append(pa.array([(a or "") == b for a, b in zip(texts, spelt(ids, ends, p.spelling), strict=True)], pa.bool_()))
            names = [*(["_text"] if text_col in keep else []), *(["_keep"] if more else [])]
            out.append(pa.Table.from_arrays(cols + [t[c].combine_chunks() for c in names], names=["doc_id", "ids", *(["round_trip"] if check else []), *names]))
        if not out:
            raise RuntimeError("the rows of docs came in another order the second time; write them to a table first")
        return pa.concat_tables(out)

    asked = texts.select("_id", "_text").mapInArrow(ask, ASK_DDL)
    words = asked.groupBy("bucket").applyInArrow(distinct, "u long, w string")
    # few enough words in a partition that their edges are grouped in memory
    words = words.repartition(max(8, size // 200 // 15_000), "u")
    lattice = _edges(words, pieces)
    known = (_viterbi if pieces.unigram else _merged)(lattice).withColumn("bucket", F.shiftright("u", NUMBER_BITS).cast("int"))
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(answer, ASK_DDL)
    kept = ", round_trip boolean" if check else ""
    kept += ", _text string" if text_col in keep else ""
    kept += f", _keep {texts.schema['_keep'].dataType.simpleString()}" if more else ""
    packed = texts.mapInArrow(pack, "chunk long, rows binary")
    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, f"doc_id long, ids array<int>{kept}")
    return out.select("doc_id", "ids", *(["round_trip"] if check else []), *[F.col("_text").alias(c) if c == text_col else F.col("_keep")[c].alias(c) for c in keep])


ASK = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n", pa.int32()), ("body", pa.binary())])
ASK_DDL = "bucket int, chunk long, n int, body binary"


def _rows(found: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 4, ASK, strict=True)], schema=ASK)


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def _unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... of count[0] numbers, then of the next."""
    count = count.astype(np.int64)
    total = int(count.sum())
    shift = np.repeat(begin - (np.cumsum(count) - count), count)
    return np.arange(total) + shift


def _spell(char: str, p: Pieces) -> np.ndarray:
    return np.array([p.bytes[b] for b in char.encode()] if p.bytes else [p.unknown], np.int32)


def spelt(ids: np.ndarray, ends: np.ndarray, spelling: list[bytes]):
    """Yield the text of each run of ids, without the leading mark."""
    flat = np.frombuffer(b"".join(spelling), np.uint8)
    count = np.array([len(x) for x in spelling], np.int64)
    begin = np.cumsum(count) - count
    if len(ids) and (ids.min() < 0 or ids.max() >= len(count)):
        raise ValueError("an id is outside the model")
    at = 0
    while at < len(ends) - 1:  # some hundred thousand ids at a time
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + 300_000, "right")) - 1)
        some = ids[ends[at] : ends[end]]
        raw = flat[_ragged(begin[some], count[some])].tobytes()
        cut = np.concatenate(([0], np.cumsum(count[some])))[ends[at : end + 1] - ends[at]]
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            text = raw[a:b].decode("utf-8", "replace")
            yield text[1:] if text[:1] == " " else text
        at = end


def decode(rows: DataFrame, model: Pieces | str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with ``out_col``: the text that the ids spell (null ids: the empty text; ids outside the model raise).
    Bytes that are not UTF-8 become replacement characters."""
    pieces = model if isinstance(model, Pieces) else Pieces(model)
    shared = rows.sparkSession.sparkContext.broadcast(pieces.spelling)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != out_col) + f", `{out_col}` string"

    def spell(batches):
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            ids = batch.column(ids_col)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0), np.int64))))
            t = pa.Table.from_batches([batch])
            t = t.drop_columns([out_col]) if out_col in t.column_names else t
            yield from t.append_column(out_col, pa.array(spelt(np.asarray(ids.flatten()), ends, shared.value), pa.string())).to_batches()

    return rows.mapInArrow(spell, ddl)

