"""Language identification by rank-order profiles.

A profile is the ``size`` most frequent letter n-grams (1 to 3 letters, lower case, with a mark at either end of a
word), most frequent first and ties in code-point order.  Each language's profile comes from all training texts; a
text goes to the language whose profile is out of place least: the sum over the text's own profile of the rank
differences, ``size`` for an n-gram that the language lacks.

Counting is done per chunk of texts by sorting n-gram codes; per language the chunks' counts are added with map-side
combine.  Only the profiles (languages times ``size`` rows) reach the driver.

Defined cases: null texts, texts without a letter, and all texts if nothing was learned: ``und`` with score 0; ties
go to the language first in order; null languages and ids teach nothing only as the caller's training rows say;
repeated rows count each.  The score is one less the distance over the largest possible one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _chunks as C

MARK = 1
#: Text bytes taken at once: a letter has three n-grams of eight bytes, sorted and counted.
SLICE = 1 << 20
_lower: dict[int, int] = {}


def _letter(cp: int) -> int:
    """The lower-case letter of a code point, or MARK."""
    if cp not in _lower:
        c = chr(cp)
        low = c.lower()
        _lower[cp] = (ord(low) if len(low) == 1 else cp) if c.isalpha() else MARK
    return _lower[cp]


class Grams:
    """Sorted n-grams of many texts as codes of a compact alphabet."""

    def __init__(self, texts, groups: np.ndarray | None = None):
        data, offs = C.text_bytes(texts)
        data = data.tobytes()
        wide = [data[a:b].decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offs[:-1], offs[1:], strict=True)]
        x = np.frombuffer(b"\x20\0\0\0" + b"".join(t + b"\x20\0\0\0" for t in wide), np.uint32)
        group = np.repeat(np.arange(len(wide)) if groups is None else groups, [len(t) // 4 + 1 for t in wide])
        group = np.concatenate((group[:1], group)).astype(np.uint64)
        # the compact alphabet keeps the order of code points; place 0 is the mark
        seen = np.flatnonzero(np.bincount(x, minlength=1))
        letters = np.array([_letter(int(c)) for c in seen], np.int64)
        self.alphabet = np.unique(np.append(letters, MARK))
        table = np.zeros(int(seen.max()) + 1, np.uint64)
        table[seen] = np.searchsorted(self.alphabet, letters)
        x = table[x]
        self.bits = max(1, int(len(self.alphabet) - 1).bit_length())
        self.total = 3 * self.bits + 2
        b = np.uint64(self.bits)
        one = x[1:][x[1:] > 0]
        two = (x[:-1] << b | x[1:]) + np.uint64(1 << 3 * self.bits)
        has2 = (x[:-1] > 0) | (x[1:] > 0)
        three = (x[:-2] << b + b | x[1:-1] << b | x[2:]) + np.uint64(2 << 3 * self.bits)
        has3 = x[1:-1] > 0
        own = [group[1:][x[1:] > 0], group[1:][has2], group[2:][has3]]
        t = np.uint64(self.total)
        code = np.concatenate([g << t | c for g, c in zip(own, (one, two[has2], three[has3]), strict=True)])
        code.sort()
        begin = C.runs(code)
        self.count = np.diff(np.append(begin, len(code)))
        code = code[begin]
        self.group, self.code = (code >> t).astype(np.int64), code & np.uint64((1 << self.total) - 1)

    def names(self, code: np.ndarray) -> np.ndarray:
        """Codes that mean the same in every chunk: the code points side by side, 21 bits each."""
        b, rest = np.uint64(self.bits), code & np.uint64((1 << 3 * self.bits) - 1)
        kind = code >> np.uint64(3 * self.bits)
        low = np.uint64((1 << self.bits) - 1)
        cp = [self.alphabet[(rest >> s & low).astype(np.int64)].astype(np.uint64) for s in (b + b, b, np.uint64(0))]
        return np.where(kind == 2, cp[0] << np.uint64(42), 0).astype(np.uint64) | np.where(kind > 0, cp[1] << np.uint64(21), 0).astype(np.uint64) | cp[2]


def _fitting(table: pa.Table, text: str):
    """Cuts of a table small enough that text and n-gram fit one 64-bit code."""
    for at in range(0, table.num_rows, 2048):
        yield table.slice(at, 2048)


def profiles(docs: DataFrame, text_col: str, lang_col: str, size: int) -> dict[str, np.ndarray]:
    """The n-gram names of each language's profile, by rank."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")

    def count(batches):
        for batch in batches:
            for t in C.slices(batch, "text", SLICE):
                for t in _fitting(t, "text"):
                    lang = t["lang"].combine_chunks().dictionary_encode()
                    g = Grams(t["text"], lang.indices.to_numpy())
                    names = lang.dictionary.take(pa.array(g.group))
                    yield pa.RecordBatch.from_arrays([names, pa.array(g.names(g.code).view(np.int64)), pa.array(g.count, pa.int64())], ["lang", "gram", "n"])

    total = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    found: dict[str, list] = {}
    for lang, gram, at in total.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "gram", "rank").collect():
        found.setdefault(lang, []).append((at, gram))
    return {lang: np.array([g for _, g in sorted(x)], np.int64).view(np.uint64) for lang, x in sorted(found.items())}


class Detector:
    def __init__(self, known: dict[str, np.ndarray], size: int):
        self.size, self.langs = size, list(known)
        self.grams = np.unique(np.concatenate([np.zeros(0, np.uint64), *known.values()]))
        self.rank = np.full((len(self.grams) + 1, len(known)), -1, np.int32)
        for i, x in enumerate(known.values()):
            self.rank[np.searchsorted(self.grams, x), i] = np.arange(len(x))

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        g, n = Grams(texts), len(texts)
        order = np.argsort(g.group << 32 | (1 << 32) - 1 - np.minimum(g.count, (1 << 32) - 1), kind="stable")
        group = g.group[order]
        begin = C.runs(group)
        place = np.arange(len(group)) - np.repeat(begin, np.diff(np.append(begin, len(group))))
        top = place < self.size
        group, place, name = group[top], place[top], g.names(g.code[order][top])
        langs, score = ["und"] * n, np.zeros(n)
        if not len(group) or not self.langs:
            return langs, score
        at = np.searchsorted(self.grams, name)
        at[self.grams[np.minimum(at, len(self.grams) - 1)] != name] = len(self.grams)
        begin = C.runs(group)
        out = np.stack([np.add.reduceat(np.where(self.rank[at, i] < 0, self.size, np.abs(self.rank[at, i] - place)), begin) for i in range(len(self.langs))])
        best = out.argmin(axis=0)
        worst = self.size * np.diff(np.append(begin, len(group)))
        for d, i, s in zip(group[begin], best, 1 - out.min(axis=0) / worst, strict=True):
            langs[d], score[d] = self.langs[i], s
        return langs, score


def language_id(docs: DataFrame, learn_on: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = 300) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Only rows where ``learn_on`` holds teach (null:
    they do)."""
    learns = F.coalesce(learn_on, F.lit(True))
    model = docs.sparkSession.sparkContext.broadcast(Detector(profiles(docs.filter(learns), text_col, lang_col, size), size))

    def predict(batches):
        for batch in batches:
            for t in C.slices(batch, "text", SLICE):
                for t in _fitting(t, "text"):
                    langs, score = model.value.predict(t["text"])
                    yield from t.drop_columns(["text"]).append_column("lang_pred", pa.array(langs, pa.string())).append_column("score", pa.array(score)).to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~learns).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
