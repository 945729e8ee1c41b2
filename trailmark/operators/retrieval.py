"""Encoding of decision states, retrieval of similar ones, and candidates for the next place."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RetrievalConfig
from ..functions import vectors as vec
from ..functions.geo import EARTH_KM
from ..functions.timefn import bin_hour, cyclic_hour
from .preprocess import held

CONTEXT = (("curr_density_count", 0.0), ("curr_node_degree", 0.0))
PREFIX = (("prefix_elapsed_min", 0.0), ("prefix_repeat_ratio", 0.0), ("prefix_unique_poi_count", 1.0), ("prefix_unique_category_count", 1.0))


def _number(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


@dataclass(frozen=True)
class StateEncoder:
    """Scales (mean, deviation) of the numeric blocks and the category vocabulary, from the training states."""

    scales: dict[str, list[tuple[float, float]]]
    categories: tuple[str, ...]
    cfg: RetrievalConfig

    @staticmethod
    def blocks(df: DataFrame, cfg: RetrievalConfig) -> dict[str, list[Column]]:
        movement = []
        for k in range(1, cfg.recent_k + 1):
            d, g, b = (F.col(f"prev{k}_{c}") for c in ("distance_m", "gap_s", "bearing_deg"))
            # a missing bearing has neither sine nor cosine, for cases and queries alike
            movement += [F.coalesce(F.log1p(d), F.lit(0.0)), F.coalesce(F.log1p(g), F.lit(0.0)), F.coalesce(F.sin(F.radians(b)), F.lit(0.0)), F.coalesce(F.cos(F.radians(b)), F.lit(0.0))]
        return {"context": [_number(df, c, d) for c, d in CONTEXT], "movement": movement, "prefix": [_number(df, c, d) for c, d in PREFIX]}

    @classmethod
    def fit(cls, train: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> StateEncoder:
        """One aggregate for the scales (population deviation, 0 counts as 1) and one for the vocabulary."""
        blocks = cls.blocks(train, cfg)
        flat = [(name, c) for name, cols in blocks.items() for c in cols]
        row = train.agg(*[f(c).alias(f"{f.__name__}{i}") for i, (_, c) in enumerate(flat) for f in (F.avg, F.stddev_pop)]).first()
        scales: dict[str, list] = {name: [] for name in blocks}
        for i, (name, _) in enumerate(flat):
            mean, std = row[f"avg{i}"], row[f"stddev_pop{i}"]
            scales[name].append((float(mean or 0.0), float(std) if std else 1.0))
        words = train.select("current_category").filter("current_category is not null").distinct().orderBy("current_category").collect()
        return cls(scales, tuple(r[0] for r in words), cfg)

    def transform(self, df: DataFrame, out: str = "vector") -> DataFrame:
        """df with the weighted blocks side by side, each of length 1 before its weight."""
        c = self.cfg
        at = F.col("current_timestamp")
        hour = F.coalesce(F.hour(at) + F.minute(at) / 60.0, bin_hour("current_time_bin"))
        parts = [vec.scaled(vec.unit(F.array(*cyclic_hour(hour))), c.temporal)]
        for (name, cols), weight in zip(self.blocks(df, c).items(), (c.local_context, c.movement, c.prefix), strict=True):
            z = [(x - F.lit(m)) / F.lit(s) for x, (m, s) in zip(cols, self.scales[name], strict=True)]
            parts.append(vec.scaled(vec.unit(F.array(*z)), weight))
        if self.categories:
            hot = F.transform(F.array(*[F.lit(x) for x in self.categories]), lambda x: F.coalesce((x == F.col("current_category")).cast("double"), F.lit(0.0)))
            parts.append(vec.scaled(vec.unit(hot), c.category))
        return df.withColumn(out, F.concat(*parts))


def index_of(states: DataFrame, encoder: StateEncoder, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cases for retrieval: session, decision_index, unit vector, position, next place and category, prototype."""
    rows = encoder.transform(states, "_v")
    extra = [c for c in ("proto_prototype_id", *keep) if c in rows.columns]
    return rows.select("SessionId", "decision_index", vec.unit("_v").alias("vector"), "curr_lat", "curr_lon", "next_POIId", "next_category", *extra)


#: Numbers in the vectors of a block of cases, queries of a band (what one task compares), rows of the sample that
#: blocks are drawn from, and blocks drawn at most (larger ones are cut by a hash).
BLOCK, BAND, SAMPLE, MOST = 1 << 21, 65_536, 8192, 1024
#: Queries and cases that are compared at once.
_ROWS, _COLUMNS = 256, 4096
#: Where queries would visit more cells than FEW, a part of the cases (one in PART) of HOMES cells raises their bars first.
FEW, PART, HOMES = 4, 4, 3
#: Scores that agree to so many places are tied, so that rounding decides nothing.
PLACES = 9


def _near(at: np.ndarray, to: np.ndarray, tau: float) -> np.ndarray:
    """exp(-distance / tau) of each row of ``at`` to each of ``to`` (degrees); a missing position is far from everything."""
    la, lb = np.radians(at[:, :1]), np.radians(to[:, 0])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(to[:, 1] - at[:, 1:]) / 2) ** 2
    return np.nan_to_num(np.exp(-2 * 1000 * EARTH_KM * np.arctan2(np.sqrt(h), np.sqrt(np.maximum(0.0, 1 - h))) / tau))


def _nearest_in(at: np.ndarray, box: np.ndarray, tau: float) -> np.ndarray:
    """No less than exp(-distance / tau) to any position in each box (least and largest latitude and longitude)."""
    south, north, west, east = box.T
    up = np.radians(np.maximum(0.0, np.maximum(south - at[:, :1], at[:, :1] - north)))
    past = np.mod(at[:, 1:] - west, 360.0)
    aside = np.where(past <= east - west, 0.0, np.minimum(past - (east - west), 360.0 - past))
    across = np.arcsin(np.cos(np.radians(at[:, :1])) * np.sin(np.radians(np.clip(aside, 0.0, 90.0))))
    return np.nan_to_num(np.exp(-1000 * EARTH_KM * np.maximum(up, across) / tau) * (1 + 1e-9))


def _centres(x: np.ndarray, parts: int) -> np.ndarray:
    """Means of at most ``parts`` groups of rows: the largest group is halved by two means until there are so many."""
    groups, done = [np.arange(len(x))], []
    while groups and len(groups) + len(done) < parts:
        own = groups.pop(max(range(len(groups)), key=lambda i: len(groups[i])))
        y = x[own]
        one = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        two = y[((y - one) ** 2).sum(axis=1).argmax()]
        for _ in range(6):
            side = ((y - one) ** 2).sum(axis=1) < ((y - two) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            one, two = y[side].mean(axis=0), y[~side].mean(axis=0)
        if side.all() or not side.any():
            done.append(own)
        else:
            groups += [own[side], own[~side]]
    return np.array([x[g].mean(axis=0) for g in (*groups, *done)])


@dataclass
class _Cells:
    """Cells of cases: centres from a sample, and figures of all cases of each cell that bound what it can score."""

    cfg: RetrievalConfig
    by_cosine: bool
    keep: int
    vectors: np.ndarray  # of the sample
    at: np.ndarray
    sessions: np.ndarray
    groups: np.ndarray
    centres: np.ndarray | None = None
    figures: np.ndarray | None = None  # key, rows, box, farthest from the centre, widest angle to it, longest, least and largest of each number
    of_group: np.ndarray | None = None

    def features(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What cells are drawn by: vectors, and positions in units of tau where they count."""
        if self.by_cosine:
            return v
        metres = np.nan_to_num(at) * 1000 * EARTH_KM * math.pi / 180 / self.cfg.tau_m
        metres[:, 1] *= np.cos(np.radians(np.nan_to_num(at[:, 0])))
        return np.concatenate((v, metres), axis=1)

    def cell(self, v: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(self.centres) < 2:
            return np.zeros(len(v), np.int64)
        x = self.features(v, at)
        return np.argmax(x @ self.centres.T - (self.centres**2).sum(axis=1) / 2, axis=1)

    def middle(self, cell: np.ndarray) -> np.ndarray:
        return self.centres[cell][:, : self.vectors.shape[1]]

    def towards(self, cell: np.ndarray) -> np.ndarray:
        """Directions of the centres."""
        m = self.middle(cell)
        return m / np.maximum(np.sqrt((m**2).sum(axis=-1, keepdims=True)), 1e-300)

    def wholes(self, cosine: np.ndarray, spatial: np.ndarray) -> np.ndarray:
        return cosine if self.by_cosine else self.cfg.alpha * spatial + (1 - self.cfg.alpha) * cosine

    def bounds(self, v: np.ndarray, at: np.ndarray, groups: list | None) -> np.ndarray:
        """No less than what a case of each cell scores: ball, cap and box of its vectors, box of its positions."""
        f = self.figures
        d = v.shape[1]
        cell, length = f[:, 0].astype(np.int64) % len(self.centres), np.sqrt((v**2).sum(axis=1))[:, None]
        ball = v @ self.middle(cell).T + length * f[:, 6]
        away = np.arccos(np.clip(v @ self.towards(cell).T / np.maximum(length, 1e-300), -1, 1)) - f[:, 7]
        cap = length * f[:, 8] * np.maximum(np.cos(np.maximum(away, 0)), 0) + 1e-9
        box = np.maximum(v, 0) @ f[:, 9 + d :].T + np.minimum(v, 0) @ f[:, 9 : 9 + d].T
        most = self.wholes(np.minimum(np.minimum(ball, cap), box), np.zeros((1, 1)) if self.by_cosine else _nearest_in(at, f[:, 2:6], self.cfg.tau_m))
        if groups is not None:
            most[~np.array([np.isin(self.of_group, _numbers(g)) for g in groups]).reshape(most.shape)] = -np.inf
        return most

    def reached(self, v: np.ndarray, at: np.ndarray, sessions: np.ndarray, groups: list | None) -> np.ndarray:
        """A score that the last of the best of each query reaches or passes, as the sample shows."""
        own, which = np.unique(self.at, axis=0, return_inverse=True)
        reached = self.wholes(v @ self.vectors.T, np.zeros((1, 1)) if self.by_cosine else _near(at, own, self.cfg.tau_m)[:, which.ravel()])
        reached[sessions[:, None] == self.sessions[None, :]] = -np.inf
        if groups is not None:
            reached[~np.array([np.isin(self.groups, _numbers(g)) for g in groups]).reshape(reached.shape)] = -np.inf
        return np.partition(reached, -self.keep, axis=1)[:, -self.keep] if reached.shape[1] >= self.keep else np.full(len(v), -np.inf)

    def wanted(self, v: np.ndarray, at: np.ndarray, sessions: np.ndarray, groups: list | None, bar: np.ndarray | None = None, home: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(a score that the last of the best reaches or passes, the cells that can hold one of the best) of each query;
        the score by the sample where none is given, and with ``home`` a few of the cells."""
        bar = self.reached(v, at, sessions, groups) if bar is None else bar
        most = self.bounds(v, at, groups)
        found = (most >= bar[:, None] - 1e-8) & (most > -np.inf)
        return bar, found & self.home(v, most) if home else found

    def home(self, v: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The cells that most likely hold the best: those with the nearest centres, or by the bounds."""
        if self.by_cosine:
            near = v @ self.middle(self.figures[:, 0].astype(np.int64) % len(self.centres)).T
            most = np.where(most > -np.inf, near, -np.inf)
        out = np.zeros(most.shape, bool)
        np.put_along_axis(out, np.argsort(-most, axis=1, kind="stable")[:, :HOMES], True, axis=1)
        return out & (most > -np.inf)


def _numbers(group) -> np.ndarray:
    return np.array(group if group is not None else [], np.float64)


def _of(batch, side: str = "") -> tuple[np.ndarray, np.ndarray]:
    return _matrix(batch.column(f"{side}vector")), np.stack([batch.column(f"{side}{x}").to_numpy(zero_copy_only=False).astype(np.float64) for x in ("lat", "lon")], axis=1)


def _drawn(cases: DataFrame, n: int, cfg: RetrievalConfig, keep: int, by_cosine: bool) -> _Cells:
    """The cells of the cases: centres on the driver from a sample by a hash, figures in one pass over all cases."""
    spark = cases.sparkSession
    part = F.pmod(F.xxhash64("SessionId", "decision_index", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(1, n)) * (1 << 30))
    sample = cases.filter(part).limit(4 * SAMPLE).toArrow()
    v, at = _of(sample)
    cells = _Cells(cfg, by_cosine, keep, v, at, sample["SessionId"].to_numpy(), sample["group"].to_numpy())
    rows = max(_COLUMNS, BLOCK // max(1, v.shape[1]))
    cells.centres = _centres(cells.features(v, at), min(MOST, math.ceil(2 * n / rows))) if n > rows and len(v) else np.zeros((1, v.shape[1] + 2))
    model, d = spark.sparkContext.broadcast(cells), v.shape[1]

    def added(tables: list) -> np.ndarray:
        x = np.concatenate(tables)
        x = x[np.argsort(x[:, 0], kind="stable")]
        at = np.flatnonzero(np.r_[True, np.diff(x[:, 0]) > 0])
        out = x[at]
        out[:, 1] = np.add.reduceat(x[:, 1], at)
        least = [2, 4, *range(9, 9 + d)]
        out[:, least] = np.fmin.reduceat(x[:, least], at, axis=0)
        most = [3, 5, 6, 7, 8, *range(9 + d, 9 + 2 * d)]
        out[:, most] = np.fmax.reduceat(x[:, most], at, axis=0)
        return out

    def seen(batches):
        tables = []
        for batch in batches:
            if not batch.num_rows:
                continue
            v, at = _of(batch)
            cell = model.value.cell(v, at)
            far = np.sqrt(((v - model.value.middle(cell)) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
            key = batch.column("group").to_numpy() * len(model.value.centres) + cell
            long = np.sqrt((v**2).sum(axis=1)) * (1 + 1e-9)
            wide = np.arccos(np.clip((v * model.value.towards(cell)).sum(axis=1) / np.maximum(long, 1e-300), -1, 1)) + 1e-7
            tables = [added([*tables, np.column_stack((key, np.ones(len(v)), at[:, [0, 0, 1, 1]], far, wide, long, v, v))])]
        if tables:
            yield pa.RecordBatch.from_pydict({"key": tables[0][:, 0].astype(np.int64), "figures": pa.array(tables[0].tolist(), pa.list_(pa.float64()))})

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"figures": pa.array(added([np.array(table["figures"].to_pylist())]).tolist(), pa.list_(pa.float64()))})

    found = cases.mapInArrow(seen, "key long, figures array<double>").groupBy("key").applyInArrow(merged, "figures array<double>").toArrow()
    cells.figures = _matrix(found["figures"]) if found.num_rows else np.zeros((0, 9 + 2 * d))
    cells.figures = cells.figures[np.argsort(cells.figures[:, 0])]
    cells.of_group = np.floor_divide(cells.figures[:, 0], len(cells.centres))
    return cells


def _search(queries: DataFrame, cases: DataFrame, n: int, cfg: RetrievalConfig, keep: int, by_cosine: bool, routed: bool = False) -> DataFrame:
    """The best ``keep`` cases of every block that a query visits: those that can hold one of its best ``keep``.  Where
    ``routed``, queries have _groups, and a case counts if its prototype is one of them."""
    spark = cases.sparkSession
    kinds = {"query": queries.schema["query"], "case_session": cases.schema["SessionId"], "case_index": cases.schema["decision_index"], "next_POIId": cases.schema["next_POIId"], "next_category": cases.schema["next_category"]}
    ddl = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in kinds.items()) + ", spatial_score double, cosine_score double, retrieval_score double"
    group = F.coalesce(F.col("proto_prototype_id").cast("long"), F.lit(-1)) if routed else F.lit(0).cast("long")
    cases = cases.select("SessionId", "decision_index", "vector", F.col("curr_lat").alias("lat"), F.col("curr_lon").alias("lon"), "next_POIId", "next_category", group.alias("group"))
    cells = _drawn(cases, n, cfg, keep, by_cosine)
    model = spark.sparkContext.broadcast(cells)

    def visits(home: bool):
        def of(batches):
            for batch in batches:
                v, at = _of(batch, "q_")
                bars, keys = [], []
                for lo in range(0, len(v), _ROWS):
                    some = slice(lo, lo + _ROWS)
                    groups = batch.column("_groups").slice(lo, _ROWS).to_pylist() if routed else None
                    if not len(model.value.figures):
                        bar, open_ = np.full(len(v[some]), -np.inf), np.zeros((len(v[some]), 0), bool)
                    else:
                        known = batch.column("bar").to_numpy()[some] if "bar" in batch.schema.names else None
                        bar, open_ = model.value.wanted(v[some], at[some], batch.column("q_session").to_numpy()[some], groups, known, home)
                    bars += bar.tolist()
                    keys += [model.value.figures[row, 0].astype(np.int64).tolist() for row in open_]
                kept = [c for c in batch.schema.names if c not in ("bar", "keys")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bars, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], [*kept, "bar", "keys"])

        return of

    asked = queries.select("query", F.col("SessionId").alias("q_session"), F.col("vector").alias("q_vector"), F.col("curr_lat").alias("q_lat"), F.col("curr_lon").alias("q_lon"), *(["_groups"] if routed else []))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields) + ", bar double, keys array<bigint>"
    asked = held(asked.mapInArrow(visits(False), fields))
    n_queries, n_visits = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    if n_visits > FEW * n_queries:
        some = cases.filter(F.pmod(F.xxhash64("SessionId", "decision_index", F.lit(11)), F.lit(PART)) == 0)
        near = _visited(asked.mapInArrow(visits(True), fields), some, cells, model, kinds, ddl)
        w = Window.partitionBy("query").orderBy(F.desc("_score"))
        last = near.select("query", F.col("cosine_score" if by_cosine else "retrieval_score").alias("_score")).withColumn("_r", F.row_number().over(w))
        last = last.filter(F.col("_r") == keep).select("query", (F.col("_score") - 1e-8).alias("_bar"))
        wide = asked
        raised = asked.join(last, "query", "left").withColumn("bar", F.greatest("bar", "_bar")).drop("_bar").select(*asked.columns)
        asked = held(raised.mapInArrow(visits(False), fields))
        asked.count()
        wide.unpersist()
    return _visited(asked, cases, cells, model, kinds, ddl)


def _visited(asked: DataFrame, cases: DataFrame, cells: _Cells, model, kinds: dict, ddl: str) -> DataFrame:
    """The best of the cells that queries visit: asked has their keys, model the cells as a broadcast."""
    spark, cfg, keep, by_cosine = cases.sparkSession, cells.cfg, cells.keep, cells.by_cosine
    asked = asked.drop("_groups")
    asking = dict(asked.select(F.explode("keys").alias("k")).groupBy("k").count().collect())  # a row a cell at most

    rows = max(_COLUMNS, BLOCK // max(1, cells.vectors.shape[1]))
    blocks = {int(f[0]): max(1, math.ceil(f[1] / rows)) for f in cells.figures if f[0] in asking}
    shape = {k: (b, max(1, math.ceil(asking[k] / BAND))) for k, b in blocks.items()}
    shapes = spark.sparkContext.broadcast(shape)

    def placed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v, at = _of(batch)
            key = batch.column("group").to_numpy() * len(model.value.centres) + model.value.cell(v, at)
            in_use = np.flatnonzero(np.isin(key, list(shapes.value)))
            if not len(in_use):
                continue
            parts, bands = np.array([shapes.value[k] for k in key[in_use].tolist()], np.int64).T
            drawn = batch.column("_h").to_numpy()[in_use] % parts
            again = np.repeat(np.arange(len(in_use)), bands)
            band = np.arange(len(again)) - np.repeat(np.cumsum(bands) - bands, bands)
            kept = [c for c in batch.schema.names if c not in ("_h", "group")]
            own = batch.take(pa.array(in_use[again]))
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), pa.array(key[in_use][again]), pa.array(drawn[again]), pa.array(band)], [*kept, "key", "part", "band"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _compared(left, right, cfg, keep, by_cosine) if left.num_rows and right.num_rows else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
        own = [left["query"].take(pa.array(found[0])), *(right[c].take(pa.array(found[1])) for c in ("SessionId", "decision_index", "next_POIId", "next_category"))]
        return pa.table([*own, *map(pa.array, found[2:])], names=[*kinds, "spatial_score", "cosine_score", "retrieval_score"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cases.schema.fields if f.name != "group")
    cases = cases.withColumn("_h", F.pmod(F.xxhash64("SessionId", "decision_index"), F.lit(1 << 30))).mapInArrow(placed, f"{fields}, key long, part long, band long")
    # counts as literals in the plan: at most a pair of numbers a cell
    of = F.create_map(*[F.lit(x).cast("long") for k, (p, b) in shape.items() if p > 1 or b > 1 for x in (k, p * (1 << 20) + b)]) if any(s != (1, 1) for s in shape.values()) else F.lit(None).cast("map<bigint,bigint>")
    size = F.coalesce(F.try_element_at(of, F.col("key")), F.lit((1 << 20) + 1).cast("long"))
    visiting = asked.withColumn("key", F.explode("keys")).drop("keys").withColumn("_s", size)
    visiting = visiting.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright("_s", 20) - 1))).withColumn("band", F.pmod(F.xxhash64("query"), F.col("_s").bitwiseAND((1 << 20) - 1)).cast("long")).drop("_s")
    by = ("key", "part", "band")
    return visiting.groupBy(*by).cogroup(cases.groupBy(*by)).applyInArrow(best, ddl)


def _compared(left: pa.Table, right: pa.Table, cfg: RetrievalConfig, keep: int, by_cosine: bool) -> list[np.ndarray]:
    """(query, case, spatial, cosine, score) of the best cases of a block for each query.  Products in single precision
    leave out what can't be among them; the others are scored in double precision."""
    (q, at), (c, to) = _of(left, "q_"), _of(right)
    mine, bars = left["q_session"].to_numpy(), left["bar"].to_numpy()
    own, which = np.unique(to, axis=0, return_inverse=True)
    order = np.argsort(which.ravel(), kind="stable")  # cases of a place lie together
    c, which = c[order], which.ravel()[order]
    session, index = right["SessionId"].to_numpy()[order], right["decision_index"].to_numpy()[order]
    longest = np.sqrt((c**2).sum(axis=1).max())
    q_length = np.sqrt((q**2).sum(axis=1))
    error = 4e-7 + (q.shape[1] + 8) * 1.2e-7 * max(1.0, longest) * max(1.0, float(q_length.max()))
    q32, c32 = q.astype(np.float32), c.astype(np.float32)
    out: list[list[np.ndarray]] = []

    def first(rows: list[np.ndarray], of: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The best of each query, and its bar where there are enough of them."""
        rows = [np.concatenate(x) for x in zip(*rows, strict=True)]
        value = np.round(rows[3] if by_cosine else rows[4], PLACES)
        by = np.lexsort((index[rows[1]], session[rows[1]], -value, rows[0]))
        rank = np.arange(len(by)) - np.searchsorted(rows[0][by], rows[0][by])
        last = by[rank == keep - 1]
        of[rows[0][last]] = np.maximum(of[rows[0][last]], value[last])
        return [x[by[rank < keep]] for x in rows], of

    for lo in range(0, len(q), _ROWS):
        bar = bars[lo : lo + _ROWS].copy()
        n, held_rows, waiting = len(bar), [], 0
        for start in range(0, len(c), _COLUMNS):
            part = slice(start, start + _COLUMNS)
            a, b = which[part][0], which[part][-1] + 1
            near = _near(at[lo : lo + n], own[a:b], cfg.tau_m)
            most = q_length[lo : lo + n] * longest
            can = np.flatnonzero((most if by_cosine else cfg.alpha * near.max(axis=1) + (1 - cfg.alpha) * most) >= bar - error)
            if not len(can):
                continue
            score = q32[lo + can] @ c32[part].T
            if not by_cosine:
                score *= np.float32(1 - cfg.alpha)
                score += (cfg.alpha * near[can]).astype(np.float32)[:, which[part] - a]
            some = score >= (bar[can] - error)[:, None].astype(np.float32)
            many = np.flatnonzero(some.sum(axis=1) > 4 * keep)
            if len(many) and score.shape[1] > keep:
                score[many] = np.where(session[None, part] == mine[lo + can[many]][:, None], np.float32(-np.inf), score[many])
                bar[can[many]] = np.maximum(bar[can[many]], np.partition(score[many], -keep, axis=1)[:, -keep] - error)
                some[many] = score[many] >= (bar[can[many]] - error)[:, None].astype(np.float32)
            i, j = np.nonzero(some)
            i, j = can[i], j + start
            other = session[j] != mine[lo + i]
            i, j = i[other], j[other]
            for x in range(0, len(i), 1 << 15):
                k, m = i[x : x + (1 << 15)], j[x : x + (1 << 15)]
                cosine, spatial = np.einsum("ij,ij->i", q[lo + k], c[m]), near[k, which[m] - a]
                held_rows.append([k, m, spatial, cosine, cfg.alpha * spatial + (1 - cfg.alpha) * cosine])
                waiting += len(k)
                if waiting > 1 << 17:
                    rows, bar = first(held_rows, bar)
                    held_rows, waiting = [rows], 0
        if held_rows:
            rows, _ = first(held_rows, bar)
            out.append([rows[0] + lo, order[rows[1]], *rows[2:]])
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def retrieve(queries: DataFrame, cases: DataFrame, cfg: RetrievalConfig = RetrievalConfig(), routing: str = "none", preselect: bool = False) -> DataFrame:
    """The best cases of other sessions for each query: rank, case, scores.

    ``queries`` has query, SessionId, vector, curr_lat, curr_lon and, for routing, prototypes (array).  Routing
    ``top1`` or ``union`` keeps to cases of the query's first, or all, prototypes, and falls back to all cases where
    these hold none.  Score: alpha * exp(-distance / tau) + (1 - alpha) * cosine; scores that agree to PLACES are tied
    and go by session and index.  With ``preselect`` only the top_k * factor cases by cosine get the whole score,
    which may change results.  A missing position counts as far from everything.

    Cases lie in cells by place and vector, drawn from a sample.  The sample gives each query a score that the last of
    its best reaches; it visits only cells whose bound (ball, box of vectors, box of positions) reaches that, so none of
    the best is lost.  A task compares a block of a cell with its queries as two matrices and hands on the best.
    Where vectors and places don't tell cases apart, every query visits every cell.
    """
    n = cases.count()
    keep = cfg.top_k_cases * (cfg.preselect_factor if preselect else 1)
    if routing == "none":
        found = _search(queries, cases, n, cfg, keep, preselect)
    else:
        wanted = F.slice("prototypes", 1, 1) if routing == "top1" else F.col("prototypes")
        found = held(_search(queries.withColumn("_groups", F.array_distinct(wanted).cast("array<bigint>")), cases, n, cfg, keep, preselect, routed=True))
        left = queries.join(found.select("query").distinct(), "query", "left_anti")
        if left.limit(1).count():
            found = found.unionByName(_search(left, cases, n, cfg, keep, preselect))
    w = Window.partitionBy("query")
    best = lambda c: F.row_number().over(w.orderBy(F.desc(F.round(c, PLACES)), "case_session", "case_index"))
    if preselect:
        found = found.withColumn("_r", best("cosine_score")).filter(F.col("_r") <= keep).drop("_r")
    out = found.withColumn("rank", best("retrieval_score")).filter(F.col("rank") <= cfg.top_k_cases)
    return out.select("query", "rank", "case_session", "case_index", "next_POIId", "next_category", "retrieval_score", "spatial_score", "cosine_score")


def candidates(cases: DataFrame, temperature: float = 1.0, limit: int = 10) -> DataFrame:
    """Next places of a query's cases: softmax of the scores, summed by place; the best ``limit``.

    Cases without a next place go first.  Order: weight, cases, best score (weights and scores to PLACES), then the
    place's id."""
    if temperature <= 0:
        raise ValueError("temperature must be over 0")
    w = Window.partitionBy("query")
    rows = cases.filter("next_POIId is not null")
    e = F.exp((F.col("retrieval_score") - F.max("retrieval_score").over(w)) / temperature)
    rows = rows.withColumn("_e", e).withColumn("_w", F.col("_e") / F.sum("_e").over(w))
    first = F.min_by("next_category", F.when(F.col("next_category").isNotNull(), F.col("rank")))
    out = rows.groupBy("query", "next_POIId").agg(F.sum("_w").alias("candidate_weight"), F.count(F.lit(1)).alias("support_case_count"), F.max("retrieval_score").alias("max_case_score"), F.avg("retrieval_score").alias("mean_case_score"), first.alias("next_category"), F.count_distinct("case_session").alias("support_session_count"))
    out = out.withColumn("candidate_prob", F.col("candidate_weight") / F.sum("candidate_weight").over(w))
    order = w.orderBy(F.desc(F.round("candidate_weight", PLACES)), F.desc("support_case_count"), F.desc(F.round("max_case_score", PLACES)), "next_POIId")
    return out.withColumn("candidate_rank", F.row_number().over(order)).filter(F.col("candidate_rank") <= limit)


def cosine_top_k(vectors: DataFrame, queries: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar other rows by cosine for each row that ``queries`` picks; ties to smaller ids."""
    nowhere = [F.lit(0.0).alias("curr_lat"), F.lit(0.0).alias("curr_lon")]
    rows = vectors.select(F.col(id_col).alias("id"), vec.unit(F.col(vector_col).cast("array<double>")).alias("vector"))
    asked = rows.filter(queries).select(F.col("id").alias("query"), F.col("id").alias("SessionId"), "vector", *nowhere)
    none = F.lit(None).cast("string")
    cases = rows.select(F.col("id").alias("SessionId"), F.lit(0).alias("decision_index"), "vector", *nowhere, none.alias("next_POIId"), none.alias("next_category"))
    found = retrieve(asked, cases, RetrievalConfig(spatial=0.0, top_k_cases=k))
    return found.select(F.col("query").alias("query_id"), F.col("case_session").alias("vec_id"), F.col("cosine_score").alias("cosine"), "rank")
