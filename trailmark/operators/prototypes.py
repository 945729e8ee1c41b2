"""Behavioural prototypes: Gaussian mixtures over session vectors, chosen by BIC, with routing of prefixes.

EM runs over Arrow batches: each round broadcasts the parameters (components times dimensions) and sums sufficient
statistics per task, so the driver gets numbers of fixed size whatever the number of sessions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PrototypeConfig
from ..functions.vectors import entropy
from ..schema import require_unique

#: Rows that starting points are drawn from.
_SEEDS = 4096


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray  # (k, d) if diagonal, else (k, d, d)
    covariance_type: str
    converged: bool = False
    n_iter: int = 0
    log_likelihoods: tuple = ()

    @cached_property
    def _factors(self) -> tuple[np.ndarray, np.ndarray]:
        """Of full covariances: what whitens rows, and the log determinants."""
        low = np.linalg.cholesky(self.covariances)
        return np.linalg.inv(low).transpose(0, 2, 1), 2 * np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if self.covariance_type == "diag":
            p = 1 / self.covariances
            square = (x**2) @ p.T - 2 * x @ (self.means * p).T + (self.means**2 * p).sum(axis=1)
            logdet = np.log(self.covariances).sum(axis=1)
        else:
            square = np.empty((len(x), len(self.weights)))
            whitening, logdet = self._factors
            for k, (m, w) in enumerate(zip(self.means, whitening, strict=True)):
                y = x - m
                square[:, k] = 0
                for lo in range(0, d, _STRIP):  # w is upper triangular
                    z = y[:, : lo + _STRIP] @ w[: lo + _STRIP, lo : lo + _STRIP]
                    square[:, k] += np.einsum("ij,ij->i", z, z)
        return -0.5 * (d * np.log(2 * np.pi) + logdet + square) + np.log(self.weights)

    def posterior(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        joint = self.log_probabilities(x)
        top = joint.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(joint - top).sum(axis=1))
        return np.exp(joint - total[:, None]), total

    def parameters(self) -> int:
        k, d = self.means.shape
        return 2 * k * d + k - 1 if self.covariance_type == "diag" else k * d * (d + 1) // 2 + k * d + k - 1

    def bic(self, log_likelihood: float, n: int) -> float:
        return -2 * log_likelihood + self.parameters() * np.log(n)

    def aic(self, log_likelihood: float) -> float:
        return -2 * log_likelihood + 2 * self.parameters()


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


#: Rows that the E-step looks at once; bytes of sums that the driver takes from the tasks directly.
_ROWS, _DIRECT = 1024, 64 << 20
#: Columns of a triangular factor that are multiplied at once.
_STRIP = 16


def _expect(rows: DataFrame, mixtures: list[Mixture]) -> list[tuple]:
    """(n, log likelihood, weights, sums, squares) over all rows for each mixture, in one pass."""
    model = rows.sparkSession.sparkContext.broadcast(mixtures)
    sizes = [2 + m.means.shape[0] * (1 + m.means.shape[1] + _squares(m)) for m in mixtures]
    ends = np.cumsum(sizes)

    def step(batches):
        sums = None
        for batch in batches:
            whole = _matrix(batch.column("features"))
            for lo in range(0, len(whole), _ROWS):
                x = whole[lo : lo + _ROWS]
                new = np.concatenate([_sums(m, x) for m in model.value])
                sums = new if sums is None else sums + new
        if sums is not None:
            parts = range(0, len(sums), 1 << 16)
            yield pa.RecordBatch.from_pydict({"part": list(parts), "s": [sums[k : k + (1 << 16)].tobytes() for k in parts]})

    def merged(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"][:1], "s": [sum(np.frombuffer(s.as_py()) for s in table["s"]).tobytes()]})

    tasks = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    added = rows.select("features").coalesce(tasks).mapInArrow(step, "part long, s binary")
    if tasks * 8 * int(ends[-1]) > _DIRECT:
        added = added.groupBy("part").applyInArrow(merged, "part long, s binary")
    flat = np.zeros(ends[-1])  # as many numbers as the models have
    for part, s in sorted((p, bytes(s)) for p, s in added.collect()):
        s = np.frombuffer(s)
        flat[part : part + len(s)] += s
    out = []
    for m, end, size in zip(mixtures, ends, sizes, strict=True):
        (k, d), f = m.means.shape, flat[end - size : end]
        square = f[2 + k + k * d :].reshape(k, -1)
        if m.covariance_type == "full":
            i, j = np.triu_indices(d)
            whole = np.zeros((k, d, d))
            whole[:, i, j] = square
            whole[:, j, i] = square
            square = whole
        out.append((f[0], f[1], f[2 : 2 + k], f[2 + k : 2 + k + k * d].reshape(k, d), square))
    return out


def _squares(m: Mixture) -> int:
    d = m.means.shape[1]
    return d * (d + 1) // 2 if m.covariance_type == "full" else d


def _sums(m: Mixture, x: np.ndarray) -> np.ndarray:
    """What some rows add to the sums of _expect; of full squares the upper half."""
    r, total = m.posterior(x)
    if m.covariance_type == "full":
        upper = np.triu_indices(x.shape[1])
        square = np.zeros((len(m.weights), len(upper[0])))
        for k, w in enumerate(r.T):
            own = np.flatnonzero(w > 1e-40)  # others add nothing that a double holds
            if len(own):
                y = x[own] * np.sqrt(w[own, None])
                square[k] = (y.T @ y)[upper]  # of one matrix, so half is computed
    else:
        square = r.T @ x**2
    return np.concatenate(([len(x), total.sum()], r.sum(axis=0), (r.T @ x).ravel(), square.ravel()))


def _start(x: np.ndarray, k: int, covariance: str, cfg: PrototypeConfig) -> Mixture:
    """The best of n_init starts on a sample."""
    k = min(k, len(x))
    var = x.var(axis=0) + cfg.reg_covar
    best, best_ll = None, -np.inf
    for start in range(cfg.n_init):
        rng = np.random.default_rng(cfg.seed + start)
        centres = [x[rng.integers(len(x))]]
        near = ((x - centres[0]) ** 2).sum(axis=1)
        for _ in range(1, k):  # each new centre far from those before
            p = near / near.sum() if near.sum() > 0 else None
            centres.append(x[rng.choice(len(x), p=p)])
            near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
        m = Mixture(np.full(k, 1 / k), np.array(centres), np.tile(var, (k, 1)), "diag")
        ll = m.posterior(x)[1].sum()
        if ll > best_ll:
            best, best_ll = m, ll
    if covariance == "full":
        best = Mixture(best.weights, best.means, np.tile(np.diag(var), (k, 1, 1)), covariance)
    return best


def fit_mixtures(rows: DataFrame, kinds: list[tuple[int, str]], cfg: PrototypeConfig = PrototypeConfig()) -> list[Mixture]:
    """Mixtures of several sizes and covariance types: EM from the best of n_init starts on a bounded sample; then over
    all rows until the mean gain is below tol.  A round is one pass for all that have not settled."""
    sample = rows.select("features").orderBy(F.xxhash64("features", F.lit(cfg.seed))).limit(_SEEDS).toArrow()
    x = _matrix(sample["features"].combine_chunks())
    found = [_start(x, k, covariance, cfg) for k, covariance in kinds]
    gains: list[list[float]] = [[] for _ in kinds]
    active = list(range(len(kinds)))
    for i in range(cfg.max_iter):
        if not active:
            break
        for at, (n, ll, w, s, q) in zip(list(active), _expect(rows, [found[a] for a in active]), strict=True):
            own = gains[at]
            own.append(ll / n)
            if len(own) > 1 and abs(own[-1] - own[-2]) < cfg.tol:
                found[at].converged = True
                active.remove(at)
                continue
            covariance = kinds[at][1]
            w = w + 10 * np.finfo(float).eps
            means = s / w[:, None]
            if covariance == "diag":
                cov = np.maximum(q / w[:, None] - means**2, 0) + cfg.reg_covar
            else:
                cov = q / w[:, None, None] - np.einsum("ki,kj->kij", means, means)
                cov = (cov + cov.transpose(0, 2, 1)) / 2 + cfg.reg_covar * np.eye(means.shape[1])
            found[at] = Mixture(w / w.sum(), means, cov, covariance, n_iter=i + 1)
    for m, own in zip(found, gains, strict=True):
        m.log_likelihoods = tuple(own)
    return found


def fit_mixture(rows: DataFrame, k: int, covariance: str, cfg: PrototypeConfig = PrototypeConfig()) -> Mixture:
    return fit_mixtures(rows, [(k, covariance)], cfg)[0]


def select_mixture(train: DataFrame, validation: DataFrame | None = None, cfg: PrototypeConfig = PrototypeConfig()) -> tuple[Mixture, list[dict]]:
    """The mixture with the smallest BIC over all sizes and covariance types, and the figures of each, by BIC."""
    found = []
    mixtures = fit_mixtures(train, [(k, covariance) for covariance in cfg.covariances for k in cfg.components], cfg)
    validated = _expect(validation, mixtures) if validation is not None else [None] * len(mixtures)
    for m, (n, ll, *_), other in zip(mixtures, _expect(train, mixtures), validated, strict=True):
        row = {"K": len(m.weights), "covariance_type": m.covariance_type, "bic": float(m.bic(ll, n)), "aic": float(m.aic(ll)), "train_avg_loglik": float(ll / n), "converged": m.converged, "n_iter": m.n_iter}
        if other is not None:
            vn, vll, *_ = other
            row["val_avg_loglik"] = float(vll / vn) if vn else None
        found.append((row["bic"], len(found), row, m))
    found.sort(key=lambda f: f[:2])
    return found[0][3], [f[2] for f in found]


def posteriors(rows: DataFrame, mixture: Mixture, key: str = "SessionId") -> DataFrame:
    """(key, probability): the posterior of each component."""
    model = rows.sparkSession.sparkContext.broadcast(mixture)

    def score(batches):
        for batch in batches:
            p = model.value.posterior(_matrix(batch.column("features")))[0] if batch.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(p.tolist(), pa.list_(pa.float64()))], [key, "probability"])

    return rows.select(key, "features").mapInArrow(score, f"{key} {rows.schema[key].dataType.simpleString()}, probability array<double>")


def top_prototypes(p: DataFrame, top_m: int = 3) -> DataFrame:
    """p with prototype_id, confidence, gap of the two best, and the best top_m with their probabilities."""
    ranked = F.sort_array(F.transform("probability", lambda x, i: F.struct((-x).alias("p"), i.alias("k"))))
    p = p.withColumn("_r", ranked)
    at = lambda i, f: F.get(F.col("_r"), F.lit(i))[f]
    p = p.withColumn("prototype_id", at(0, "k").cast("int")).withColumn("prototype_confidence", -at(0, "p")).withColumn("prototype_top2_gap", F.coalesce(-at(0, "p") + at(1, "p"), -at(0, "p")))
    for m in range(top_m):
        p = p.withColumn(f"top{m + 1}_prototype_id", at(m, "k").cast("int")).withColumn(f"top{m + 1}_prototype_prob", -at(m, "p"))
    return p.drop("_r")


def with_meta(assigned: DataFrame, meta: DataFrame, key: str = "SessionId") -> DataFrame:
    """assigned with the columns of meta, which must have one row a key; sessions without one get nulls."""
    return assigned.join(require_unique(meta, key), key, "left")


def prototype_summary(assigned: DataFrame, mixture: Mixture) -> DataFrame:
    """One row a component, those without sessions as well."""
    spark = assigned.sparkSession
    every = spark.createDataFrame([(k, float(w)) for k, w in enumerate(mixture.weights)], "prototype_id int, mixture_weight double")
    own = assigned.groupBy("prototype_id").agg(F.count(F.lit(1)).alias("train_hard_count"), F.avg("prototype_confidence").alias("mean_self_posterior"))
    out = every.join(own, "prototype_id", "left").withColumn("train_hard_count", F.coalesce("train_hard_count", F.lit(0).cast("long")))
    total = float(max(1, assigned.count()))
    return out.withColumn("train_hard_fraction", F.col("train_hard_count") / total).withColumn("mean_self_posterior", F.coalesce("mean_self_posterior", F.lit(0.0)))


def route(prefixes: DataFrame, mixture: Mixture, length: Column, cfg: PrototypeConfig = PrototypeConfig()) -> DataFrame:
    """Prototypes of session prefixes with the frozen mixture; prefixes shorter than min_prefix_len get nulls."""
    out = top_prototypes(posteriors(prefixes, mixture), cfg.top_m).withColumn("posterior_entropy", entropy("probability"))
    long_enough = prefixes.select("SessionId", (length >= cfg.min_prefix_len).alias("routing_applied"))
    out = out.join(long_enough, "SessionId")
    return out.select("SessionId", "routing_applied", *[F.when(F.col("routing_applied"), F.col(c)).alias(c) for c in out.columns if c not in ("SessionId", "routing_applied")])
