"""Families of absorbed-effect models, each on its own sample, from one shuffle of the units and one pass over whole clusters.

Models differ in outcome, exposures, controls, sample (a flag column), weight and in which rows are complete. A unit is one row,
dealt by cluster once, however many models it is in. A task works on runs of whole clusters as arrays: models that use the same
rows of a run share these rows' differences from their cluster's means and the products that they have in common. Differences are
taken from a row of the cluster first, so within sums keep their digits whatever the level of a column or the distance between clusters.

A task returns a row for each model and group: sums of products within clusters, and the second moments of the clusters' scores.
A cluster's scores are linear in the coefficients, which are not yet known. So a task takes scores at coefficients of its own (of the first
run), and keeps their moments together with those of the clusters' products; these give the moments at any other coefficients,
at the final ones in the end. Nothing that is written or moved after the deal grows with the units or clusters.

Weights: with equal groups, those of a model's sample sum to rows / groups in every group, singletons left out before. Groups
hold whole clusters, so this is a factor on a cluster's sums. A model without a weight counts rows.

Defined cases: rows without a cluster (or group, where one is named) are left out, as are those with a missing or NaN column
of the model, or a weight that is missing or not positive. A cluster in two groups raises. Clusters are units of fieldwork and
bounded; one of them is summed in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import stored

from . import cluster_runs as R
from .regress import ABSORBED, Fit, crv1, scaled_rank

#: Groups whose sums reach the driver for each model.
MOST_GROUPS = 1000
#: Fewer rows than this are no sample.
LEAST_ROWS = 5


@dataclass(frozen=True)
class Model:
    """The first exposure must survive the absorption. sample: a boolean column; null is false."""

    name: str
    outcome: str
    exposures: tuple[str, ...]
    controls: tuple[str, ...] = ()
    sample: str | None = None
    weight: str | None = None

    @property
    def regressors(self) -> tuple[str, ...]:
        return (*self.exposures, *self.controls)


def _upper(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(upper: np.ndarray, k: int) -> np.ndarray:
    """A symmetric matrix from its upper half."""
    out = np.zeros((k, k))
    for (i, j), v in zip(_upper(k), upper, strict=True):
        out[i, j] = out[j, i] = v
    return out


def _moved(moments: np.ndarray, k: int, by: np.ndarray) -> np.ndarray:
    """The moments of k scores and the products of k regressors, after the coefficients have changed by so much."""
    a = np.eye(len(moments))
    for p, (i, j) in enumerate(_upper(k)):
        a[i, k + p] -= by[j]
        if i != j:
            a[j, k + p] -= by[i]
    return a @ moments @ a.T


def _solved(g: np.ndarray) -> np.ndarray:
    """Coefficients of the first column on the others; the shortest ones where columns depend on each other."""
    d = np.sqrt(np.where(np.diag(g)[1:] > 0, np.diag(g)[1:], 1.0))
    return np.linalg.pinv(g[1:, 1:] / np.outer(d, d), rcond=1e-12, hermitian=True) @ (g[1:, 0] / d) / d


SUMS = "model int, grp string, split boolean, n long, clusters long, singletons long, varying long, w double, mean array<double>, spread array<double>, gram array<double>, pilot array<double>, moments array<double>"


@dataclass
class Sums:
    """Of a model's rows in some clusters of a group. mean, spread: of the clusters' means, by weight; gram: upper half of the products within
    clusters, the outcome first; pilot: coefficients of the scores in moments, which has scores first, then the regressors' products."""

    split: bool
    n: int
    clusters: int
    singletons: int
    varying: int
    w: float
    mean: np.ndarray
    spread: np.ndarray
    gram: np.ndarray
    pilot: np.ndarray
    moments: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        k = len(self.pilot)
        moments = self.moments + (other.moments if np.array_equal(self.pilot, other.pilot) else _moved(other.moments, k, self.pilot - other.pilot))
        w = self.w + other.w
        share, apart = other.w / w if w else 0.0, other.mean - self.mean
        # a side without clusters has no mean
        mean = self.mean + apart * share if self.w else other.mean
        spread = self.spread + other.spread + (apart * apart * (self.w * share) if self.w and other.w else 0.0)
        return Sums(self.split or other.split, *[getattr(self, x) + getattr(other, x) for x in ("n", "clusters", "singletons", "varying")], w, mean, spread, self.gram + other.gram, self.pilot, moments)

    def row(self, model: int, group: str) -> dict:
        return {"model": [model], "grp": [group]} | {k: [v.ravel().tolist() if isinstance(v, np.ndarray) else v] for k, v in vars(self).items()}

    @staticmethod
    def read(r) -> Sums:
        size = len(r["mean"]) - 1 + len(_upper(len(r["mean"]) - 1))
        numbers = [np.array(r[x], dtype=float) for x in ("mean", "spread", "gram", "pilot", "moments")]
        return Sums(bool(r["split"]), *[int(r[x]) for x in ("n", "clusters", "singletons", "varying")], float(r["w"]), *numbers[:-1], numbers[-1].reshape(size, size))


class _Rows:
    """Rows of a run that models share, under one weight: columns around their cluster's mean, and sums of products by cluster."""

    def __init__(self, part: R.Part, numbers: dict[str, np.ndarray], weight: str | None):
        self.part, self.numbers, self.columns, self.found = part, numbers, {}, {}
        self.w = np.ones(part.n) if weight is None else numbers[weight][part.rows]
        self.weight = part.sums(self.w)

    def column(self, x: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Around the mean; the same by weight; the clusters' means; the number of clusters in which it varies."""
        if x not in self.columns:
            own = self.numbers[x][self.part.rows]
            near = own[self.part.starts]
            v = own - self.part.spread_out(near)
            middle = self.part.sums(self.w * v) / self.weight
            v -= self.part.spread_out(middle)
            self.columns[x] = (v, self.w * v, near + middle, self.part.varying(own))
        return self.columns[x]

    def product(self, x: str, y: str) -> np.ndarray:
        key = (x, y) if x <= y else (y, x)
        if key not in self.found:
            self.found[key] = self.part.sums(self.column(key[0])[1] * self.column(key[1])[0])
        return self.found[key]

    def sums(self, names: tuple[str, ...], pilot: np.ndarray | None, split: bool) -> Sums:
        """Of the model with this outcome and these regressors. A cluster of one row has no products."""
        k = len(names) - 1
        g = np.array([self.product(names[i], names[j]) for i, j in _upper(k + 1)])
        several = self.part.sizes > 1
        w, means = self.weight[several], np.array([self.column(x)[2][several] for x in names])
        total = float(w.sum())
        mean = (means[:, :1] + ((means - means[:, :1]) @ w / total)[:, None])[:, 0] if total else np.zeros(k + 1)
        spread = (means - mean[:, None]) ** 2 @ w
        gram = g.sum(axis=1)
        pilot = _solved(_square(gram, k + 1)) if pilot is None else pilot
        inner = g[k + 1 :]
        scores = g[1 : k + 1].copy()
        for p, (i, j) in enumerate(_upper(k)):
            scores[i] -= inner[p] * pilot[j]
            if i != j:
                scores[j] -= inner[p] * pilot[i]
        both = np.r_[scores, inner]
        return Sums(split, int(self.part.sizes[several].sum()), int(several.sum()), int((~several).sum()), self.column(names[1])[3], total, mean, spread, gram, pilot, both @ both.T)


def _model_sums(models: list[tuple[tuple[str, ...], int | None, str | None]]):
    """The work of a task; models: outcome and regressors, number of the flag, weight. It yields a row for each model and group."""

    def work(runs):
        found: dict[tuple[int, str], Sums] = {}
        for run, starts in runs:
            numbers = {x: R.values(run.column(x)) for x in run.column_names if x[0] in "vw"}
            of_cluster = R.cluster_numbers(starts, run.num_rows)
            coded = run.column("_g").combine_chunks().dictionary_encode()
            code, groups = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            whole = bool((np.minimum.reduceat(code, starts) == np.maximum.reduceat(code, starts)).all())
            flags = {f: R.values(run.column(f"f{f}")) for f in {f for _, f, _ in models} - {None}}
            missing = {x: np.isnan(v) if x[0] == "v" else ~(v > 0) for x, v in numbers.items()}
            for number, group in enumerate(groups):
                rows = np.flatnonzero(code == number)
                own = {x: v[rows] for x, v in numbers.items()}
                inside, gone, cluster = {f: v[rows] for f, v in flags.items()}, {x: v[rows] for x, v in missing.items()}, of_cluster[rows]
                used = {f for f, v in inside.items() if v.any()}
                masks, parts, shared = {}, {}, {}
                for m, (names, flag, weight) in enumerate(models):
                    if flag is not None and flag not in used:
                        continue
                    rule = (flag, frozenset(names), weight)
                    if rule not in masks:
                        mask = ~np.logical_or.reduce([gone[x] for x in (*names, *([weight] if weight else []))])
                        mask = mask if flag is None else mask & inside[flag]
                        masks[rule] = np.packbits(mask).tobytes()
                        if masks[rule] not in parts:
                            parts[masks[rule]] = R.Part(mask, cluster)
                    part = parts[masks[rule]]
                    if not part.n:
                        continue
                    key = (masks[rule], weight)
                    if key not in shared:
                        shared[key] = _Rows(part, own, weight)
                    split = not whole and _split(code, of_cluster, rows[part.rows], flags.get(flag), [missing[x] for x in (*names, *([weight] if weight else []))])
                    before = found.get((m, group))
                    s = shared[key].sums(names, None if before is None else before.pilot, split)
                    found[m, group] = s if before is None else before + s
                if len({g for _, g in found}) > MOST_GROUPS:
                    raise ValueError(f"over {MOST_GROUPS} groups")
        for (m, group), s in found.items():
            yield s.row(m, group)

    return work


def _split(code: np.ndarray, of_cluster: np.ndarray, rows: np.ndarray, flag: np.ndarray | None, missing: list[np.ndarray]) -> bool:
    """Whether a cluster of these rows has rows of the model in another group."""
    used = ~np.logical_or.reduce(missing) & (True if flag is None else flag)
    return bool((used & np.isin(of_cluster, of_cluster[rows]) & (code != code[rows[0]])).any())


def _merged(rows):
    import pandas as pd

    out = None
    for _, r in rows.iterrows():
        one = Sums.read(r)
        out = one if out is None else out + one
    return pd.DataFrame(out.row(rows["model"].iloc[0], rows["grp"].iloc[0]))


def model_sums(df: DataFrame, models: Sequence[Model], cluster: str, group: str | None) -> DataFrame:
    """A row of Sums for each model (its place in the list) and group."""
    columns = list(dict.fromkeys(x for m in models for x in (m.outcome, *m.regressors)))
    flags = list(dict.fromkeys(m.sample for m in models if m.sample))
    weights = list(dict.fromkeys(m.weight for m in models if m.weight))
    rows = df.select(F.col(cluster).alias(R.CLUSTER), (F.col(group) if group else F.lit(0)).cast("string").alias("_g"), *[R.number(x).alias(f"v{i}") for i, x in enumerate(columns)], *[F.col(x).alias(f"f{i}") for i, x in enumerate(flags)], *[R.number(x).alias(f"w{i}") for i, x in enumerate(weights)])
    rows = rows.where(F.col(R.CLUSTER).isNotNull() & F.col("_g").isNotNull())
    listed = [(tuple(f"v{columns.index(x)}" for x in (m.outcome, *m.regressors)), flags.index(m.sample) if m.sample else None, f"w{weights.index(m.weight)}" if m.weight else None) for m in models]
    each = stored(R.dealt(rows, _model_sums(listed), SUMS), "model-sums")
    if each.select("grp").distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise ValueError(f"over {MOST_GROUPS} groups")
    return each.groupBy("model", "grp").applyInPandas(_merged, SUMS)


def own_sample_grid(df: DataFrame, models: Sequence[Model], cluster: str, group: str | None = None) -> dict[str, Fit]:
    """A fit for each model, by name; t(G - 1) law. more has: singletons, varying (clusters), within_sd, residual_sd, condition, mean
    and absorbed (the regressors without variation within clusters)."""
    if not models:
        return {}
    found: dict[int, list[tuple[str, Sums]]] = {}
    for r in model_sums(df, models, cluster, group).collect():
        found.setdefault(r["model"], []).append((r["grp"], Sums.read(r)))
    if any(s.split for own in found.values() for _, s in own):
        raise ValueError("a cluster lies in two groups")
    fits = {}
    for m, spec in enumerate(models):
        every = [s for _, s in sorted(found.get(m, []), key=lambda x: x[0])]
        parts = [s for s in every if s.n]
        n, clusters = sum(s.n for s in parts), sum(s.clusters for s in parts)
        factor = [n / len(parts) / s.w if spec.weight and group else 1.0 for s in parts]
        size = len(spec.regressors) + 1
        g = _square(sum(f * s.gram for f, s in zip(factor, parts, strict=True)), size) if parts else np.zeros((size, size))
        w = sum(f * s.w for f, s in zip(factor, parts, strict=True))
        mean = sum(f * s.w * (s.mean - parts[0].mean) for f, s in zip(factor, parts, strict=True)) / w + parts[0].mean if parts else np.zeros(size)
        spread = np.diag(g) + sum((f * (s.spread + s.w * (s.mean - mean) ** 2) for f, s in zip(factor, parts, strict=True)), np.zeros(size))
        varies = [i for i in range(1, size) if g[i, i] > ABSORBED * max(spread[i], 1e-300)]
        more = {"singletons": sum(s.singletons for s in every), "varying": sum(s.varying for s in parts), "absorbed": [spec.regressors[i - 1] for i in range(1, size) if i not in varies]}
        if w:
            more |= {"mean": float(mean[1]), "within_sd": float(np.sqrt(max(g[1, 1], 0.0) / w))}
        sub = g[np.ix_(varies, varies)]
        rank, condition = scaled_rank(sub)
        if n < LEAST_ROWS or not spread[1] > 0:
            fits[spec.name] = Fit("non_estimable_no_within_variation", n=n, clusters=clusters, more=more)
        elif 1 not in varies:
            fits[spec.name] = Fit("non_estimable_exposure_absorbed", n=n, clusters=clusters, more=more)
        elif rank < len(varies) or clusters < 2 or n <= len(varies):
            fits[spec.name] = Fit("non_estimable_rank_deficient", n=n, clusters=clusters, rank=rank, more=more)
        else:
            beta = np.linalg.solve(sub, g[varies, 0])
            others = [i for i in range(len(varies)) if varies[i] != 1]
            left = g[1, 1] - (sub[0, others] @ np.linalg.solve(sub[np.ix_(others, others)], sub[others, 0]) if others else 0.0)
            more |= {"condition": condition, "residual_sd": float(np.sqrt(max(left, 0.0) / w))}
            full = np.zeros(size - 1)
            full[[i - 1 for i in varies]] = beta
            at = [i - 1 for i in varies]
            inner = sum(f * f * _moved(s.moments, size - 1, full - s.pilot)[np.ix_(at, at)] for f, s in zip(factor, parts, strict=True))
            fits[spec.name] = Fit("estimated", [spec.regressors[i - 1] for i in varies], beta, crv1(sub, inner, clusters, n, len(varies)), n, clusters, len(varies), rank, "t", more)
    return fits
