"""Weighted fixed-effect regressions: sums on the cluster, small matrices on the driver.

A fit reads the table two or three times: the cross products (K x K sums, by partial aggregation), then the clusters'
scores, whose outer products are summed too. Only K x K numbers reach the driver. Explicit designs count every column in
K; absorbed designs demean within clusters and count the retained regressors only. The reference law is an argument.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.smallmath import chi2_p, normal_p, normal_quantile, t_p, t_quantile
from fieldloom.sources.tables import stored

from . import cluster_runs as R
from .weights import demean, drop_singletons, equal_group_weights

#: Scaled Gram eigenvalues below this share of the largest count as zero.
RANK_TOLERANCE = 1e-12
#: Clusters whose means are broadcast.
FEW = 1000
#: A regressor whose within variation is below this share of its total is absorbed.
ABSORBED = 1e-10


@dataclass
class Fit:
    status: str
    terms: list[str] = field(default_factory=list)
    beta: np.ndarray | None = None
    cov: np.ndarray | None = None
    n: int = 0
    clusters: int = 0
    k: int = 0
    rank: int = 0
    law: str = "normal"
    more: dict = field(default_factory=dict)

    def rows(self) -> list[tuple]:
        """(term, beta, se, p, low, high), named, never by place."""
        out = []
        for i, term in enumerate(self.terms if self.beta is not None else []):
            b, se = float(self.beta[i]), float(np.sqrt(self.cov[i, i]))
            p = normal_p(b / se) if self.law == "normal" else t_p(b / se, self.clusters - 1)
            half = se * (normal_quantile(0.95) if self.law == "normal" else t_quantile(0.95, self.clusters - 1))
            out.append((term, b, se, p, b - half, b + half))
        return out


def gram(df: DataFrame, columns: list[str], weight: str) -> tuple[np.ndarray, int]:
    """The weighted cross products of columns, and the number of rows."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(F.count(F.lit(1)), *[F.sum(F.col(weight) * F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((len(columns), len(columns)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def scaled_rank(g: np.ndarray) -> tuple[int, float]:
    """Rank and condition number of the column-scaled design, from its Gram matrix."""
    d = np.sqrt(np.where(np.diag(g) > 0, np.diag(g), 1))
    values = np.clip(np.linalg.eigvalsh(g / np.outer(d, d)), 0, None)
    top = values.max(initial=0)
    rank = int((values > RANK_TOLERANCE * top).sum()) if top > 0 else 0
    low = values.min() if len(values) else 0.0
    return rank, float(np.sqrt(top / low)) if low > RANK_TOLERANCE * top else float("inf")


def meat(df: DataFrame, x: list[str], residual: F.Column, weight: str, cluster: str) -> tuple[np.ndarray, int]:
    """Sum over clusters of the outer products of their scores, and the number of clusters."""
    scores = df.groupBy(cluster).agg(*[F.sum(F.col(weight) * F.col(c) * residual).alias(f"s{i}") for i, c in enumerate(x)])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = scores.agg(F.count(F.lit(1)), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")) for i, j in pairs]).first()
    out = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[1:], strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out, row[0]


def crv1(g: np.ndarray, m: np.ndarray, clusters: int, n: int, k: int) -> np.ndarray:
    """The cluster-robust covariance with the usual small-sample factor."""
    bread = np.linalg.inv(g)
    return bread @ m @ bread * (clusters / (clusters - 1)) * ((n - 1) / (n - k))


def _residual(y: str, x: list[str], beta: np.ndarray) -> F.Column:
    out = F.col(y)
    for c, b in zip(x, beta, strict=True):
        out = out - F.lit(float(b)) * F.col(c)
    return out


def fit_explicit(df: DataFrame, y: str, x: list[str], weight: str, cluster: str, intercept: bool = True, extra_k: int = 0) -> Fit:
    """Weighted least squares on explicit columns; K counts every column (and extra_k that were projected out before)."""
    rows = df.withColumn("_one", F.lit(1.0)) if intercept else df
    x = ["_one", *x] if intercept else list(x)
    g, n = gram(rows, [*x, y], weight)
    rank, _ = scaled_rank(g[:-1, :-1])
    if n == 0 or rank < len(x):
        return Fit("non_estimable_rank_deficient", n=n, rank=rank)
    beta = np.linalg.solve(g[:-1, :-1], g[:-1, -1])
    m, clusters = meat(rows, x, _residual(y, x, beta), weight, cluster)
    k = len(x) + extra_k
    return Fit("estimated", ["intercept" if c == "_one" else c for c in x], beta, crv1(g[:-1, :-1], m, clusters, n, k), n, clusters, k, rank)


def region_dummies(df: DataFrame, column: str) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first in order."""
    levels = sorted(r[0] for r in df.select(column).distinct().collect())
    return df.withColumns({f"fe_{column}_{x}": (F.col(column) == x).cast("double") for x in levels[1:]}), [f"fe_{column}_{x}" for x in levels[1:]]


def fit_absorbed(df: DataFrame, y: str, exposures: list[str], controls: list[str], weight: str, cluster: str, group: str | None = None) -> Fit:
    """Cluster effects by demeaning: singletons go, weights are made anew (equal group totals, mean one), columns without
    variation within clusters go; refuses if an exposure is absorbed or the rank is short. t(G - 1) law."""
    rows = drop_singletons(df, cluster)
    if group:
        rows = equal_group_weights(rows, group, weight, scaled=True, name="_w")
    else:
        rows = rows.withColumn("_w", F.col(weight))
    x = [*exposures, *controls]
    total = rows.agg(*[F.var_pop(c) for c in x]).first()
    rows = demean(rows, cluster, [y, *x], F.col("_w"))
    g, n = gram(rows, [*x, y], "_w")
    scale = [(v or 0.0) * n for v in total]
    varies = [i for i in range(len(x)) if g[i, i] > ABSORBED * max(scale[i], 1e-300)]
    if any(i not in varies for i in range(len(exposures))):
        return Fit("non_estimable_exposure_absorbed", n=n)
    kept = [x[i] for i in varies]
    sub = g[np.ix_(varies, varies)]
    rank, _ = scaled_rank(sub)
    if rank < len(kept):
        return Fit("non_estimable_rank_deficient", n=n, rank=rank)
    beta = np.linalg.solve(sub, g[varies, -1])
    m, clusters = meat(rows, kept, _residual(y, kept, beta), "_w", cluster)
    return Fit("estimated", kept, beta, crv1(sub, m, clusters, n, len(kept)), n, clusters, len(kept), rank, "t")


def full_dummy_scale(n: int, k: int, clusters: int) -> float:
    """The factor on standard errors if every absorbed cluster counted as a column (a labelled sensitivity)."""
    return float(np.sqrt((n - k) / (n - k - clusters))) if n - k - clusters > 0 else float("nan")


def partial_beta(g: np.ndarray, i: int, last: int) -> float:
    """The coefficient of column i given all others but the outcome (column last), by the Schur complement."""
    rest = [j for j in range(len(g)) if j not in (i, last)]
    if not rest:
        return g[i, last] / g[i, i]
    solve = np.linalg.solve(g[np.ix_(rest, rest)], g[rest][:, [i, last]])
    return float((g[i, last] - g[i, rest] @ solve[:, 1]) / (g[i, i] - g[i, rest] @ solve[:, 0]))


def inflation(g: np.ndarray) -> np.ndarray:
    """Variance inflation factors from the Gram matrix of centred columns."""
    d = np.sqrt(np.diag(g))
    return np.diag(np.linalg.inv(g / np.outer(d, d)))


def dependence(g: np.ndarray) -> np.ndarray:
    """R squared of each centred column on the others."""
    return 1 - 1 / inflation(g)


def wald(fit: Fit, terms: list[str]) -> tuple[float, int, float]:
    """Chi-squared statistic, degrees of freedom, p-value of a joint test."""
    at = [fit.terms.index(t) for t in terms]
    b, v = fit.beta[at], fit.cov[np.ix_(at, at)]
    x = float(b @ np.linalg.solve(v, b))
    return x, len(at), chi2_p(x, len(at))


def total_effect(fit: Fit, base: str, interaction: str) -> tuple[float, float]:
    """base + interaction and its standard error."""
    i, j = fit.terms.index(base), fit.terms.index(interaction)
    return float(fit.beta[i] + fit.beta[j]), float(np.sqrt(fit.cov[i, i] + fit.cov[j, j] + 2 * fit.cov[i, j]))


def support(df: DataFrame, cluster: str, household: str, exposures: list[str]) -> DataFrame:
    """Clusters, households and units where every exposure varies within the cluster."""
    varies = df.groupBy(cluster).agg(*[(F.min(x) < F.max(x)).alias(f"v_{x}") for x in exposures], F.count(F.lit(1)).alias("units"), F.countDistinct(household).alias("households"))
    every = F.forall(F.array(*[F.coalesce(f"v_{x}", F.lit(False)) for x in exposures]), lambda v: v)
    return varies.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(every).alias("clusters_varying"), F.sum(F.when(every, F.col("households")).otherwise(0)).alias("households_varying"), F.sum(F.when(every, F.col("units")).otherwise(0)).alias("units_varying"))


@dataclass(frozen=True)
class Family:
    """Models, name: (outcome, regressors), on the rows where every column of the family is present. Columns of effects join each
    model (or those named in effects_in) and leave it where they are constant in a scope."""

    specs: dict[str, tuple[str, list[str]]]
    effects: tuple[str, ...] = ()
    effects_in: tuple[str, ...] | None = None

    @property
    def xs(self) -> list[str]:
        return list(dict.fromkeys(["_one", *[x for _, right in self.specs.values() for x in right], *self.effects]))

    @property
    def columns(self) -> list[str]:
        return self.xs + list(dict.fromkeys(y for y, _ in self.specs.values()))

    @property
    def pairs(self) -> list[tuple[int, int]]:
        """The products that a fit uses: all but those of two outcomes."""
        k, xs = len(self.columns), len(self.xs)
        return [(i, j) for i in range(k) for j in range(i, k) if i < xs or i == j]

    def places(self) -> np.ndarray:
        """Where the product of two columns stands among the pairs."""
        at = np.zeros((len(self.columns), len(self.columns)), dtype=np.int64)
        for k, (i, j) in enumerate(self.pairs):
            at[i, j] = at[j, i] = k
        return at


def _cluster_products(families: list[tuple[list[str], list[tuple[int, int]]]], samples: list[tuple[str, str, str]]):
    """The work of a task on whole clusters: a row for each family, cluster and scope (or sample) with the sums of products.

    pooled: the row is all that its cluster has, so it counts in ALL too; a cluster in several scopes has a row ALL of its own."""

    def work(runs):
        for run, begins in runs:
            numbers = {x: R.values(run.column(x)) for x in run.column_names if x not in (R.CLUSTER, "_scope")}
            of_cluster = R.cluster_numbers(begins, run.num_rows)
            if samples:
                members = [(name, numbers[flag] & ~np.isnan(numbers[w]), numbers[w]) for name, flag, w in samples]
            else:
                coded = run.column("_scope").combine_chunks().dictionary_encode()
                scopes = [*coded.dictionary.to_pylist(), None]
                code = coded.indices.fill_null(len(scopes) - 1).to_numpy()
                order = np.lexsort((code, of_cluster))
                members = [(None, np.ones(run.num_rows, dtype=bool), numbers["w"])]
            for f, (columns, pairs) in enumerate(families):
                known = ~np.logical_or.reduce([np.isnan(numbers[x]) for x in columns])
                for name, mask, weight in members:
                    mask = mask & known
                    rows = np.flatnonzero(mask) if samples else order[mask[order]]
                    if not len(rows):
                        continue
                    own = of_cluster[rows]
                    changes = own[1:] != own[:-1]
                    starts = np.r_[0, np.flatnonzero(changes if samples else changes | (code[rows][1:] != code[rows][:-1])) + 1]
                    x = np.array([np.ones(len(rows)), *[numbers[c][rows] for c in columns]])
                    weighted = x * weight[rows]
                    g = np.array([np.add.reduceat(weighted[i] * x[j], starts) for i, j in pairs]).T
                    n = np.diff(np.r_[starts, len(rows)])
                    if samples:
                        yield _product_rows(f, [name] * len(n), np.zeros(len(n), dtype=bool), n, g)
                        continue
                    at = code[rows[starts]]
                    first = np.r_[0, np.flatnonzero(own[starts][1:] != own[starts][:-1]) + 1]
                    several = np.diff(np.r_[first, len(starts)]) > 1
                    several[at[first] == len(scopes) - 1] = True
                    apart = np.repeat(several, np.diff(np.r_[first, len(starts)]))
                    named = at < len(scopes) - 1
                    yield _product_rows(f, [scopes[i] for i in at[named]], ~apart[named], n[named], g[named])
                    if several.any():
                        whole = several.sum()
                        yield _product_rows(f, ["ALL"] * whole, np.zeros(whole, dtype=bool), np.add.reduceat(n, first)[several], np.add.reduceat(g, first, axis=0)[several])

    return work


PRODUCTS = "family int, level string, pooled boolean, n long, g array<double>"


def _product_rows(family: int, levels: list[str], pooled: np.ndarray, n: np.ndarray, g: np.ndarray) -> dict:
    return {"family": np.full(len(n), family, dtype=np.int32), "level": levels, "pooled": pooled, "n": n, "g": R.arrays(g)}


def _by_level(batch):
    """The rows of a batch by family and level, ALL included: key, numbers of rows, products."""
    family, level, pooled = batch.column("family").to_numpy(), np.array(batch.column("level").to_pylist(), dtype=object), batch.column("pooled").to_numpy(zero_copy_only=False)
    n = batch.column("n").to_numpy()
    for f in np.unique(family):
        own = np.flatnonzero(family == f)
        g = R.matrix(batch.column("g").take(own))
        for name in dict.fromkeys([*level[own], *(["ALL"] if pooled[own].any() else [])]):
            rows = np.flatnonzero((level[own] == name) | (pooled[own] & (name == "ALL")))
            yield (int(f), name), n[own[rows]], g[rows]


def fit_grid(df: DataFrame, specs: dict[str, tuple[str, list[str]]], weight: str, cluster: str, scope: str | None = None, effects: list[str] = (), effects_in: list[str] | None = None, samples: dict[str, tuple[F.Column, str]] | None = None) -> dict[tuple[str, str], Fit]:
    """fit_grids of one family."""
    return fit_grids(df, {"": Family(specs, tuple(effects), effects_in)}, weight, cluster, scope, samples)[""]


def fit_grids(df: DataFrame, families: dict[str, Family], weight: str, cluster: str, scope: str | None = None, samples: dict[str, tuple[F.Column, str]] | None = None) -> dict[str, dict[tuple[str, str], Fit]]:
    """Families of weighted least-squares models, for all rows ("ALL") and each level of scope.

    The table is read once however many models and families there are: units are dealt by cluster, a task sums the cross products
    of whole clusters (and scopes) as arrays, and these are written; scopes add up their clusters' sums, and a cluster's scores
    follow from its own. Scopes must be few: their small matrices come here. samples (name: condition, weight) stand in place of
    ALL and scope: a row counts in each one whose condition holds and whose weight is known.
    """
    listed = list(families.values())
    columns = list(dict.fromkeys(x for f in listed for x in f.columns if x != "_one"))
    label = {x: f"x{i}" for i, x in enumerate(columns)}
    flags = [(name, f"f{k}", f"w{k}") for k, name in enumerate(samples or {})]
    rows = df.where(F.col(cluster).isNotNull() & (R.number(weight) > 0))
    held = [F.col(cluster).alias(R.CLUSTER), *[R.number(x).alias(k) for x, k in label.items()]]
    if samples:
        held += [v for (_, f, w), (condition, own) in zip(flags, samples.values(), strict=True) for v in (condition.alias(f), R.number(own).alias(w))]
    else:
        held += [(F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("_scope"), R.number(weight).alias("w")]
    work = _cluster_products([([label[x] for x in f.columns[1:]], f.pairs) for f in listed], flags)
    by_cluster = stored(R.dealt(rows.select(*held), work, PRODUCTS), "cluster-products")

    def sums(batch):
        for key, n, g in _by_level(batch):
            yield key, np.r_[n.sum(), len(n), g.sum(axis=0)]

    totals = R.added(by_cluster, sums, "family int, level string")
    solved, fits = {}, {name: {} for name in families}
    kept: dict[tuple, tuple] = {}
    for (f, level), (n, clusters, *values) in totals.items():
        name, family = list(families)[f], listed[f]
        xs, names, n = family.xs, family.columns, int(n)
        g = np.array(values)[family.places()]
        spread = {c: g[i, i] - g[0, i] ** 2 / g[0, 0] > ABSORBED * max(g[i, i], 1e-300) for i, c in enumerate(names)}
        betas = np.zeros((len(xs), len(family.specs)))
        for s, (model, (y, right)) in enumerate(family.specs.items()):
            use = ["_one", *right, *[c for c in family.effects if spread[c] and c not in right and (family.effects_in is None or model in family.effects_in)]]
            at, end = [names.index(c) for c in use], names.index(y)
            sub = g[np.ix_(at, at)]
            rank, _ = scaled_rank(sub)
            if rank < len(use) or n <= len(use):
                fits[name][level, model] = Fit("non_estimable_rank_deficient", n=n, rank=rank)
            else:
                betas[at, s] = np.linalg.solve(sub, g[at, end])
                fits[name][level, model] = Fit("estimated", ["intercept" if c == "_one" else c for c in use], betas[at, s], None, n, int(clusters), len(use), rank)
                kept[f, level, model] = (s, at, sub)
        solved[f, level] = betas
    if not kept:
        return fits
    shapes = [(len(f.xs), f.places()[: len(f.xs), : len(f.xs)], np.array([f.places()[: len(f.xs), f.columns.index(y)] for y, _ in f.specs.values()])) for f in listed]

    def outer(batch):
        for key, _, g in _by_level(batch):
            k, inner, right = shapes[key[0]]
            fitted = (g[:, inner].reshape(-1, k) @ solved[key]).reshape(len(g), k, -1)
            scores = g[:, right] - fitted.transpose(0, 2, 1)
            yield key, np.array([scores[:, s].T @ scores[:, s] for s in range(len(right))]).ravel()

    meats = R.added(by_cluster, outer, "family int, level string")
    for (f, level, model), (s, at, sub) in kept.items():
        name, k = list(families)[f], shapes[f][0]
        fit, inner = fits[name][level, model], meats[f, level].reshape(-1, k, k)[s][np.ix_(at, at)]
        if fit.clusters < 2:
            fits[name][level, model] = Fit("non_estimable_one_cluster", n=fit.n, clusters=fit.clusters, rank=fit.rank)
        else:
            fit.cov = crv1(sub, inner, fit.clusters, fit.n, fit.k)
    return fits


def _cluster_sums(columns: int, weights: int):
    """The work of a task on whole clusters: for each weight, scope and cluster, sums and products of columns around the cluster's mean."""

    def work(runs):
        for run, begins in runs:
            coded = run.column("_scope").combine_chunks().dictionary_encode()
            scopes = [*coded.dictionary.to_pylist(), None]
            code = coded.indices.fill_null(len(scopes) - 1).to_numpy()
            of_cluster = R.cluster_numbers(begins, run.num_rows)
            order = np.lexsort((code, of_cluster))
            keys, x = run.column(R.CLUSTER), np.array([R.values(run.column(f"x{i}")) for i in range(columns)])
            for k in range(weights):
                w = R.values(run.column(f"w{k}"))
                rows = order[w[order] > 0]
                if not len(rows):
                    continue
                own, at, w = of_cluster[rows], code[rows], w[rows]
                changes = own[1:] != own[:-1]
                starts, parts = (np.r_[0, np.flatnonzero(v) + 1] for v in (changes, changes | (at[1:] != at[:-1])))
                sizes = np.diff(np.r_[starts, len(rows)])
                near = x[:, rows[starts]]
                v = x[:, rows] - np.repeat(near, sizes, axis=1)
                middle = np.add.reduceat(v, starts, axis=1) / sizes
                v -= np.repeat(middle, sizes, axis=1)
                middle = np.repeat(near + middle, sizes, axis=1)[:, parts]
                weighted = v * w
                out = {"_weight": np.full(len(parts), k, dtype=np.int32), "_scope": [scopes[i] for i in at[parts]], "_cluster": keys.take(rows[parts]).combine_chunks(), "n": np.diff(np.r_[parts, len(rows)]), "w": np.add.reduceat(w, parts)}
                out |= {f"p{i}": middle[i] for i in range(columns)} | {f"s{i}": np.add.reduceat(weighted[i], parts) for i in range(columns)}
                yield out | {f"g{i}_{j}": np.add.reduceat(weighted[i] * v[j], parts) for i in range(columns) for j in range(i, columns)}

    return work


def _within_sums(rows: DataFrame, columns: int, weights: int) -> DataFrame:
    """Sums by weight, scope and cluster of written rows (_scope, _c, x0.., w0..), around a level of each cluster.

    Few clusters may have any number of rows: their means are broadcast and the sums are partial ones of every task, so no row
    moves. Many clusters are dealt out, and whole ones summed as arrays.
    """
    pairs = [(i, j) for i in range(columns) for j in range(i, columns)]
    if rows.select(R.CLUSTER).distinct().limit(FEW + 1).count() > FEW:
        kind = rows.schema[R.CLUSTER].dataType.simpleString()
        ddl = f"_weight int, _scope string, _cluster {kind}, n long, w double, " + ", ".join(f"{x} double" for x in [*[f"p{i}" for i in range(columns)], *[f"s{i}" for i in range(columns)], *[f"g{i}_{j}" for i, j in pairs]])
        return R.dealt(rows, _cluster_sums(columns, weights), ddl)
    near = rows.groupBy(F.col(R.CLUSTER).alias("_cluster")).agg(*[F.avg(f"x{i}").alias(f"p{i}") for i in range(columns)])
    met = rows.join(F.broadcast(near), F.col(R.CLUSTER) == F.col("_cluster")).withColumns({f"x{i}": F.col(f"x{i}") - F.col(f"p{i}") for i in range(columns)})
    met = met.withColumn("_w", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"w{k}").alias("v")) for k in range(weights)]))).where("_w.v > 0")
    sums = [F.max(f"p{i}").alias(f"p{i}") for i in range(columns)] + [F.sum(F.col("_w.v") * F.col(f"x{i}")).alias(f"s{i}") for i in range(columns)] + [F.sum(F.col("_w.v") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs]
    return met.groupBy(F.col("_w.k").alias("_weight"), "_scope", "_cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("_w.v").alias("w"), *sums)


def absorbed_grid(df: DataFrame, specs: dict[str, tuple[str, list[str]]], weight: str, cluster: str, scope: str | None = None) -> dict[tuple[str, str], Fit]:
    """absorbed_grids under one weight."""
    return absorbed_grids(df, specs, [weight], cluster, scope)[weight]


def absorbed_grids(df: DataFrame, specs: dict[str, tuple[str, list[str]]], weights: list[str], cluster: str, scope: str | None = None) -> dict[str, dict[tuple[str, str], Fit]]:
    """Many models with absorbed cluster effects, name: (outcome, regressors), for all rows ("ALL") and each level of scope, under each weight.

    Within sums are a cluster's cross products less those of its means, so one aggregate by cluster holds all that the
    models and their scores need. Columns are taken as differences from their cluster's plain mean first, so that the products
    keep their digits at any level of a column. Rows are written once, for all weights. Singleton clusters go. All models use
    the rows where every column is present; a model whose first regressor is absorbed, or whose rank is short, is refused. t(G - 1) law.
    """
    xs = list(dict.fromkeys(x for _, right in specs.values() for x in right))
    columns = xs + list(dict.fromkeys(y for y, _ in specs.values()))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    rows = df.na.drop(subset=[*columns, cluster]).select((F.col(scope).cast("string") if scope else F.lit("ALL")).alias("_scope"), F.col(cluster).alias(R.CLUSTER), *[R.number(w).alias(f"w{k}") for k, w in enumerate(weights)], *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(columns)])
    # a row that no weight uses must not move its cluster's mean
    rows = rows.where(" or ".join(f"w{k} > 0" for k in range(len(weights))))
    sums = _within_sums(stored(rows, "absorbed-rows"), len(columns), len(weights))
    if scope:
        sums = stored(sums, "scope-within")
        names = [x for x in sums.columns if x not in ("_weight", "_scope", "_cluster")]
        pooled = sums.groupBy("_weight", "_cluster").agg(*[(F.max(x) if x[0] == "p" else F.sum(x)).alias(x) for x in names]).withColumn("_scope", F.lit("ALL"))
        sums = sums.where("_scope is not null").unionByName(pooled.select(sums.columns))
    sums = stored(sums.where("n >= 2"), "cluster-within")
    return {w: _absorbed_fits(sums.where(F.col("_weight") == k), specs, xs, columns, pairs) for k, w in enumerate(weights)}


def _absorbed_fits(sums: DataFrame, specs: dict[str, tuple[str, list[str]]], xs: list[str], columns: list[str], pairs: list[tuple[int, int]]) -> dict[tuple[str, str], Fit]:
    """The fits from the sums by scope and cluster."""
    level = [v or 0.0 for v in sums.agg(*[F.avg(f"p{i}") for i in range(len(columns))]).first()]
    within = lambda i, j: F.col(f"g{min(i, j)}_{max(i, j)}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("w")
    # the spread of the clusters' means tells what is absorbed from what is only small
    off = lambda i: F.col(f"p{i}") + F.col(f"s{i}") / F.col("w") - F.lit(float(level[i]))
    between = [F.sum(F.col("w") * off(i) * off(i)) - F.sum(F.col("w") * off(i)) * F.sum(F.col("w") * off(i)) / F.sum("w") for i in range(len(columns))]
    grams = sums.groupBy("_scope").agg(F.sum("n"), F.count(F.lit(1)), *[F.sum(within(i, j)) for i, j in pairs], *between).collect()
    fits, betas, kept = {}, [], {}
    for level, n, clusters, *values in grams:
        g = np.zeros((len(columns), len(columns)))
        for (i, j), v in zip(pairs, values, strict=False):
            g[i, j] = g[j, i] = v
        total, row = values[len(pairs) :], []
        for name, (y, right) in specs.items():
            at, end, beta = [columns.index(x) for x in right], columns.index(y), np.zeros(len(xs))
            varies = [i for i in at if g[i, i] > ABSORBED * max(g[i, i] + total[i], 1e-300)]
            sub = g[np.ix_(varies, varies)]
            rank, _ = scaled_rank(sub)
            if at[0] not in varies:
                fits[level, name] = Fit("non_estimable_exposure_absorbed", n=n, clusters=clusters)
            elif rank < len(varies) or clusters < 2 or n <= len(varies):
                fits[level, name] = Fit("non_estimable_rank_deficient", n=n, clusters=clusters, rank=rank)
            else:
                beta[varies] = np.linalg.solve(sub, g[varies, end])
                fits[level, name] = Fit("estimated", [columns[i] for i in varies], beta[varies], None, n, clusters, len(varies), rank, "t")
                kept[level, name] = (varies, sub)
            row += [float(b) for b in beta]
        betas.append((level, row))
    if not kept:
        return fits
    table = sums.sparkSession.createDataFrame(betas, "_level string, _beta array<double>")
    scored, products, place = sums.join(F.broadcast(table), F.col("_scope") == F.col("_level")), [], {}
    scores = {}
    for s, (name, (y, right)) in enumerate(specs.items()):
        at = [columns.index(x) for x in right]
        for k in at:
            value = within(k, columns.index(y))
            for j in at:
                value = value - F.col("_beta")[s * len(xs) + j] * within(k, j)
            scores[f"c{s}_{k}"] = value
        for k in at:
            for j in at:
                if k <= j:
                    place[name, k, j] = len(products)
                    products.append(F.sum(F.col(f"c{s}_{k}") * F.col(f"c{s}_{j}")).alias(f"m{len(products)}"))
    for level, *m in scored.select("_scope", *[v.alias(k) for k, v in scores.items()]).groupBy("_scope").agg(*products).collect():
        for name in specs:
            if (level, name) in kept:
                at, sub = kept[level, name]
                fit = fits[level, name]
                fit.cov = crv1(sub, np.array([[m[place[name, min(i, j), max(i, j)]] for j in at] for i in at]), fit.clusters, fit.n, fit.k)
    return fits
