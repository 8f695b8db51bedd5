"""Within-cluster designs with blocks of dummies: ranks, dependence, residual exposures, equal codings.

A design has dense columns and blocks. A block is a column of levels that stands for a dummy a level; products with dummies are
sums by level, and only clusters have them as an array. Units are dealt by cluster once, whatever the number of designs; a task holds whole clusters, adds up
each design's products within clusters, and returns one matrix a design. These are added by design, and one each reaches the driver.

Dense columns are taken as differences from their cluster's mean before they are multiplied, so that products keep their
digits. Rows with a missing or NaN value in any column of the design, cluster or block are left out. Weights must be positive.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.tables import stored

from . import cluster_runs as R
from .regress import ABSORBED, RANK_TOLERANCE, scaled_rank

#: Levels of all designs together, whose pairs reach the driver.
MOST_LEVELS = 20_000
#: Numbers of a run's matrix.
CELLS_AT_ONCE = 1 << 23
#: A column counts as dependent on others from this R squared on.
DEPENDENT = 0.999999


@dataclass
class Within:
    """names: the dense columns, then "block=level"; gram: their weighted products within clusters; spread: their weighted
    squares around the mean of all rows."""

    names: list[str]
    gram: np.ndarray
    spread: np.ndarray
    n: int
    weight: float
    clusters: int
    singletons: int
    varying: int

    def at(self, names: list[str]) -> list[int]:
        place = {x: i for i, x in enumerate(self.names)}
        return [place[x] for x in names]

    def survive(self, names: list[str]) -> list[str]:
        """The names whose columns vary within clusters."""
        return [x for x, i in zip(names, self.at(names), strict=True) if self.gram[i, i] > ABSORBED * max(self.spread[i], 1e-300)]

    def block(self, block: str) -> list[str]:
        return [x for x in self.names if x.startswith(f"{block}=")]

    def rank(self, names: list[str], given: list[str] = ()) -> int:
        """The rank of columns, after others are projected out."""
        i = self.at(self.survive(names))
        left = self.left(given)[np.ix_(i, i)]
        scale = np.sqrt(np.diag(self.gram)[i])
        values = np.linalg.eigvalsh(left / np.outer(scale, scale)) if i else np.zeros(0)
        return int((values > 1e-9 * max(values.max(initial=0.0), 1.0)).sum())

    def coefficients(self, target: str, on: list[str]) -> np.ndarray:
        """Of the target's projection on columns; the shortest ones where columns depend on each other."""
        i, t = self.at(on), self.at([target])[0]
        if not i:
            return np.zeros(0)
        scale = np.sqrt(np.maximum(np.diag(self.gram)[i], 1e-300))
        return np.linalg.pinv(self.gram[np.ix_(i, i)] / np.outer(scale, scale), rcond=RANK_TOLERANCE, hermitian=True) @ (self.gram[i, t] / scale) / scale

    def left(self, given: list[str]) -> np.ndarray:
        """The products of what is left of all columns."""
        i = self.at(self.survive(list(given)))
        if not i:
            return self.gram
        scale = np.sqrt(np.diag(self.gram)[i])
        inverse = np.linalg.pinv(self.gram[np.ix_(i, i)] / np.outer(scale, scale), rcond=RANK_TOLERANCE, hermitian=True) / np.outer(scale, scale)
        return self.gram - self.gram[:, i] @ inverse @ self.gram[i]

    def partial(self, y: str, x: str, given: list[str]) -> float:
        """The coefficient of y on x given others, from what is left of both."""
        left, i, j = self.left(given), *self.at([x, y])
        return float(left[i, j] / left[i, i]) if left[i, i] > ABSORBED * max(self.gram[i, i], 1e-300) else float("nan")

    def diagnostics(self, exposure: str, columns: list[str]) -> dict:
        """What the design of these columns leaves of an exposure, and how far they depend on each other."""
        kept, e = self.survive(columns), self.at([exposure])[0]
        i = self.at(kept)
        sub = self.gram[np.ix_(i, i)]
        scale = np.sqrt(np.diag(sub))
        scaled = sub / np.outer(scale, scale)
        _, condition = scaled_rank(sub) if kept else (0, 1.0)
        dependent = []
        for k, name in enumerate(kept):
            others = [j for j in range(len(kept)) if j != k]
            r2 = float(scaled[k, others] @ np.linalg.pinv(scaled[np.ix_(others, others)], rcond=1e-9, hermitian=True) @ scaled[others, k]) if others else 0.0
            if r2 > DEPENDENT:
                dependent.append(name)
        rest = max(float(self.left(kept)[e, e]), 0.0)
        own = float(self.gram[e, e])
        return {
            "columns": len(columns), "used": len(kept), "absorbed": [x for x in columns if x not in kept], "rank": self.rank(kept), "condition": condition, "dependent": dependent,
            "within_sd": float(np.sqrt(own / (self.n - 1))) if self.n > 1 else None, "residual_sd": float(np.sqrt(rest / (self.n - 1))) if self.n > 1 else None, "residual_share": rest / own if own > 0 else None,
        }


@dataclass(frozen=True)
class Design:
    """dense: its dense columns, the exposure first; sample: a boolean column, null is false; needs: more columns that must be present."""

    dense: tuple[str, ...]
    sample: str | None = None
    needs: tuple[str, ...] = ()


SUMS = "design string, n long, w double, clusters long, singletons long, varying long, names array<string>, mean array<double>, spread array<double>, gram array<double>"


@dataclass
class Sums:
    """Of a design's rows in some clusters. names, gram as in Within; spread: squares around the mean of these rows."""

    n: int
    w: float
    clusters: int
    singletons: int
    varying: int
    names: list[str]
    mean: np.ndarray
    spread: np.ndarray
    gram: np.ndarray

    def __add__(self, other: Sums) -> Sums:
        """Of both. A level that one of them lacks has the mean 0 there."""
        names = self.names if self.names == other.names else list(dict.fromkeys([*self.names, *other.names]))
        place = {x: i for i, x in enumerate(names)}
        mean, spread, gram = np.zeros((2, len(names))), np.zeros(len(names)), np.zeros((len(names), len(names)))
        for k, one in enumerate((self, other)):
            at = [place[x] for x in one.names]
            mean[k, at] = one.mean
            spread[at] += one.spread
            gram[np.ix_(at, at)] += one.gram
        w = self.w + other.w
        apart = mean[1] - mean[0]
        added = [getattr(self, k) + getattr(other, k) for k in ("n", "w", "clusters", "singletons", "varying")]
        return Sums(*added, names, mean[0] + apart * (other.w / w), spread + apart * apart * (self.w * other.w / w), gram)

    def row(self, design: str) -> dict:
        return {k: [v] for k, v in {"design": design, **vars(self), "mean": self.mean.tolist(), "spread": self.spread.tolist(), "gram": self.gram.ravel().tolist()}.items()}

    @staticmethod
    def read(r) -> Sums:
        own = list(r["names"])
        return Sums(*[r[k] for k in ("n", "w", "clusters", "singletons", "varying")], own, np.array(r["mean"]), np.array(r["spread"]), np.array(r["gram"]).reshape(len(own), len(own)))


def _sums(part: R.Part, dense: list[np.ndarray], labels: list[str], w: np.ndarray | None, blocks: list[tuple[np.ndarray, list[str]]]) -> Sums:
    """blocks: each row's level by number, and the names of the levels."""
    k, names = len(labels), [*labels, *[x for _, levels in blocks for x in levels]]
    own = np.ones(part.n) if w is None else w[part.rows]
    weight = part.sums(own)
    x = np.array([v[part.rows] for v in dense])
    total = own.sum()
    varying = part.varying(x[0])
    # around a value of their cluster first, so that its mean keeps its digits
    near = x[:, part.starts]
    x -= part.spread_out(near)
    middle = part.sums(x * own) / weight
    x -= part.spread_out(middle)
    middle += near
    mean, gram = np.zeros(len(names)), np.zeros((len(names), len(names)))
    mean[:k] = middle @ weight / total
    spread = (x * x) @ own + ((middle - mean[:k, None]) ** 2) @ weight
    weighted = x * own
    gram[:k, :k] = weighted @ x.T
    # a row has one level of a block, so products with levels are sums by level
    s, clusters, seen, at = [part.sums(weighted)], np.repeat(np.arange(len(part.starts)), part.sizes), [], k
    for codes, levels in blocks:
        code, n = codes[part.rows], len(levels)
        held = np.bincount(clusters * n + code, own, len(part.starts) * n).reshape(-1, n).T
        for i in range(k):
            gram[i, at : at + n] = gram[at : at + n, i] = np.bincount(code, weighted[i], n)
        for before, first, m in seen:
            both = np.bincount(before * n + code, own, m * n).reshape(m, n)
            gram[first : first + m, at : at + n], gram[at : at + n, first : first + m] = both, both.T
        gram[range(at, at + n), range(at, at + n)] = held.sum(axis=1)
        s.append(held)
        seen.append((code, at, n))
        at += n
    s = np.concatenate(s)
    mean[k:] = s[k:].sum(axis=1) / total
    spread = np.r_[spread, total * mean[k:] * (1 - mean[k:])]
    return Sums(part.n, float(total), len(part.starts), int((part.sizes == 1).sum()), varying, names, mean, spread, gram - (s / weight) @ s.T)


def _runs_of(columns: int, run, starts):
    """A run in parts of whole clusters, so that its matrix of so many columns stays small."""
    most, ends, first = max(CELLS_AT_ONCE // max(columns, 1), 1), np.r_[starts, run.num_rows], 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, ends[first] + most, side="right")) - 1, first + 1)
        yield run.slice(ends[first], ends[last] - ends[first]), starts[first:last] - starts[first]
        first = last


def _level_sums(designs: dict[str, Design] | None, labels: list[str], blocks: list[str]):
    """The work of a task: a row for each design. Without designs, a column _d names that of each row and dense columns have their labels."""

    def work(runs):
        found: dict[str, Sums] = {}
        known = [{} for _ in blocks]
        for whole, begins in runs:
            for b, seen in zip(blocks, known, strict=True):
                for v in whole.column(b).unique().to_pylist():
                    seen.setdefault(v, len(seen))
            if sum(map(len, known)) > MOST_LEVELS:
                raise ValueError(f"over {MOST_LEVELS} levels")
            for run, starts in _runs_of(len(labels) + sum(map(len, known)), whole, begins):
                numbers = {x: R.values(run.column(x)) for x in run.column_names if x not in (R.CLUSTER, "_d", *blocks)}
                missing = {x: np.isnan(v) for x, v in numbers.items() if v.dtype != bool}
                own = R.cluster_numbers(starts, run.num_rows)
                levels = []
                for b, seen in zip(blocks, known, strict=True):
                    coded = run.column(b).combine_chunks().dictionary_encode()
                    levels.append((np.array([seen[v] for v in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()], [f"{b}={v}" for v in seen]))
                if designs is None:
                    coded = run.column("_d").combine_chunks().dictionary_encode()
                    place = coded.indices.to_numpy()
                    members = [(d, Design(tuple(labels)), place == i) for i, d in enumerate(coded.dictionary.to_pylist())]
                else:
                    members = [(d, x, numbers[x.sample] if x.sample else np.ones(run.num_rows, dtype=bool)) for d, x in designs.items()]
                parts: dict[tuple, R.Part] = {}
                for d, design, mask in members:
                    gone = [missing[x] for x in (*design.dense, *design.needs)]
                    mask = mask & ~np.logical_or.reduce(gone)
                    # designs often use the same rows
                    key = np.packbits(mask).tobytes()
                    if key not in parts:
                        parts[key] = R.Part(mask, own)
                    part = parts[key]
                    if part.n:
                        s = _sums(part, [numbers[x] for x in design.dense], labels, numbers.get("_w"), levels)
                        found[d] = found[d] + s if d in found else s
        for d, s in found.items():
            yield s.row(d)

    return work


def _merged(rows):
    import pandas as pd

    out = None
    for _, r in rows.iterrows():
        one = Sums.read(r)
        out = one if out is None else out + one
    return pd.DataFrame(out.row(rows["design"].iloc[0]))


def within(rows: DataFrame, design: str | dict[str, Design], cluster: str, dense: list[str], blocks: list[str], weight: str | None = None) -> dict[str, Within]:
    """The products within clusters of every design. The first dense column is the exposure whose variation is counted.

    design: a column that names it, in rows that are one a unit and design that it belongs to; or the designs by name, in rows
    that are one a unit, so that a unit moves once however many designs it is in. dense are then the names for their columns.
    """
    listed = None if isinstance(design, str) else design
    columns = dense if listed is None else list(dict.fromkeys(x for d in listed.values() for x in (*d.dense, *d.needs)))
    flags = [] if listed is None else list(dict.fromkeys(d.sample for d in listed.values() if d.sample))
    label = lambda kind, names: {x: f"{kind}{i}" for i, x in enumerate(names)}
    to_column, to_flag, to_block = label("x", columns), label("f", flags), label("b", blocks)
    base = rows.where(F.col(cluster).isNotNull())
    for b in blocks:
        base = base.where(F.col(b).isNotNull())
    if weight:
        base = base.where(R.number(weight) > 0)
    if listed is None:
        base = base.where(F.col(design).isNotNull())
    base = base.select(F.col(cluster).alias(R.CLUSTER), *([F.col(design).cast("string").alias("_d")] if listed is None else []), *([R.number(weight).alias("_w")] if weight else []), *[R.number(x).alias(k) for x, k in to_column.items()], *[F.col(x).alias(k) for x, k in to_flag.items()], *[F.col(x).alias(k) for x, k in to_block.items()])
    after = [F.col(x).cast("string").alias(x) if x in to_block.values() else F.col(x) for x in base.columns]
    if listed is None:
        work = _level_sums(None, list(to_column.values()), list(to_block.values()))
    else:
        own = {k: Design(tuple(to_column[x] for x in d.dense), to_flag.get(d.sample), tuple(to_column[x] for x in d.needs)) for k, d in listed.items()}
        work = _level_sums(own, [f"x{i}" for i in range(len(dense))], list(to_block.values()))
    done = stored(R.dealt(base, work, SUMS, *after), "design-sums").groupBy("design").applyInPandas(_merged, SUMS)
    out, levels = {}, 0
    for r in done.collect():
        s = Sums.read(r)
        # a level that no row of the design has is no column of it
        keep = [i for i in range(len(s.names)) if i < len(dense) or s.mean[i] > 0]
        names = [*dense, *[f"{blocks[int(k[1:])]}={v}" for k, _, v in (s.names[i].partition("=") for i in keep[len(dense) :])]]
        order = [*range(len(dense)), *sorted(range(len(dense), len(names)), key=lambda i: names[i])]
        at = [keep[i] for i in order]
        levels += len(at) - len(dense)
        if levels > MOST_LEVELS:
            raise ValueError(f"over {MOST_LEVELS} levels")
        out[r["design"]] = Within([names[i] for i in order], s.gram[np.ix_(at, at)], s.spread[at], s.n, s.w, s.clusters, s.singletons, s.varying)
    return out


def residual_gaps(rows: DataFrame, cluster: str, dense: list[str], block: str, weight: str, pairs: list[tuple[dict[str, float], dict[str, float]]]) -> list[float]:
    """For each pair of projections of one target, the largest absolute difference, times the root of the weight, of their
    residuals over all rows.

    A projection's coefficients are by name (dense columns, "block=level"). The target cancels out, so a row's difference is the
    demeaned value of the difference of the projections; it is computed row by row, and only the largest comes back.
    """
    gaps = [{x: a.get(x, 0.0) - b.get(x, 0.0) for x in {*a, *b}} for a, b in pairs]
    on_dense = np.array([[g.get(x, 0.0) for x in dense] for g in gaps])
    on_level = [{x.removeprefix(f"{block}="): v for x, v in g.items() if x.startswith(f"{block}=")} for g in gaps]
    base = rows.select(F.col(cluster).alias(R.CLUSTER), R.number(weight).alias("_w"), *[R.number(x).alias(f"x{i}") for i, x in enumerate(dense)], F.col(block).cast("string").alias("_b")).na.drop().where("_w > 0")

    def work(runs):
        most = np.zeros(len(gaps))
        for run, starts in runs:
            part, w = R.Part(np.ones(run.num_rows, dtype=bool), R.cluster_numbers(starts, run.num_rows)), R.values(run.column("_w"))
            middle = lambda v: part.spread_out(part.sums(w * v) / part.sums(w))  # noqa: E731, B023
            x = np.array([R.values(run.column(f"x{i}")) for i in range(len(dense))])
            # around a value of their cluster, then around its mean
            x = x - part.spread_out(x[:, part.starts])
            x = x - middle(x)
            coded = run.column("_b").combine_chunks().dictionary_encode()
            for k, level in enumerate(on_level):
                d = on_dense[k] @ x + np.array([level.get(v, 0.0) for v in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
                most[k] = max(most[k], float((np.sqrt(w) * np.abs(d - middle(d))).max()))
        yield {"pair": list(range(len(gaps))), "gap": most.tolist()}

    found = dict(R.dealt(base, work, "pair int, gap double").groupBy("pair").agg(F.max("gap")).collect())
    return [found.get(k) or 0.0 for k in range(len(gaps))]


@dataclass
class Coding:
    """What one coding of a block leaves: rank of all nuisances, coefficients of each outcome on x, length of x's residual."""

    rank: int
    beta: dict[str, float]
    residual_norm: float
    coefficients: dict[str, float]


@dataclass
class Comparison:
    """ranks: of either coding and of both together, alone and given the controls; gap: the largest of x's residuals; equal: the
    codings are one nuisance space, by ranks and by residuals."""

    n: int
    clusters: int
    alone: tuple[int, int, int]
    given: tuple[int, int, int]
    codings: dict[str, Coding]
    gap: float

    @property
    def relative_gap(self) -> float:
        norm = next(iter(self.codings.values())).residual_norm
        return self.gap / norm if norm else float("nan")

    @property
    def equal(self) -> bool:
        return len(set(self.given)) == 1 and self.relative_gap < 1e-8


def compare_codings(rows: DataFrame, cluster: str, outcomes: list[str], x: str, modes: dict[str, list[str]], block: str, codings: dict[str, list[str]], weight: str) -> dict[str, Comparison]:
    """Two codings of one block (name: the levels that have a column) as nuisances of x, for each mode of controls.

    x itself never enters the spaces that are compared. All modes and outcomes share one pass over the rows, and one more for the
    residuals.
    """
    controls = list(dict.fromkeys(c for names in modes.values() for c in names))
    dense = [x, *outcomes, *controls]
    g = within(rows.withColumn("_one_design", F.lit("all")), "_one_design", cluster, dense, [block], weight)["all"]
    columns = {k: [f"{block}={v}" for v in levels] for k, levels in codings.items()}
    sets = [*columns.values(), list(dict.fromkeys(v for names in columns.values() for v in names))]
    left = {}
    for mode, own in modes.items():
        found = left[mode] = {}
        for name, levels in columns.items():
            nuisance = g.survive([*own, *levels])
            rest = float(g.left(nuisance)[0, 0])
            found[name] = Coding(g.rank(nuisance), {y: g.partial(y, x, nuisance) for y in outcomes}, float(np.sqrt(max(rest, 0.0))), dict(zip(nuisance, g.coefficients(x, nuisance).tolist(), strict=True)))
    gaps = residual_gaps(rows, cluster, dense, block, weight, [tuple(coding.coefficients for coding in found.values()) for found in left.values()])
    ranks = tuple(g.rank(c) for c in sets)
    return {mode: Comparison(g.n, g.clusters, ranks, tuple(g.rank(c, modes[mode]) for c in sets), found, gap) for (mode, found), gap in zip(left.items(), gaps, strict=True)}
