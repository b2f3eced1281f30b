"""Ridge regression for any subset of columns and any holdout, from one pass over a table of features.

The pass adds up products of all pairs of columns, of their marks of being known and of the target, for each combination of holdouts that a row
belongs to. A missing value is to count as its column's mean over the training rows, which isn't known while the pass runs; as the marks are in the
products too, means and deviations of any training range are applied to the sums afterwards, without the rows. Every model is then a solve of a part of one small matrix, and so is
its error over the validation rows. FAN tasks add up the sums of all
others as they come and the driver adds up theirs one by one; a sum's size depends on the number of columns alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourloom.operators.splits import HOLDOUTS, inside, known_before
from hourloom.schema import TARGET

#: Tasks that add up the sums of all others, and so the most sums of each combination that the driver gets.
FAN = 32


@dataclass
class Moments:
    """products of (columns where known, marks of known, target, 1) by combination of sets; bit i of a combination is sets[i]."""

    columns: list[str]
    sets: list[str]
    products: dict[int, np.ndarray]

    def of(self, name: str) -> np.ndarray:
        bit, width = 1 << self.sets.index(name), 2 * len(self.columns) + 2
        return sum((g for mask, g in self.products.items() if mask & bit), np.zeros((width, width)))


def moments(df: DataFrame, columns: list[str], target: str, sets: dict[str, Column]) -> Moments:
    """sets: conditions of rows by name; rows in none of them and rows without a target are left out."""
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(sets.values())), F.lit(0))
    rows = df.select(mask.alias("mask_"), F.col(target).cast("double").alias("target_"), *[F.col(f"`{c}`").cast("double").alias(f"x{i}_") for i, c in enumerate(columns)])
    rows = rows.filter("mask_ > 0 AND target_ IS NOT NULL AND NOT isnan(target_)")
    width = 2 * len(columns) + 2
    upper = np.triu_indices(width)
    schema = "mask int, part int, sums binary"

    def packed(sums: dict, part: int) -> Iterator[pa.RecordBatch]:
        for mask, g in sums.items():
            yield pa.record_batch([pa.array([mask], pa.int32()), pa.array([part], pa.int32()), pa.array([g.tobytes()], pa.binary())], names=["mask", "part", "sums"])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums: dict = {}
        for b in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], 1) if b.num_rows else np.zeros((0, width // 2))
            known = ~np.isnan(x[:, 1:])
            u = np.concatenate([np.where(known, x[:, 1:], 0), known, x[:, :1], np.ones((len(x), 1))], 1)
            masks = b.column(0).to_numpy()
            for m in np.unique(masks).tolist():
                own = u[masks == m]
                sums[m] = sums.get(m, 0) + (own.T @ own)[upper]
        yield from packed(sums, TaskContext.get().partitionId())

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for b in batches:
            for m, data in zip(b.column(0).to_pylist(), b.column(2)):
                sums[m] = sums.get(m, 0) + np.frombuffer(data.as_buffer())
        yield from packed(sums, 0)

    made = rows.mapInArrow(products, schema).repartition(FAN, "part").mapInArrow(added, schema)
    total: dict[int, np.ndarray] = {}
    for r in made.toLocalIterator():
        total[r["mask"]] = total.get(r["mask"], 0) + np.frombuffer(r["sums"])
    out = {}
    for m, flat in total.items():
        g = np.zeros((width, width))
        g[upper] = flat
        out[m] = g + np.triu(g, 1).T
    return Moments(columns, list(sets), out)


@dataclass
class Scale:
    """Means and deviations of training rows; a column without two different values has no part in any model."""

    mean: np.ndarray
    deviation: np.ndarray

    @staticmethod
    def of(g: np.ndarray) -> Scale:
        p = (len(g) - 2) // 2
        n, total, squares = g[p : 2 * p, -1], g[:p, -1], np.diag(g)[:p]
        with np.errstate(all="ignore"):
            mean = np.where(n > 0, total / n, 0)
            variance = (squares - n * mean**2) / (n - 1)
        usable = (n > 1) & (variance > 1e-12 * np.maximum(1, mean**2))
        return Scale(mean, np.where(usable, np.sqrt(np.where(usable, variance, 1)), np.inf))

    def applied(self, g: np.ndarray) -> np.ndarray:
        """Products of (standard scores, 0 where missing; target; 1)."""
        p = len(self.mean)
        to = np.zeros((p + 2, 2 * p + 2))
        to[np.arange(p), np.arange(p)] = 1 / self.deviation
        to[np.arange(p), p + np.arange(p)] = -self.mean / self.deviation
        to[p, 2 * p] = to[p + 1, 2 * p + 1] = 1
        return to @ g @ to.T


@dataclass
class Fit:
    """A model of standard scores."""

    columns: list[str]
    weights: np.ndarray
    intercept: float


def fit(scores: np.ndarray, columns: list[str], chosen: list[str], alpha: float) -> Fit:
    """Ridge with a free intercept, from products of training rows."""
    at = np.array([columns.index(c) for c in chosen], int)
    n = scores[-1, -1]
    mean = scores[-2, -1] / n
    centre = scores[at, -1] / n
    a = scores[np.ix_(at, at)] - n * np.outer(centre, centre)
    b = scores[at, -2] - n * centre * mean
    weights = np.linalg.solve(a + alpha * np.eye(len(at)), b) if len(at) else np.zeros(0)
    return Fit(chosen, weights, float(mean - weights @ centre))


def error(scores: np.ndarray, columns: list[str], model: Fit) -> float | None:
    """Root of the mean squared error, from products of validation rows; None without any."""
    n = scores[-1, -1]
    if not n:
        return None
    at = np.array([columns.index(c) for c in model.columns], int)
    w = np.r_[-model.weights, 1.0, -model.intercept]  # target less prediction
    own = scores[np.ix_(np.r_[at, len(columns), len(columns) + 1], np.r_[at, len(columns), len(columns) + 1])]
    return float(np.sqrt(max(0.0, w @ own @ w) / n))


def ablation(df: DataFrame, variants: dict[str, list[str]], base: str, alpha: float = 1.0, target: str = TARGET, holdouts: dict[str, tuple[str, str]] = HOLDOUTS, ts: str = "observation_timestamp") -> DataFrame:
    """variant, n_columns, rmse_* of each holdout, and accepted: whether the variant's ridge beats the base's in every holdout.

    variants: columns by name, e.g. of families. Training rows end before the holdout, their target's hour included; means and deviations are theirs. Predictions aren't clipped.
    One pass over df, whatever the number of variants."""
    columns = list(dict.fromkeys(c for own in variants.values() for c in own))
    sets = {f"{side} {h}": known_before(first, ts) if side == "train" else inside(first, end, ts) for h, (first, end) in holdouts.items() for side in ("train", "validate")}
    found = moments(df, columns, target, sets)
    errors: dict[str, list] = {v: [] for v in variants}
    for h in holdouts:
        train, validate = found.of(f"train {h}"), found.of(f"validate {h}")
        scale = Scale.of(train)
        scores, tested = scale.applied(train), scale.applied(validate)
        for v, own in variants.items():
            errors[v].append(error(tested, columns, fit(scores, columns, own, alpha)) if train[-1, -1] else None)
    won = lambda v: v != base and all(a is not None and b is not None and a < b for a, b in zip(errors[v], errors[base]))
    rows = [(v, len(own), *errors[v], won(v)) for v, own in variants.items()]
    return df.sparkSession.createDataFrame(rows, "variant string, n_columns int, " + ", ".join(f"rmse_{h} double" for h in holdouts) + ", accepted boolean")


def family_variants(families: dict[str, list[str]], base: list[str]) -> dict[str, list[str]]:
    """Variants of an ablation: the base families, the base with each other family, all, and all without each family that isn't in the base. Text columns are left out."""
    numeric = {f: own for f, own in families.items() if f != "STATION"}
    some = lambda chosen: [c for f, own in numeric.items() if f in chosen for c in own]
    others = [f for f in numeric if f not in base]
    out = {"base": some(base)} | {f"base + {f}": some([*base, f]) for f in others}
    return out | {"all": some(numeric)} | {f"all - {f}": some([g for g in numeric if g != f]) for f in others}
