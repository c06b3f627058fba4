"""A weighted logistic model of tabular samples, fitted for all grouped folds at once.

A fold's model sees the rows of all other folds. Counts, moments and medians are taken by fold once and put together for
each model; a Newton step sums every model's gradient and Hessian in one pass over the rows, in the tasks that hold them.
What comes to the driver depends on the numbers of folds and columns, never of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.evaluate import metric_columns
from tidegrid.operators.ranges import edges, running

# Fixed value: what a missing category is called.
MISSING = "__missing__"
#: Bounds on what a model's columns may be: categories of one column, and folds fitted in one pass.
MOST_CATEGORIES, MOST_FOLDS = 1000, 32


def with_folds(rows: DataFrame, match: str, folds: int, name: str = "fold") -> DataFrame:
    """rows with a fold from 0 by a hash of the match: a match is in one fold, and stays there when others come."""
    return rows.withColumn(name, F.pmod(F.xxhash64(F.col(match).cast("string")), F.lit(folds)).cast("int"))


@dataclass(frozen=True)
class Encoder:
    """Columns of a model: numbers (their medians in place of what is missing), a mark for each number that was missing
    somewhere, both standardised, and categories, one column each; an unknown category has none.
    """

    numeric: tuple[str, ...]
    marked: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    categories: tuple[tuple[str, ...], ...]

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *(f"missing:{c}" for c in self.marked), *(f"{c}={v}" for c, values in zip(self.categorical, self.categories, strict=True) for v in values)]

    def matrix(self, numbers: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray:
        raw = [np.where(np.isnan(numbers[c]), m, numbers[c]) for c, m in zip(self.numeric, self.medians, strict=True)]
        raw += [np.isnan(numbers[c]).astype(float) for c in self.marked]
        scaled = (np.column_stack(raw) - self.centre) / self.scale if raw else np.zeros((_rows(numbers, texts), 0))
        hot = [texts[c] == v for c, values in zip(self.categorical, self.categories, strict=True) for v in values]
        return np.column_stack([scaled, *hot]).astype(float)


def _rows(numbers: dict, texts: dict) -> int:
    return len(next(iter([*numbers.values(), *texts.values()])))


@dataclass(frozen=True)
class Model:
    encoder: Encoder
    coefficients: np.ndarray  # of the encoder's columns, then the intercept

    def terms(self, numbers: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray:
        return self.encoder.matrix(numbers, texts) * self.coefficients[:-1]

    def score(self, numbers: dict[str, np.ndarray], texts: dict[str, np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.terms(numbers, texts).sum(axis=1) + self.coefficients[-1], -500, 500)))


def _number(c: str) -> Column:
    """A number, or null where it is missing or not finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(MISSING))


def _prepared(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str, keep: Sequence[Column] = ()) -> DataFrame:
    return rows.select(*keep, F.col(fold).cast("string").alias("__f"), *(_number(c).alias(f"n{k}") for k, c in enumerate(numeric)), *(_text(c).alias(f"c{k}") for k, c in enumerate(categorical)))


def encoders(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fold: str = "fold") -> dict[str | None, Encoder]:
    """fold -> the encoder of all other folds' rows, and None -> that of all rows. A fold is a text here, null included as ''.

    A number that is missing in all of a model's rows is not among its columns. Medians are exact: values are counted by
    fold, and the counts summed in order, range by range.
    """
    base = _prepared(rows, numeric, categorical, fold).withColumn("__f", F.coalesce("__f", F.lit("")))
    each = base.select("__f", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("v")) for k in range(len(numeric))))).alias("x")).select("__f", "x.*") if numeric else None
    counted = {r[0]: r[1] for r in base.groupBy("__f").count().limit(MOST_FOLDS + 1).collect()}
    if len(counted) > MOST_FOLDS:
        raise ValueError(f"more than {MOST_FOLDS} folds")
    folds = sorted(counted)
    models: list[str | None] = [*folds, None]
    moments = {}
    if each is not None:
        known = each.filter(F.col("v").isNotNull())
        for r in known.groupBy("__f", "k").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2")).collect():
            moments[r["__f"], r.k] = (r.n, r.mean, r.m2)
        medians = _medians(known, folds)
    values: dict[int, dict[str, dict[str, int]]] = {}
    for k in range(len(categorical)):
        found = base.groupBy("__f", f"c{k}").count().limit(MOST_CATEGORIES * len(folds) + 1).collect()
        if len(found) > MOST_CATEGORIES * len(folds):
            raise ValueError(f"more than {MOST_CATEGORIES} categories in {categorical[k]}")
        values[k] = {}
        for f, v, n in found:
            values[k].setdefault(v, {})[f] = n
    out: dict[str | None, Encoder] = {}
    for m in models:
        mine = [f for f in folds if f != m]
        total = sum(counted[f] for f in mine)
        kept, marked, mid, centre, scale, mark = [], [], [], [], [], []
        for k, c in enumerate(numeric):
            n, mean, m2 = _merged([moments[f, k] for f in mine if (f, k) in moments])
            if n == 0:
                continue
            middle = medians[m, k]
            # what is missing counts as the median
            _, mean, m2 = _merged([(n, mean, m2), (total - n, middle, 0.0)] if total > n else [(n, mean, m2)])
            kept.append(c)
            mid.append(middle)
            centre.append(mean)
            scale.append(np.sqrt(m2 / total) or 1.0)
            if total > n:
                share = (total - n) / total
                marked.append(c)
                mark.append((share, np.sqrt(share * (1 - share)) or 1.0))
        categories = tuple(tuple(sorted(v for v, by in values[k].items() if any(by.get(f) for f in mine))) for k in range(len(categorical)))
        out[m] = Encoder(tuple(kept), tuple(marked), tuple(categorical), np.array(mid), np.array(centre + [x for x, _ in mark]), np.array(scale + [x for _, x in mark]), categories)
    return out


def _merged(parts: list[tuple[int, float, float]]) -> tuple[int, float, float]:
    """Count, mean and sum of squared distances of several parts together."""
    n, mean, m2 = 0, 0.0, 0.0
    for k, a, s in parts:
        d, both = a - mean, n + k
        n, mean, m2 = both, mean + d * k / both, m2 + s + d * d * n * k / both
    return n, mean, m2


def _medians(known: DataFrame, folds: list[str]) -> dict[tuple[str | None, int], float]:
    """(model, number's place) -> the median of its rows: the mean of the two values in the middle."""
    pivot = [F.sum(F.when(F.col("__f") == f, F.col("n"))).alias(f"f{i}") for i, f in enumerate(folds)]
    by_value = known.groupBy("__f", "k", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("k", "v").agg(F.sum("n").alias("all"), *pivot)
    sums = [f"f{i}" for i in range(len(folds))]
    by_value = by_value.select("k", "v", F.col("all"), *((F.col("all") - F.coalesce(c, F.lit(0))).alias(c) for c in sums))
    ran = running(by_value, ["k"], "v", ["all", *sums], edges(known, "v"))
    middle = []
    for c in ["all", *sums]:
        reach = lambda rank, c=c: F.min(F.when(F.col(f"before_{c}") + F.col(c) >= rank, F.col("v")))
        total = F.col(f"total_{c}")
        middle.append(((reach(F.floor((total + 1) / 2)) + reach(F.floor(total / 2) + 1)) / 2).alias(c))
    out = {}
    for r in ran.groupBy("k").agg(*middle).collect():
        out |= {(None, r.k): r["all"]} | {(f, r.k): r[f"f{i}"] for i, f in enumerate(folds)}
    return out


def _arrays(batch: pa.RecordBatch, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[dict, dict]:
    numbers = {c: batch.column(f"n{k}").to_numpy(zero_copy_only=False).astype(float) for k, c in enumerate(numeric)}
    return numbers, {c: batch.column(f"c{k}").to_numpy(zero_copy_only=False) for k, c in enumerate(categorical)}


def fit(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), fold: str = "fold", label: str = "y", weight: str = "w", penalty: float = 1.0, steps: int = 50, tolerance: float = 1e-9) -> dict[str | None, Model]:
    """fold -> the model of all other folds' rows, and None -> that of all rows.

    Weighted logistic regression whose coefficients, without the intercept, are held by half their squares' sum times
    penalty; labels 0 and 1. Rows with a null label or weight take no part. Newton steps, each halved while the loss of
    any model would rise; it ends when no step is above tolerance. Fails if that takes more than `steps` passes, or if a
    model has no rows.
    """
    known = rows.filter(F.col(label).isin(0, 1) & F.col(weight).isNotNull())
    coders = encoders(known, numeric, categorical, fold)
    if len(coders) < 2:
        raise ValueError("no rows to fit")
    data = _prepared(known, numeric, categorical, fold, [F.col(label).cast("double").alias("y"), F.col(weight).cast("double").alias("w")]).persist()
    keys = list(coders)
    size = {m: len(coders[m].names) + 1 for m in keys}
    beta = {m: np.zeros(size[m]) for m in keys}
    move = {m: np.zeros(size[m]) for m in keys}
    last = dict.fromkeys(keys, np.inf)
    try:
        for _ in range(steps):
            loss, gradient, hessian = _sums(data, coders, {m: beta[m] + move[m] for m in keys}, numeric, categorical, penalty)
            for m in keys:
                if loss[m] > last[m] + 1e-12 * abs(last[m]):
                    move[m] = move[m] / 2
                    continue
                beta[m], last[m] = beta[m] + move[m], loss[m]
                move[m] = -np.linalg.solve(hessian[m], gradient[m])
            if max(np.abs(move[m]).max() for m in keys) < tolerance:
                return {m: Model(coders[m], beta[m]) for m in keys}
    finally:
        data.unpersist()
    raise ValueError(f"no end after {steps} steps")


def _sums(data: DataFrame, coders: dict, beta: dict, numeric: Sequence[str], categorical: Sequence[str], penalty: float):
    """Loss, gradient and Hessian of each model, all in one pass."""
    keys = list(coders)
    widths = [1 + len(beta[m]) + len(beta[m]) ** 2 for m in keys]
    starts = np.cumsum([0, *widths])

    def partial(batches):
        acc = np.zeros(starts[-1])
        for batch in batches:
            numbers, texts = _arrays(batch, numeric, categorical)
            own = batch.column("__f").to_pylist()
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "w"))
            for i, m in enumerate(keys):
                mine = np.array([(f or "") != m for f in own]) if m is not None else np.ones(len(own), bool)
                x = np.column_stack([coders[m].matrix(numbers, texts), np.ones(len(own))])[mine]
                z = x @ beta[m]
                q = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                loss = (w[mine] * (np.logaddexp(0, z) - y[mine] * z)).sum()
                acc[starts[i] : starts[i + 1]] += np.r_[loss, x.T @ (w[mine] * (q - y[mine])), ((x * (w[mine] * q * (1 - q))[:, None]).T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc))), pa.array(acc)], names=["at", "v"])

    got = np.zeros(starts[-1])
    for r in data.mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # some numbers for each model
        got[r["at"]] = r.v
    loss, gradient, hessian = {}, {}, {}
    for i, m in enumerate(keys):
        own, d = got[starts[i] : starts[i + 1]], len(beta[m])
        held = np.r_[beta[m][:-1], 0]
        loss[m] = own[0] + penalty * (held**2).sum() / 2
        gradient[m] = own[1 : 1 + d] + penalty * held
        hessian[m] = own[1 + d :].reshape(d, d) + penalty * np.diag(np.r_[np.ones(d - 1), 0])
    return loss, gradient, hessian


def with_predictions(rows: DataFrame, models: dict[str | None, Model], numeric: Sequence[str], categorical: Sequence[str] = (), fold: str | None = "fold", name: str = "p") -> DataFrame:
    """rows with the probability of label 1: out of fold, by the model that has not seen the row's fold. fold None: by the
    model of all rows; so too where no model is of the row's fold. Every row gets one.
    """
    base = rows.withColumn("__one", F.lit(None).cast("string")) if fold is None else rows
    data = _prepared(base, numeric, categorical, fold or "__one", [F.struct(*rows.columns).alias("__row")])
    kinds = data.select("__row").schema

    def run(batches):
        for batch in batches:
            numbers, texts = _arrays(batch, numeric, categorical)
            own = np.array([f or "" for f in batch.column("__f").to_pylist()], dtype=object)
            out = np.zeros(batch.num_rows)
            for f in set(own.tolist()):
                here = own == f
                model = models.get(f) if fold is not None else None
                out[here] = (model or models[None]).score({c: v[here] for c, v in numbers.items()}, {c: v[here] for c, v in texts.items()})
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(out)], names=["__row", name])

    return data.mapInArrow(run, kinds.add(name, "double")).select("__row.*", name)


def coefficients(models: dict[str | None, Model]) -> list[tuple[str | None, str, float]]:
    """(fold, column, coefficient); the intercept's column is its name."""
    return [(m, c, float(b)) for m, model in models.items() for c, b in zip([*model.encoder.names, "intercept"], model.coefficients, strict=True)]


def explained(rows: DataFrame, model: Model, groups: dict[str, str], numeric: Sequence[str], categorical: Sequence[str] = (), weight: str = "w", other: str = "other") -> DataFrame:
    """(group, mean_abs): the weighted mean of the absolute sum of each group's terms of the log odds.

    groups: input column -> group; its mark and its categories go with it. Terms add up to the log odds less the intercept.
    """
    columns = [c.removeprefix("missing:") if c.startswith("missing:") else c.partition("=")[0] if c.partition("=")[0] in categorical else c for c in model.encoder.names]
    owner = [groups.get(c, other) for c in columns]
    names = sorted(set(owner))
    pick = np.array([[o == g for g in names] for o in owner], float)
    data = _prepared(rows.withColumn("__one", F.lit("")), numeric, categorical, "__one", [F.col(weight).cast("double").alias("w")])

    def run(batches):
        total, weights = np.zeros(len(names)), 0.0
        for batch in batches:
            w = batch.column("w").to_numpy(zero_copy_only=False)
            total += w @ np.abs(model.terms(*_arrays(batch, numeric, categorical)) @ pick)
            weights += w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([weights] * len(names), pa.float64())], names=["group", "s", "w"])

    sums = data.mapInArrow(run, "group string, s double, w double")
    return sums.groupBy("group").agg((F.sum("s") / F.sum("w")).alias("mean_abs"))


def suite(rows: DataFrame, specs: dict[str, tuple[Sequence[str], Sequence[str], float]], fold: str = "fold", label: str = "y", weight: str = "w") -> DataFrame:
    """rows with a column for each candidate: its out-of-fold probability. specs: name -> (numbers, categories, penalty).

    All candidates see the same folds, so that their predictions can be compared pair by pair.
    """
    out = rows
    for name, (numeric, categorical, penalty) in specs.items():
        made = fit(rows, numeric, categorical, fold, label, weight, penalty)
        out = with_predictions(out, made, numeric, categorical, fold, name)
    return out


def chosen_penalty(rows: DataFrame, penalties: Sequence[float], numeric: Sequence[str], categorical: Sequence[str] = (), outer: str = "fold", match: str = "match", inner: int = 3, label: str = "y", weight: str = "w") -> DataFrame:
    """(fold, penalty, log_loss, chosen): for each outer fold the weighted log loss of each penalty over inner folds of the
    other folds' rows, by match; the least is chosen, ties to the smaller penalty. The outer fold's rows are never seen.
    """
    found = None
    folds = sorted(r[0] for r in rows.select(F.col(outer).cast("string")).distinct().limit(MOST_FOLDS + 1).collect())
    for f in folds:
        rest = with_folds(rows.filter(F.col(outer).cast("string") != f), match, inner, "__inner")
        tried = suite(rest, {f"__p{k}": (numeric, categorical, p) for k, p in enumerate(penalties)}, "__inner", label, weight)
        for k, p in enumerate(penalties):
            one = tried.agg(*metric_columns(f"__p{k}", label, weight)).select(F.lit(f).alias("fold"), F.lit(float(p)).alias("penalty"), "log_loss")
            found = one if found is None else found.unionByName(one)
    best = found.groupBy(F.col("fold").alias("__f")).agg(F.min(F.struct("log_loss", "penalty")).alias("b"))
    return found.join(best, F.col("fold") == F.col("__f")).select("fold", "penalty", "log_loss", (F.col("penalty") == F.col("b.penalty")).alias("chosen"))
