"""Calibration of predicted probabilities: sigmoid and isotonic, fitted for all folds at once, and the choice among them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.scalar import clamp, logit, sigmoid
from tidegrid.operators import asof, evaluate, ranges

EDGE = evaluate.EDGE
# Names of the methods, which also settle ties.
IDENTITY, ISOTONIC, SIGMOID = "identity", "isotonic", "sigmoid"
#: Ranges whose blocks one task merges.
MERGED = 16


def others(rows: DataFrame, folds: Sequence, fold: str, name: str) -> DataFrame:
    """Each row once for each fold that it helps to fit: all but its own."""
    return rows.withColumn(name, F.explode(F.filter(F.array(*map(F.lit, folds)), lambda f: ~f.eqNullSafe(F.col(fold)))))


def isotonic(rows: DataFrame, keys: Sequence[str] = (), p: str = "p", y: str = "y", w: str = "w") -> DataFrame:
    """(keys, low, high, value): the blocks of the weighted isotonic regression of y on p, from low to high (inclusive).

    Rows with a null in p, y or w or a weight of zero take no part. Scores are summed first; each range of scores pools its
    adjacent violators in its own task, and neighbouring ranges' blocks are pooled again, 16 at a time, until none are left
    to compare. Pooling within a range is part of pooling the whole, so the order doesn't change the result. What the last
    task holds are the blocks, of which n labels of 0 and 1 have some n^(2/3) at most.
    """
    keys = list(keys)
    known = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull() & (F.col(w) > 0))
    sums = known.groupBy(*keys, F.col(p).cast("double").alias("low")).agg(F.sum(w).cast("double").alias("w"), F.sum(F.col(w) * F.col(y)).cast("double").alias("wy"))
    cuts = ranges.edges(known, p)
    blocks = sums.select(*keys, ranges.range_of(F.col("low"), cuts).alias("part"), "low", F.col("low").alias("high"), "w", "wy")
    names = [*keys, "part", "low", "high", "w", "wy"]

    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("low")
        stack: list[list[float]] = []
        for low, high, weight, total in frame[["low", "high", "w", "wy"]].to_numpy():
            stack.append([low, high, weight, total])
            # equal means pool too, so that blocks are strictly rising
            while len(stack) > 1 and stack[-2][3] * stack[-1][2] >= stack[-1][3] * stack[-2][2]:
                _, high, weight, total = stack.pop()
                stack[-1] = [stack[-1][0], high, stack[-1][2] + weight, stack[-1][3] + total]
        made = pd.DataFrame(stack, columns=["low", "high", "w", "wy"])
        return made.assign(**{k: frame[k].iloc[0] for k in [*keys, "part"]})[names]

    parts = len(cuts) + 1
    while True:
        blocks = blocks.groupBy(*keys, "part").applyInPandas(pool, blocks.select(*names).schema)
        if parts == 1:
            break
        blocks, parts = blocks.withColumn("part", F.floor(F.col("part") / MERGED).cast("int")), -(-parts // MERGED)
    return blocks.select(*keys, "low", "high", (F.col("wy") / F.col("w")).alias("value"))


def with_isotonic(rows: DataFrame, blocks: DataFrame, keys: Sequence[str] = (), p: str = "p", out: str = "calibrated", span: float = 0.05) -> DataFrame:
    """rows with the blocks' value at p: a block's within it, linear between two, the ends' beyond; clipped to (0, 1).

    A null p, and a key without blocks, gives null. An as-of join finds the block: scores are cut into stretches, so a key
    that many rows share is no one task's.
    """
    keys = list(keys)
    own = keys or ["__all"]
    add = lambda d: d if keys else d.withColumn("__all", F.lit(0))
    tag = [c for c in ("low", "high", "value") if c in rows.columns]
    if tag:
        raise ValueError(f"columns {tag} are taken")
    state = add(blocks).select(*own, F.col("low").alias("__p"), "low", "high", "value")
    probes = add(rows).withColumn("__p", F.col(p).cast("double"))
    back = asof.asof_join(probes, state, own, "__p", ["high", "value"], span=span).withColumnsRenamed({"high": "__ha", "value": "__va"})
    both = asof.asof_join(back, state, own, "__p", ["low", "value"], direction="forward", strict=True, span=span)
    a, b, h, nxt = F.col("__va"), F.col("value"), F.col("__ha"), F.col("low")
    value = F.when(a.isNull(), b).when(b.isNull() | (F.col("__p") <= h), a).otherwise(a + (b - a) * (F.col("__p") - h) / (nxt - h))
    made = F.when(F.col(p).isNotNull(), clamp(value, EDGE, 1 - EDGE))
    return both.withColumn(out, made).select(*rows.columns, out)


def sigmoids(rows: DataFrame, folds: Sequence, fold: str = "fold", p: str = "p", y: str = "y", w: str = "w", penalty: float = 1.0, steps: int = 50) -> dict:
    """fold -> (slope, intercept), and None -> that of all rows: logistic regression of y on the logit of p by Newton steps.

    The slope is held by half its square times penalty. A step sums six numbers for each fold, of all folds at once: each
    row counts for the folds that are not its own.
    """
    known = rows.filter(F.col(p).isNotNull() & F.col(y).isNotNull() & F.col(w).isNotNull())
    x, weight = logit(F.col(p).cast("double")), F.col(w).cast("double")
    base = known.select(F.col(fold).alias("f"), x.alias("x"), F.col(y).cast("double").alias("y"), weight.alias("w"))
    wanted = [*folds, None]
    beta = {f: np.zeros(2) for f in wanted}
    for _ in range(steps):
        sums = []
        for k, f in enumerate(wanted):
            a, b = map(float, beta[f])
            q = sigmoid(F.lit(a) * F.col("x") + F.lit(b))
            mine = F.col("w") * (F.lit(1.0) if f is None else (~F.col("f").eqNullSafe(F.lit(f))).cast("double"))
            r, v = mine * (q - F.col("y")), mine * q * (1 - q)
            sums += [F.sum(c).alias(f"{n}{k}") for n, c in (("ga", r * F.col("x")), ("gb", r), ("aa", v * F.col("x") * F.col("x")), ("ab", v * F.col("x")), ("bb", v))]
        got = base.agg(*sums).first()
        largest = 0.0
        for k, f in enumerate(wanted):
            if got[f"bb{k}"] is None or got[f"bb{k}"] == 0:
                continue
            gradient = np.array([got[f"ga{k}"] + penalty * beta[f][0], got[f"gb{k}"]])
            hessian = np.array([[got[f"aa{k}"] + penalty, got[f"ab{k}"]], [got[f"ab{k}"], got[f"bb{k}"]]])
            step = np.linalg.solve(hessian, gradient)
            step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-300))
            beta[f] -= step
            largest = max(largest, np.abs(step).max())
        if largest < 1e-10:
            break
    return {f: (float(b[0]), float(b[1])) for f, b in beta.items()}


def with_sigmoid(p: Column, fold: Column, fits: dict) -> Column:
    """The calibrated p of each row by its own fold's fit; by the fit of all rows where the fold has none."""
    made = lambda f: clamp(sigmoid(F.lit(fits[f][0]) * logit(p) + F.lit(fits[f][1])), 0.0, 1.0)
    out = made(None)
    for f in fits:
        if f is not None:
            out = F.when(fold.eqNullSafe(F.lit(f)), made(f)).otherwise(out)
    return F.when(p.isNotNull(), out)


def cross_calibrated(rows: DataFrame, fold: str = "fold", p: str = "p", y: str = "y", w: str = "w", most_folds: int = 64) -> DataFrame:
    """rows with identity, sigmoid and isotonic: p calibrated by what the other folds fit. Every row with a p gets all three.

    Folds are read first; more than most_folds are an error.
    """
    folds = sorted(r[0] for r in rows.select(fold).distinct().limit(most_folds + 1).collect())
    if len(folds) > most_folds:
        raise ValueError(f"more than {most_folds} folds")
    fits = sigmoids(rows, folds, fold, p, y, w)
    blocks = isotonic(others(rows, folds, fold, "__for"), ["__for"], p, y, w).withColumnRenamed("__for", fold)
    out = with_isotonic(rows, blocks, [fold], p, ISOTONIC)
    return out.withColumn(IDENTITY, F.col(p)).withColumn(SIGMOID, with_sigmoid(F.col(p), F.col(fold), fits))


def chosen(calibrated: DataFrame, keys: Sequence[str] = (), y: str = "y", w: str = "w") -> DataFrame:
    """(keys, method, log_loss, brier, accuracy, chosen): each method's weighted metrics; the least log loss is chosen, ties
    by name.
    """
    methods = (IDENTITY, ISOTONIC, SIGMOID)
    rows = calibrated.select(*keys, y, w, F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).cast("double").alias("q")) for m in methods))).alias("m")).select(*keys, y, w, "m.*")
    each = rows.groupBy(*keys, "method").agg(*evaluate.metric_columns("q", y, w))
    best = each.groupBy(*keys).agg(F.min(F.struct("log_loss", "method")).alias("__best"))
    joined = each.join(best, list(keys)) if keys else each.crossJoin(F.broadcast(best))  # the best is one row
    return joined.withColumn("chosen", F.col("method") == F.col("__best.method")).drop("__best")
