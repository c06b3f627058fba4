"""Running sums, calibrators and the logistic model against plain computations."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import calibrate, evaluate, ranges


def scored(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        p = None if k % 37 == 5 else round(rng.random(), rng.choice([1, 2, 3, 8]))
        y = int(rng.random() < (0.5 if p is None else p**2))
        rows.append((k, k % 5, p, y, rng.choice([0.2, 1.0, 2.5])))
    rows += [(n, 1, 0.0, 0, 1.0), (n + 1, 2, 1.0, 1, 1.0), (n + 2, 2, 0.4, 1, 0.0)]
    return rows, spark.createDataFrame(rows, "id long, fold int, p double, y int, w double").repartition(6)


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(k, v, rng.randrange(9), rng.random()) for k in (None, "a", "b") for v in {round(rng.gauss(0, 5), 3) for _ in range(400)}]
    df = spark.createDataFrame(rows, "k string, v double, n long, x double")
    got = {(r.k, r.v): r for r in ranges.running(df, ["k"], "v", ["n", "x"]).collect()}
    for k, v, _, _ in rows:
        assert got[k, v].before_n == sum(r[2] for r in rows if r[0] == k and r[1] < v) and got[k, v].total_n == sum(r[2] for r in rows if r[0] == k)
        assert got[k, v].before_x == pytest.approx(sum(r[3] for r in rows if r[0] == k and r[1] < v), abs=1e-9)
    one = ranges.running(df.filter("k = 'a'").select("v", "n"), [], "v", ["n"]).orderBy("v").collect()
    assert [r.before_n for r in one] == [sum(x.n for x in one[:i]) for i in range(len(one))]
    assert ranges.running(df.filter("false"), ["k"], "v", ["n"]).count() == 0


def plain_isotonic(rows):
    """By the max-min formula over distinct scores."""
    by = {}
    for p, y, w in rows:
        if p is not None and w > 0:
            a = by.setdefault(p, [0.0, 0.0])
            a[0] += w
            a[1] += w * y
    xs = sorted(by)
    w, s = np.cumsum([0, *(by[x][0] for x in xs)]), np.cumsum([0, *(by[x][1] for x in xs)])
    return xs, [max(min((s[k] - s[j]) / (w[k] - w[j]) for k in range(i + 1, len(xs) + 1)) for j in range(i + 1)) for i in range(len(xs))]


def at(xs, values, p):
    return min(max(float(np.interp(p, xs, values)), 1e-6), 1 - 1e-6)


def test_isotonic_equals_the_formula(spark):
    rows, df = scored(spark)
    xs, values = plain_isotonic([r[2:] for r in rows])
    out = calibrate.with_isotonic(df, calibrate.isotonic(df)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.calibrated is None) == (r.p is None)
        if r.p is not None:
            assert r.calibrated == pytest.approx(at(xs, values, r.p), abs=1e-9)
    beyond = spark.createDataFrame([(-3.0,), (7.0,), (0.123456789,)], "p double")
    assert [r.calibrated for r in calibrate.with_isotonic(beyond, calibrate.isotonic(df)).orderBy("p").collect()] == pytest.approx([at(xs, values, p) for p in (-3, 0.123456789, 7)], abs=1e-9)
    assert calibrate.isotonic(df.filter("false")).count() == 0


def plain_sigmoid(rows):
    x = np.array([math.log(q / (1 - q)) for q in (min(max(r[0], 1e-6), 1 - 1e-6) for r in rows)])
    y, w, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(2)
    d = np.column_stack([x, np.ones(len(x))])
    for _ in range(100):
        q = 1 / (1 + np.exp(-d @ b))
        b = b - np.linalg.solve((d * (w * q * (1 - q))[:, None]).T @ d + np.diag([1.0, 0]), d.T @ (w * (q - y)) + np.array([b[0], 0]))
    return b


def test_cross_calibration_and_choice(spark):
    rows, df = scored(spark)
    out = calibrate.cross_calibrated(df)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    for f in range(5):
        fit = [r[2:] for r in rows if r[1] != f and r[2] is not None]
        (xs, values), (a, b) = plain_isotonic(fit), plain_sigmoid(fit)
        for r in (got[x[0]] for x in rows if x[1] == f and x[2] is not None):
            q = min(max(r.p, 1e-6), 1 - 1e-6)
            assert r.isotonic == pytest.approx(at(xs, values, r.p), abs=1e-9) and r.sigmoid == pytest.approx(1 / (1 + math.exp(-a * math.log(q / (1 - q)) - b)), abs=1e-7) and r.identity == r.p
    best = {r.method: r for r in calibrate.chosen(out).collect()}
    assert sum(r.chosen for r in best.values()) == 1 and min(best.values(), key=lambda r: (r.log_loss, r.method)).chosen and not best["identity"].chosen
    same = df.select("y", "w", *(F.lit(0.5).alias(m) for m in ("identity", "isotonic", "sigmoid")))
    assert [r.method for r in calibrate.chosen(same).filter("chosen").collect()] == ["identity"]


def test_auc_over_ranges(spark):
    rows, df = scored(spark)
    seen = [r for r in rows if r[2] is not None]
    pairs = [(a, b, wa * wb) for _, _, a, ya, wa in seen for _, _, b, yb, wb in seen if ya == 1 and yb == 0]
    want = sum(w * ((a > b) + (a == b) / 2) for a, b, w in pairs) / sum(w for *_, w in pairs)
    assert evaluate.auc(df, []).first().auc == pytest.approx(want, abs=1e-12)


def samples(spark, n=500, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.gauss(3, 2), rng.gauss(-1, 0.1)
        c = rng.choice(["x", "y", None, "rare" if k == 7 else "z"])
        y = int(rng.random() < 1 / (1 + math.exp(-(0.6 * a - 2 + (c == "x")))))
        rows.append((k, f"m{k % 23}", None if k % 9 == 0 else a, float("nan") if k % 23 == 4 and k % 2 else b, None if k % 23 < 20 else 1.0, c, y, rng.choice([0.5, 1.0, 3.0])))
    return spark.createDataFrame(rows, "id long, match string, a double, b double, c double, kind string, y int, w double").repartition(5)


NUMERIC, CATEGORICAL = ["a", "b", "c"], ["kind"]


def plain_model(train, test):
    """Design matrices and the Newton solution, by pandas and NumPy."""
    x, z = [], []
    for c in NUMERIC:
        if train[c].notna().sum() == 0:
            continue
        middle = train[c].median()
        for d, out in ((train, x), (test, z)):
            out.append(((c, 0), d[c].fillna(middle).to_numpy()))
            if train[c].isna().any():
                out.append(((c, 1), d[c].isna().to_numpy().astype(float)))
    order = sorted(range(len(x)), key=lambda i: (x[i][0][1], NUMERIC.index(x[i][0][0])))
    x, z = (np.column_stack([out[i][1] for i in order]) for out in (x, z))
    centre, scale = x.mean(0), x.std(0)
    scale[scale == 0] = 1
    hot = lambda d: np.column_stack([d.kind.fillna("__missing__") == v for v in sorted(set(train.kind.fillna("__missing__")))])
    x, z = (np.column_stack([(m - centre) / scale, hot(d), np.ones(len(d))]) for m, d in ((x, train), (z, test)))
    b, hold = np.zeros(x.shape[1]), np.diag(np.r_[np.ones(x.shape[1] - 1), 0])
    for _ in range(60):
        q = 1 / (1 + np.exp(-x @ b))
        b -= np.linalg.solve((x * (train.w * q * (1 - q)).to_numpy()[:, None]).T @ x + hold, x.T @ (train.w * (q - train.y)).to_numpy() + hold @ b)
    return b, 1 / (1 + np.exp(-z @ b)), z * b


def test_logistic_equals_a_plain_solution(spark):
    from tidegrid.operators import models

    df = models.with_folds(samples(spark), "match", 4)
    made = models.fit(df, NUMERIC, CATEGORICAL)
    plain = df.toPandas().sort_values("id")
    assert set(made) == {None, "0", "1", "2", "3"} and plain.groupby("match").fold.nunique().max() == 1
    out = models.with_predictions(df, made, NUMERIC, CATEGORICAL)
    assert out.columns == [*df.columns, "p"]
    got = {r.id: r.p for r in out.collect()}
    assert len(got) == len(plain)
    for f in (None, 0, 1, 2, 3):
        train, test = (plain, plain) if f is None else (plain[plain.fold != f], plain[plain.fold == f])
        b, p, terms = plain_model(train, test)
        model = made[None if f is None else str(f)]
        assert model.coefficients == pytest.approx(b, abs=1e-7)
        if f is not None:
            assert [got[k] for k in test.id] == pytest.approx(p, abs=1e-7)
        else:
            every = {r.id: r.p for r in models.with_predictions(df, made, NUMERIC, CATEGORICAL, fold=None).collect()}
            assert [every[k] for k in test.id] == pytest.approx(p, abs=1e-7)
            names = model.encoder.names
            part = np.abs(terms[:, [i for i, c in enumerate(names) if c.endswith("a")]].sum(1))
            found = {r.group: r.mean_abs for r in models.explained(df, model, {"a": "mine"}, NUMERIC, CATEGORICAL).collect()}
            assert found["mine"] == pytest.approx(np.average(part, weights=plain.w), abs=1e-7) and set(found) == {"mine", "other"}


def test_logistic_guards_and_one_match_out(spark):
    from tidegrid.operators import models

    df = samples(spark, 200)
    made = models.fit(df, ["a"], fold="match")  # each match is its own fold
    assert len(made) == 24 and models.with_predictions(df, made, ["a"], fold="match").filter("p is null").count() == 0
    with pytest.raises(ValueError, match="no rows"):
        models.fit(df.filter("false"), ["a"], fold="match")
    with pytest.raises(ValueError, match="categories"):
        models.fit(df.withColumn("kind", F.concat(F.col("id").cast("string"), F.lit("x"))).unionByName(spark.range(3000).select(F.col("id"), F.lit("m").alias("match"), *(F.lit(1.0).alias(c) for c in "abc"), F.col("id").cast("string").alias("kind"), F.lit(1).alias("y"), F.lit(1.0).alias("w"))).withColumn("f", F.lit(1)), ["a"], ["kind"], fold="f")
    with pytest.raises(ValueError, match="folds"):
        models.fit(df, ["a"], fold="id")


def test_suites_and_nested_choice(spark):
    from tidegrid.operators import models, reports

    df = models.with_folds(samples(spark, 240), "match", 3)
    specs = {"small": (["a"], [], 1.0), "whole": (NUMERIC, CATEGORICAL, 1.0)}
    out = models.suite(df, specs)
    for name, (numeric, categorical, penalty) in specs.items():
        alone = {r.id: r.p for r in models.with_predictions(df, models.fit(df, numeric, categorical, penalty=penalty), numeric, categorical).collect()}
        assert {r.id: r[name] for r in out.collect()} == pytest.approx(alone, abs=1e-9)
    assert reports.uncertainty(out, list(specs), "small", "match", rounds=10).count() == 6
    got = {(r.fold, r.penalty): r for r in models.chosen_penalty(df, [0.5, 50.0], ["a"], outer="fold").collect()}
    assert len(got) == 6
    for f in ("0", "1", "2"):
        rest = models.with_folds(df.filter(F.col("fold") != int(f)).drop("fold"), "match", 3)
        losses = {}
        for p in (0.5, 50.0):
            rows = models.with_predictions(rest, models.fit(rest, ["a"], penalty=p), ["a"])
            losses[p] = rows.agg(*evaluate.metric_columns("p", "y", "w")).first().log_loss
            assert got[f, p].log_loss == pytest.approx(losses[p], abs=1e-12)
        assert [p for p in losses if got[f, p].chosen] == [min(losses, key=lambda p: (losses[p], p))]
