import pytest
from pyspark.sql import functions as F

from tidegrid.operators import evaluate, reports


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, f"m{k % 4}", (k * 7 % 20) / 20, None if k % 9 == 0 else (k * 3 % 10) / 10, k % 3 % 2, 1.0 + k % 2, k) for k in range(80)]
    return spark.createDataFrame(data, "id int, match string, a double, b double, y int, w double, size int")


def test_evaluation_says_what_each_metric_says_alone(rows):
    slices = {"small": F.col("size") < 30, "even": F.col("size") % 2 == 0, "none": F.lit(None).cast("boolean")}
    got = {(r.model, r.part, r.slice, r.match): r for r in reports.evaluation(rows, ["a", "b"], slices, "match").collect()}
    assert len(got) == 2 * (1 + 2 + 4)
    for (model, part, name, match), r in got.items():
        own = rows if part == "all" else rows.filter(slices[name]) if part == "slice" else rows.filter(F.col("match") == match)
        m, area = evaluate.metrics(own, [], model).first(), evaluate.auc(own, [], model).first().auc
        ece = evaluate.calibration_error(evaluate.calibration(own, [], model), []).first().ece
        assert (r.rows, r.row_coverage) == (m.rows, m.row_coverage)
        assert [r.weight_coverage, r.log_loss, r.brier, r.accuracy, r.auc, r.ece] == pytest.approx([m.weight_coverage, m.log_loss, m.brier, m.accuracy, area, ece], abs=1e-12)


def test_uncertainty(rows):
    got = {(r.model, r.against, r.metric): r.value for r in reports.uncertainty(rows, ["a", "b"], "a", "match", rounds=20).collect()}
    assert set(got) == {(m, o, x) for m, o in (("a", None), ("b", None), ("b", "a")) for x in ("log_loss", "brier")}
    with pytest.raises(ValueError, match="not among"):
        reports.uncertainty(rows, ["a"], "c", "match")


def test_coverage(spark):
    kept = spark.createDataFrame([("x",)] * 3 + [("y",)], "match string")
    out = spark.createDataFrame([("x", "stale"), ("x", "stale"), ("x", None), ("z", "roster")], "match string, reason string")
    got = {r.match: (r.retained, r.rejected, r.candidates, r.fraction, r.reasons) for r in reports.coverage(kept, out, "match").collect()}
    assert got == {"x": (3, 3, 6, 0.5, {"stale": 2, "unknown": 1}), "y": (1, 0, 1, 1.0, {}), "z": (0, 1, 1, 0.0, {"roster": 1}), None: (4, 4, 8, 0.5, {"stale": 2, "unknown": 1, "roster": 1})}


def test_review(spark):
    attempts = spark.createDataFrame([("m", "r1", 0, 10, 100, "completed"), ("m", "r2", 0, 110, 200, "void")], "match string, round_id string, segment int, live_tick int, end_tick int, disposition string")
    points = [(20, 0.5, ["regular"], False), (30, 0.75, ["event-after"], False), (40, 0.6, ["regular"], False), (50, 0.7, ["event-after"], None), (60, 0.8, ["event-after"], True), (5, 0.1, ["regular"], False), (100, 0.9, ["event-after"], False)]
    p = spark.createDataFrame([("m", "r1", 0, *x) for x in points] + [("m", "r2", 0, 120, 0.5, ["regular"], False), ("m", "r1", 1, 70, 0.5, ["event-after"], False)], "match string, round_id string, segment int, tick int, p double, triggers array<string>, missing boolean")
    groups = [(20, 30, ["kill"]), (20, 40, ["kill"]), (None, 30, ["kill"]), (20, 50, ["kill"]), (20, 60, ["kill"]), (20, 100, ["kill"]), (20, 30, ["bomb-defused"]), (5, 30, ["kill"]), (20, 70, ["kill"])]
    g = spark.createDataFrame([("m", "r1", k, *x) for k, x in enumerate(groups)] + [("m", "r2", 99, 120, 130, ["kill"]), ("m", "r3", 98, 1, 2, ["kill"])], "match string, round_id string, n int, before_tick int, after_tick int, events array<string>")
    got = {r.n: (r.status, r.change) for r in reports.review(g, p, attempts, ["match"]).collect()}
    assert got == {
        0: ("ready", 25.0), 1: ("after-unconfirmed", None), 2: ("before-missing", None), 3: ("quality-unknown", None), 4: ("data-incomplete", None), 5: ("round-ended", None), 6: ("round-ended", None), 7: ("before-missing", None),
        8: ("after-unconfirmed", None), 99: ("round-unavailable", None), 98: ("round-unavailable", None),
    }
    shown = spark.createDataFrame([(1, None), (2, ["event-before"]), (3, ["event-before", "regular"]), (4, ["event-after"]), (5, [])], "n int, triggers array<string>")
    assert sorted(r.n for r in reports.visible(shown).collect()) == [1, 3, 4]
