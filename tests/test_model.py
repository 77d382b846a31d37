import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tariffscope.operators import strata
from tariffscope.plans import detect as dt
from tariffscope.plans import features as fe
from tariffscope.plans import model as ml
from tariffscope.session import staged
from tariffscope.sources import demo
from tests.test_plans import plan_of


def outcomes(spark, tn, fp, fn, tp):
    rows = [(0.0, 0.0)] * tn + [(0.0, 1.0)] * fp + [(1.0, 0.0)] * fn + [(1.0, 1.0)] * tp
    return spark.createDataFrame(rows, "label double, prediction double")


def test_confusion_report_and_business_numbers(spark):
    matrix = ml.confusion(outcomes(spark, 50, 5, 3, 12))
    assert matrix.first().asDict() == {"tn": 50, "fp": 5, "fn": 3, "tp": 12}
    report = {r["class"]: r for r in ml.class_report(matrix).collect()}
    assert report["Anomaly"]["precision"] == pytest.approx(12 / 17)
    assert report["Anomaly"]["recall"] == pytest.approx(12 / 15)
    assert report["accuracy"]["f1"] == pytest.approx(62 / 70)
    assert report["weighted avg"]["recall"] == pytest.approx(62 / 70)
    business = ml.business_metrics(matrix).first()
    assert business["catch_rate_pct"] == pytest.approx(80) and business["false_alarm_pct"] == pytest.approx(100 / 11)
    assert ml.business_metrics(ml.confusion(outcomes(spark, 3, 0, 0, 0))).first()["miss_rate_pct"] is None


def test_auc_counts_pairs(spark):
    rng = random.Random(5)
    rows = [(float(rng.random() < 0.4), float(rng.randint(0, 9))) for _ in range(200)]
    good, bad = [s for y, s in rows if y], [s for y, s in rows if not y]
    pairs = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ml.roc_auc(spark.createDataFrame(rows, "label double, score double")) == pytest.approx(pairs)


def test_class_weights_balance(spark):
    weights = {r["label"]: r["weight"] for r in ml.class_weights(outcomes(spark, 8, 0, 0, 2)).collect()}
    assert weights == {0.0: pytest.approx(0.625), 1.0: pytest.approx(2.5)}


def test_detection_run_is_repeatable_and_useful(spark, sample):
    tables = demo.audit_tables(spark, sample)
    daily = demo.weather_daily(spark, sample)
    first = dt.detect(tables, daily, trees=10, depth=6, run_time="2024-01-01 00:00:00")
    second = dt.detect(tables, daily, trees=10, depth=6, run_time="2024-01-01 00:00:00")
    mine, other = staged(first.findings, "a"), staged(second.findings, "b")
    assert mine.count() > 50 and mine.exceptAll(other).count() == 0
    assert mine.count() == mine.select("bill_id").distinct().count()  # one finding per bill
    short = first.scored.filter("account_bill_count < 12")
    assert short.filter("ml_flagged OR ml_anomaly_probability > 0").count() == 0
    scored = first.scored.filter("account_bill_count >= 12").select(
        F.col("is_anomaly_detected").cast("double").alias("label"), F.col("ml_anomaly_probability").alias("score")
    )
    assert ml.roc_auc(scored) > 0.8
    assert ml.feature_importance(spark, first.model).count() == 12
    totals = ml.scoring_totals(first.scored).first()
    assert totals["bills"] == first.scored.count() and totals["skipped"] == short.count()


@pytest.mark.parametrize("few", [1000, 2])
def test_strata_are_exact(spark, monkeypatch, few):
    """The same when cells are refined down to a row or two."""
    monkeypatch.setattr(strata, "FEW", few)
    rows = spark.range(5003).select("id", (F.col("id") % 7 == 0).cast("double").alias("label"), strata.row_hash(F.col("id"), 3).alias("h"))
    ranks = {0.0: [0, 1, 800, 4288], 1.0: [143, 715]}
    found = strata.cuts(rows, "label", "id", "h", ranks)
    for label, wanted in ranks.items():
        ordered = sorted((r["h"], r["id"]) for r in rows.filter(F.col("label") == label).collect())
        assert [found[label, k] for k in wanted] == [ordered[k - 1] if k else (-1, -1) for k in wanted]
    above = rows.filter(strata.above(found, "label", "id", "h", {0.0: 800, 1.0: 143})).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in above} == {0.0: 4288 - 800, 1.0: 715 - 143}


def test_equal_hashes_are_cut_by_key(spark):
    rows = spark.range(50).select("id", F.lit(1.0).alias("label"), F.lit(77).cast("long").alias("h"))
    assert strata.cuts(rows, "label", "id", "h", {1.0: [20]}) == {(1.0, 0): (-1, -1), (1.0, 20): (77, 19)}
    assert strata.cuts(rows.filter("id < 0"), "label", "id", "h", {}) == {}


def test_forest_does_not_depend_on_how_rows_come(spark, sample):
    frame = staged(ml.training_frame(fe.coded_features(demo.audit_tables(spark, sample))), "frame")
    shuffled = frame.repartition(7).orderBy(F.rand(5))
    assert ml.train(frame, 5, 6).toDebugString.split("\n", 1)[1] == ml.train(shuffled, 5, 6).toDebugString.split("\n", 1)[1]


def test_scoring_works_in_a_session_that_observes(spark, sample):
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    coded = fe.coded_features(demo.audit_tables(spark, sample))
    assert seen.get == {"n": 3} and ml.score_bills(coded, ml.train(ml.training_frame(coded), 3, 3)).count() == coded.count()


def test_a_fit_keeps_its_rows_and_their_nodes_and_grows_the_same_trees(spark, sample, monkeypatch):
    frame = staged(ml.training_frame(fe.coded_features(demo.audit_tables(spark, sample))), "frame")
    kept, plain = [], ml.forest
    monkeypatch.setattr(ml, "forest", lambda *a: kept.append(plain(*a)) or Fit(kept[-1]))

    class Fit:
        def __init__(self, of):
            self.of = of

        def fit(self, rows):
            assert rows.is_cached and self.of.getCacheNodeIds()
            return self.of.fit(rows)

    mine = ml.train(frame, 5, 6)
    walked = plain(5, 6).setCacheNodeIds(False).fit(ml.weighted(frame.filter("NOT holdout")))
    assert kept and mine.toDebugString.split("\n", 1)[1] == walked.toDebugString.split("\n", 1)[1]
    assert "md5" not in plan_of(ml.training_frame(fe.coded_features(demo.audit_tables(spark, sample))))
