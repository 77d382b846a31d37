"""Plans: what is pushed down, what is never used, and how a hot account is handled."""

import datetime as dt
from contextlib import contextmanager

import pytest

from checks.queries import QUERIES
from tariffscope.operators.constraints import violations
from tariffscope.operators.star import bill_star
from tariffscope.plans import features as fe
from tariffscope.plans import reports as rp
from tariffscope.schemas import TableRules
from tariffscope.sources import demo
from tariffscope.sources.tables import AuditTables
from tests.test_features import bill


def plan_of(df):
    sql_utils = df.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return sql_utils.explainString(df._jdf.queryExecution(), "formatted")


SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    # Splitting works on map outputs, so the small files must not share a task.
    "spark.sql.files.maxPartitionBytes": "64KB",
    "spark.sql.files.openCostInBytes": "0",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@contextmanager
def small_limits(spark):
    """Make a few thousand rows count as a skewed partition."""
    for key, value in SMALL_LIMITS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in SMALL_LIMITS:
            spark.conf.unset(key)


@pytest.mark.parametrize("name", ["features", "findings", "dashboard_nested", "bill_intake", "constraint_violations", "compare_periods"])
def test_no_cross_join_and_no_python_rows(spark, sample, name):
    plan = plan_of(QUERIES[name].run(spark, sample))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def stored(spark, small_tables, tmp_path, bills):
    tables = small_tables(bills)
    for name, df in tables.present().items():
        df.write.parquet(f"{tmp_path}/{name}")
    return AuditTables(**{n: spark.read.parquet(f"{tmp_path}/{n}") for n in tables.present()})


def test_filters_and_columns_reach_the_scan(spark, small_tables, tmp_path):
    tables = stored(spark, small_tables, tmp_path, [bill(1, 100, dt.date(2020, 1, 1), "5.00")])
    plan = plan_of(rp.top_spenders(tables, "Gas", 2020))
    assert "EqualTo(utility_type,Gas)" in plan and "GreaterThanOrEqual(billing_date,2020-01-01)" in plan
    read = next(line for line in plan.splitlines() if "ReadSchema" in line and "total_amount" in line)
    assert "anomaly_reason" not in read and "source_file" not in read


def test_hot_account_is_split_at_the_joins(spark, small_tables, tmp_path):
    hot = [bill(n, 100, dt.date(2020, 1, 5), f"{n % 90 + 10}.00") for n in range(8000)]
    cold = [bill(10000 + n, 200, dt.date(2020, 1 + n % 12, 5), "20.00") for n in range(60)]
    tables = stored(spark, small_tables, tmp_path, hot + cold)
    tables.bills = spark.read.parquet(f"{tmp_path}/bills").repartition(8)
    with small_limits(spark):
        joined = bill_star(tables)
        assert len(joined.collect()) == 8060
        assert "(skew=true)" in plan_of(joined)
        features = fe.engineer(tables)
        rows = features.collect()
        assert "(skew=true)" in plan_of(features)
        assert "Window" not in plan_of(features)
    assert {r["account_bill_count"] for r in rows if r["account_id"] == 100} == {8000}


def test_constraints_scan_each_table_once_and_shuffle_once(spark, sample, tmp_path):
    tables = demo.audit_tables(spark, sample)
    stored = {}
    for name in ("clients", "properties", "vendors", "accounts"):
        getattr(tables, name).write.parquet(f"{tmp_path}/{name}")
        stored[name] = spark.read.parquet(f"{tmp_path}/{name}")
    plan = violations(stored)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 4 and plan.count("Exchange") == 1
    assert violations(stored).count() == 0


def test_constraints_of_keys(spark):
    rules = {
        "a": TableRules(required=("id",), unique=("id",), references={"up": ("b", "code")}),
        "b": TableRules(allowed={"kind": ("x",)}, references={"top": ("a", "id"), "gone": ("c", "id")}),
    }
    tables = {
        "a": spark.createDataFrame([(1, "p"), (1, "q"), (None, None), (3, "q")], "id int, up string"),
        "b": spark.createDataFrame([("p", "x", 1, 9), ("p", "y", 2, 9), ("r", "y", 2, 9), (None, None, None, 9)], "code string, kind string, top int, gone int"),
    }
    found = sorted(map(tuple, violations(tables, rules).collect()), key=repr)
    assert found == sorted([
        ("a", "NOT NULL", "id", None, 1), ("a", "UNIQUE", "id", "1", 2), ("a", "FOREIGN KEY", "up", "q", 2),
        ("b", "ALLOWED VALUES", "kind", "y", 2), ("b", "FOREIGN KEY", "top", "2", 2),
    ], key=repr)
