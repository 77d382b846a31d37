"""The full detection run: features, forest, weather, findings."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tariffscope.plans import features as fe
from tariffscope.plans import model as ml
from tariffscope.plans.batch import taken
from tariffscope.plans.features import MIN_HISTORY
from tariffscope.plans.findings import findings
from tariffscope.plans.weather import weather_table
from tariffscope.session import tune
from tariffscope.sources.store import write_batch
from tariffscope.sources.tables import AuditTables


@dataclass
class DetectionRun:
    findings: DataFrame
    scored: DataFrame
    model: RandomForestClassificationModel


def detect(
    tables: AuditTables, daily_weather: DataFrame, trees: int = ml.TREES, depth: int = ml.DEPTH,
    threshold: float = ml.FLAG_AT, run_time: str | None = None,
) -> DetectionRun:
    """Train on the labelled bills, score all of them and derive the findings.

    Fitting is the only step whose result passes through the driver (the trees).
    """
    tune(tables.bills.sparkSession)
    coded = fe.coded_features(tables)
    model = ml.train(ml.training_frame(coded), trees, depth)
    scored = ml.score_bills(coded, model, threshold)
    weather = weather_table(tables.bills, daily_weather)
    return DetectionRun(findings(scored, weather, run_time=run_time), scored, model)


def record_findings(
    scored: DataFrame, weather: DataFrame, store: str, batch_id: int, run_time: str | None = None, min_history: int = MIN_HISTORY
) -> dict[str, int | float | Decimal]:
    """Derive the findings of scored bills, write them as one run, and return what the write has counted on the way.

    Bills, flagged and skipped ones are counted as they are read, findings, severities
    and recovery as they are written: one pass for all. A part that is computed again
    after a lost executor may be counted again; the tables aren't affected.
    """
    bills, written = Observation("bills"), Observation("findings")
    counted = scored.observe(
        bills, F.count(F.lit(1)).alias("bills"), F.count_if("ml_flagged").alias("flagged"),
        F.count_if(F.col("account_bill_count") < min_history).alias("skipped"),
    )
    found = findings(counted, weather, min_history, run_time).observe(
        written, F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity") == "URGENT").alias("urgent"),
        F.count_if(F.col("severity") == "HIGH").alias("high"), F.sum("potential_recovery").alias("recovery"),
    )
    write_batch(found, store, "findings", batch_id)
    totals = taken(bills, ["bills", "flagged", "skipped"]) | taken(written, ["findings", "urgent", "high", "recovery"])
    return totals | {"flagged_pct": 100 * totals["flagged"] / totals["bills"] if totals["bills"] else 0.0}
