"""The guard over a stream of events, and findings reported once across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import guard


def decision_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions on the JSON lines that arrive in folder; no state, so it scales with the partitions of the source."""
    return guard.decisions(guard.parsed(spark.readStream.text(folder)))


def new_findings(findings: DataFrame, *, time_col: str = "ts", keep: str = "7 days") -> DataFrame:
    """Findings (fp, ts, …) whose fingerprint has not been seen within keep: state is bounded by the watermark."""
    return findings.withWatermark(time_col, keep).dropDuplicatesWithinWatermark(["fp"])


def hourly_decisions(decided: DataFrame, *, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Decisions by hour, late events up to an hour."""
    return decided.withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour").alias("w"), "decision").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("hour"), "decision", "n")
