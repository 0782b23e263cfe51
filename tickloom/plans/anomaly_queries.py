"""Queries of anomalies: hours of the event stream as metrics of a system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import anomalies
from tickloom.plans.base import Registry, rounded
from tickloom.sources.market import table

METRICS = ["requests", "errors", "mean_value", "users"]


def hours(spark, d: str) -> DataFrame:
    """Requests, share of errors, mean value and users of each hour."""
    e = table(spark, d, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts"))
    return e.agg(F.count("*").cast("double").alias("requests"), F.avg((F.col("event_type") == "error").cast("double")).alias("errors"), F.avg("value").alias("mean_value"), F.count_distinct("user_id").cast("double").alias("users"))


def register(reg: Registry) -> None:
    reg.add("anomaly_hours", lambda spark, d: rounded(anomalies.anomalies(hours(spark, d), METRICS)))

    def later(spark, d):
        """Hours of the second half scored by a forest of the first half."""
        rows = hours(spark, d)
        middle = F.lit("2024-01-16").cast("timestamp_ntz")
        return rounded(anomalies.alerts(anomalies.anomalies(rows.where(F.col("ts") >= middle), METRICS, rows.where(F.col("ts") < middle))))

    reg.add("anomaly_alerts", later)
    reg.add("anomaly_orders", lambda spark, d: rounded(anomalies.anomalies(table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.hour("o_orderdate").cast("double").alias("hour"), F.dayofyear("o_orderdate").cast("double").alias("day")), ["o_totalprice", "day"]).drop("hour")))
