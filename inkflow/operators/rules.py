"""Roll-ups of check rows: severity and status counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEVERITY = ["pass", "warning", "fail", "error"]


def severity_rollup(checks: DataFrame) -> DataFrame:
    """error over fail over warning over pass; info counts as pass."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("status")), F.lit(0))
    worst = F.greatest(F.max(rank), F.lit(1)).cast("int")
    return checks.groupBy("doc_id").agg(F.element_at(F.array(*map(F.lit, SEVERITY)), worst).alias("overall"))


def status_pivot(checks: DataFrame) -> DataFrame:
    return checks.groupBy("check_name").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in [*SEVERITY, "info"]])
