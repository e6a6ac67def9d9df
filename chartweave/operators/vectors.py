"""Vectors: normalising, upserts, samples for an audit. Retrieval is in ``retrieval``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def upsert_points(existing: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Existing points with the incoming ones over them; of equal ids the last arrival wins."""
    last = Window.partitionBy("point_id").orderBy(F.col(arrival).desc())
    fresh = incoming.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth", arrival)
    return existing.join(fresh.select("point_id"), "point_id", "left_anti").unionByName(fresh)


def sample_for_audit(points: DataFrame, n: int) -> DataFrame:
    """Payloads of the first ``n`` points by id, without vectors."""
    return points.drop("embedding").orderBy("point_id").limit(max(n, 1))
