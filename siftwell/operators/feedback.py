"""Reuse of human corrections: a lookup by column type and normalised original value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SCHEMA = "feedback_id bigint, column_type string, original_value string, agent_output string, corrected_value string, created_at timestamp"
MOST = 500
#: Corrections beyond this many rows are joined by key instead of being broadcast.
BROADCAST_ROWS = 100_000


def key(value: Column) -> Column:
    """Trimmed, lower-cased, white space collapsed."""
    return strip(F.lower(F.regexp_replace(value, r"(?U)\s+", " ")))


def latest(corrections: DataFrame, column_type: str | None, most: int | None = MOST) -> DataFrame:
    """key, corrected_value: the most recently created correction of each key, among the ``most`` latest of the type."""
    own = corrections.where(F.col("column_type") == F.lit(column_type)).orderBy(F.desc("created_at"), F.desc("feedback_id"))
    own = own if most is None else own.limit(most)
    recent = F.struct("created_at", "feedback_id")
    return own.groupBy(key(F.col("original_value")).alias("key")).agg(F.max_by("corrected_value", recent).alias("corrected_value"))


def exact(corrections: DataFrame, column_type: str, original_value: str) -> DataFrame:
    """The correction of exactly this value of this type, if there is one."""
    return corrections.where((F.col("column_type") == F.lit(column_type)) & (F.col("original_value") == F.lit(original_value)))


def with_correction(df: DataFrame, value: str, found: DataFrame, out: str, rows: int | None = None) -> DataFrame:
    """Adds the correction of a column's value, or null. rows: how many corrections there are, where that is known to be
    small enough to broadcast."""
    side = found.select(F.col("key").alias(f"{out}_key"), F.col("corrected_value").alias(out))
    if rows is not None and rows <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return df.join(side, key(F.col(f"`{value}`")) == F.col(f"{out}_key"), "left").drop(f"{out}_key")


def upsert(corrections: DataFrame, changes: DataFrame) -> DataFrame:
    """corrections with changes (column_type, original_value, agent_output, corrected_value, created_at): a known pair keeps its
    id and its time of creation, a new one gets the next id."""
    pair = ["column_type", "original_value"]
    updated = corrections.join(changes.select(*pair, F.col("agent_output").alias("new_output"), F.col("corrected_value").alias("new_value")), pair, "left")
    kept = updated.select("feedback_id", *pair, F.when(F.col("new_value").isNotNull(), F.col("new_output")).otherwise(F.col("agent_output")).alias("agent_output"), F.coalesce("new_value", "corrected_value").alias("corrected_value"), "created_at")
    new = changes.join(corrections.select(*pair), pair, "left_anti")
    top = corrections.agg(F.coalesce(F.max("feedback_id"), F.lit(0))).scalar()
    numbered = new.withColumn("feedback_id", top + F.row_number().over(_by_time()))
    return kept.unionByName(numbered.select("feedback_id", *pair, "agent_output", "corrected_value", "created_at"))


def _by_time():
    from pyspark.sql import Window

    return Window.orderBy("created_at", "column_type", "original_value")  # over the few new corrections of one call
