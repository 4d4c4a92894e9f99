"""Intervals, spans, islands, as-of lookups: window forms of the sequential operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers of each key: first, last."""
    distinct = rows.select(*by, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number))
    return distinct.withColumn("__run", run).groupBy(*by, "__run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("__run")


def union_length(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """For each key the length of the union of its intervals, and their plain sum."""
    w = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return rows.withColumn("__fresh", fresh).groupBy(*by).agg(F.sum("__fresh").cast("long").alias("wall"), F.sum(F.col(end) - F.col(start)).cast("long").alias("plain"))


def segments(rows: DataFrame, by: list[str], start: str) -> DataFrame:
    """Each segment's end: the next one's start, or null."""
    return rows.withColumn("segment_end", F.lead(start).over(Window.partitionBy(*by).orderBy(start)))


def overlaps(chunks: DataFrame, spans: DataFrame, by: str, chunk: str) -> DataFrame:
    """min(from), max(to) of the segments that overlap each chunk; keyed on the document, the range test inside it."""
    hit = chunks.join(spans, by).filter((F.col("seg_start") < F.col("chunk_end")) & (F.coalesce(F.col("seg_end"), F.col("chunk_end")) > F.col("chunk_start")))
    return hit.groupBy(by, chunk).agg(F.min("seg_from").alias("span_from"), F.max("seg_to").alias("span_to"))


def as_of(facts: DataFrame, marks: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """facts with the value of the latest mark at or before them: one sort per key, no range join."""
    both = facts.select(by, F.col(at).alias("__at"), F.lit(1).alias("__fact"), "id", F.lit(None).cast(dict(marks.dtypes)[value]).alias("__v")).unionByName(
        marks.select(by, F.col(at).alias("__at"), F.lit(0).alias("__fact"), F.lit(None).cast(dict(facts.dtypes)["id"]).alias("id"), F.col(value).alias("__v"))
    )
    w = Window.partitionBy(by).orderBy("__at", "__fact").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__fact = 1").select("id", value)


def parity(lines: DataFrame, by: str, at: str, mark: str) -> DataFrame:
    """Whether an odd number of marks stands before each line."""
    w = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("inside", F.coalesce(F.sum(F.col(mark).cast("int")).over(w), F.lit(0)) % 2 == 1)


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def running_cap(rows: DataFrame, by: str, order: str, size: str, most: int, total: int) -> DataFrame:
    """The first rows of each key, up to a number and a sum of sizes."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__s", F.sum(size).over(w)).filter((F.col("__n") <= most) & (F.col("__s") <= total)).drop("__n", "__s")
