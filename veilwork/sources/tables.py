"""Tables in plain texts: Markdown status tables, manifests, folders of files; audit sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a status may be.
STATUSES = ("partial", "planned", "verified")
ROW = r"^\| ([^|]+) \| ([^|]+) \| ([^|]+) \|$"


def read_status_table(lines: DataFrame) -> DataFrame:
    """requirement, status, evidence of lines (value); headings and rules between them are no rows."""
    parts = [F.trim(F.regexp_extract("value", ROW, i)).alias(n) for i, n in enumerate(("requirement", "status", "evidence"), 1)]
    rows = lines.where(F.col("value").rlike(ROW)).select(*parts)
    return rows.where(~F.lower("status").isin("status") & ~F.col("status").rlike("^[-: ]+$"))


def read_manifest(lines: DataFrame) -> DataFrame:
    """name, revision, digest of lines with three fields; comments and blank lines are none."""
    fields = F.split(F.trim("value"), r"\s+")
    rows = lines.where((F.size(fields) == 3) & ~F.trim("value").startswith("#")).withColumn("f", fields)
    return rows.select(F.col("f")[0].alias("name"), F.col("f")[1].alias("revision"), F.col("f")[2].alias("digest"))


def tree_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of a folder: over relative paths and file digests, sorted by path. Of no files, that of nothing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
    each = files.select(relative.alias("path"), F.sha2("content", 256).alias("digest"))
    entries = F.array_sort(F.collect_list(F.struct("path", "digest")))
    text = F.array_join(F.transform(entries, lambda e: F.concat(e["path"], F.lit("\0"), e["digest"], F.lit("\n"))), "")
    return each.agg(F.count("*").alias("n_files"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))


def write_audit(events: DataFrame, path: str) -> None:
    """Audit events as JSON lines, in a folder for each day."""
    dated = events.withColumn("day", F.coalesce(F.to_date(F.try_to_timestamp(F.col("ts"))).cast("string"), F.lit("unknown")))
    dated.write.mode("append").partitionBy("day").json(path)
