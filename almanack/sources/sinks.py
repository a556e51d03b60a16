"""Where feeds go: tables, JSON lines, calendars, Markdown reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, *paths: str, least: int = 1) -> None:
    """Publish a feed to each path, unless it has under ``least`` rows: an empty run never replaces a feed.

    A version is written beside the others and named by a marker last, so readers see the old one or the new one
    whole; a part may be published before a slow source, and all of it later.
    """
    if df.limit(least).count() < least:
        raise ValueError("too few rows to publish")
    spark = df.sparkSession
    for path in paths:
        version = f"{path}/v-{uuid.uuid4().hex}"
        df.write.parquet(version)
        at = len(_versions(spark, path))
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.text(f"{path}/current-{at:08d}")


def _versions(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/current-*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def published(spark: SparkSession, path: str) -> DataFrame:
    """The last published version."""
    return spark.read.parquet(spark.read.text(_versions(spark, path)[-1]).first()[0])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _escape(c: Column) -> Column:
    """Backslash, semicolon, comma and line end as calendar files write them."""
    for a, b in (("\\", "\\\\"), (";", "\\;"), (",", "\\,"), ("\n", "\\n")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def calendar_entry(uid: Column, title: Column, day: Column, start: Column, venue: Column, url: Column, minutes: int = 120) -> Column:
    """A VEVENT block; without a start it is a whole day."""
    at = F.to_timestamp(F.concat_ws(" ", day.cast("string"), start), "yyyy-MM-dd HH:mm")
    stamp = lambda t: F.date_format(t, "yyyyMMdd'T'HHmmss")
    timed = F.concat(F.lit("DTSTART:"), stamp(at), F.lit("\r\nDTEND:"), stamp(at + F.make_dt_interval(mins=F.lit(minutes))))
    whole = F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(day, "yyyyMMdd"))
    line = lambda name, c: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(name + ":"), _escape(c)))
    return F.concat_ws("\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:"), uid), F.when(start.isNotNull(), timed).otherwise(whole), line("SUMMARY", title), line("LOCATION", venue), line("URL", url), F.lit("END:VEVENT"))


def calendar_bundle(entries: DataFrame, entry: str, order: list, by: list[str]) -> DataFrame:
    """One calendar for each group of entries."""
    listed = F.sort_array(F.collect_list(F.struct(*order, F.col(entry).alias("__e"))))
    return entries.groupBy(*by).agg(F.concat_ws("\r\n", F.lit("BEGIN:VCALENDAR\r\nVERSION:2.0"), F.array_join(F.transform(listed, lambda x: x["__e"]), "\r\n"), F.lit("END:VCALENDAR")).alias("calendar"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """The lines of a Markdown table, in the frame's order: line_no, line."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    body = df.select((F.monotonically_increasing_id() + 2).alias("line_no"), cells.alias("line"))
    head = df.sparkSession.createDataFrame([(0, f"| {' | '.join(df.columns)} |"), (1, "|" + "---|" * len(df.columns))], "line_no long, line string")
    return head.unionByName(body)
