"""Graph statements from streams of N-Triples lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quadloom.sources.ntriples import parse_lines


def stream_lines(spark: SparkSession, folder: str, quads: bool = False, files_per_batch: int = 8) -> DataFrame:
    """A streaming table (g, s, p, o, fault, line) of the line files that arrive in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return parse_lines(lines, "value", quads)


def statements(stream: DataFrame) -> DataFrame:
    return stream.where("fault is null").select("g", "s", "p", "o")


def rejects(stream: DataFrame) -> DataFrame:
    return stream.where("fault is not null").select("line", F.col("fault").alias("reason"))


def match_stream(stream: DataFrame, static: DataFrame, on: str = "o") -> DataFrame:
    """Stream statements joined with the statements of a static graph about their object (or subject): one triple pattern on each side."""
    about = static.select(F.col("s").alias("node"), F.col("p").alias("p2"), F.col("o").alias("o2"))
    return statements(stream).join(about, F.col(on) == F.col("node")).select("s", "p", "o", "p2", "o2")


def windowed_counts(events: DataFrame, time: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window, key, n): counts per tumbling or sliding window with a watermark for late rows."""
    w = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return events.withWatermark(time, late).groupBy(w.alias("window"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def session_counts(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(window, key, n): counts per session of a key, which ends after a gap without rows."""
    return events.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("window"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
