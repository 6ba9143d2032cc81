"""Raw signal files: 16-bit samples of interleaved channels, several files a subject-day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epochlane.operators.ranking import rank_column


def read_files(spark: SparkSession, root: str, subject: str = r"R\d+", stored: int = 8, kept: int = 4) -> DataFrame:
    """(subject_id, day, channel, sample_idx, sample) from {root}/{YYYY_MM_DD}/**/*.dat on any file system.

    The subject is what the pattern finds in the file's name; files without one are left out. Of
    `stored` interleaved channels the first `kept` are taken; a partial last frame is dropped. Files of
    one subject and day follow each other in name order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.dat").load(root)
    at = files.select("path", "content", F.regexp_extract("path", rf".*/[^/]*?({subject})[^/]*$", 1).alias("subject_id"), F.try_to_date(F.regexp_extract("path", r"/(\d{4}_\d\d_\d\d)/", 1), "yyyy_MM_dd").alias("day")).where("subject_id <> '' and day is not null")
    frames = F.floor(F.length("content") / (2 * stored))
    sizes = at.select("subject_id", "day", "path", frames.alias("frames"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("frames").over(Window.partitionBy("subject_id", "day").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("path", "start")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subject_id, day, content, start in zip(*(batch.column(c) for c in ("subject_id", "day", "content", "start")), strict=True):
                data = content.as_py()
                x = np.frombuffer(data[: len(data) // (2 * stored) * 2 * stored], "<i2").reshape(-1, stored)[:, :kept]
                n = len(x)
                for c in range(kept):
                    yield pa.RecordBatch.from_pydict({
                        "subject_id": pa.array([subject_id.as_py()] * n, pa.string()), "day": pa.array([day.as_py()] * n, pa.date32()), "channel": pa.array(np.full(n, c, np.int32)),
                        "sample_idx": pa.array(np.arange(n) + start.as_py()), "sample": pa.array(x[:, c].astype(float))})

    return at.join(starts, "path").select("subject_id", "day", "content", "start").mapInArrow(decode, "subject_id string, day date, channel int, sample_idx long, sample double")


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """(window_id, pos, value) from a headerless CSV matrix, one window a line; nan and empty are null.

    window_id: the line's number from 0, over files in name order; a file may be read in several blocks."""
    names = [f"c{i}" for i in range(columns)]
    raw = spark.read.csv(path, schema=", ".join(f"{c} string" for c in names)).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    raw = rank_column(raw, [F.col("_file"), F.col("_block"), F.col("_line")], "_n").withColumn("window_id", F.col("_n") - 1)
    value = lambda c: F.expr(f"try_cast({c} as double)")
    long = raw.select("window_id", F.posexplode(F.array(*[F.when(~F.isnan(value(c)), value(c)) for c in names])).alias("pos", "value"))
    return long
