"""Tables for files: matrices, metadata, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix(rows: DataFrame, length: int, fill: float | None = None) -> DataFrame:
    """(window_id, p0, p1, ...): one row a window from (window_id, pos, value); fill stands for missing values."""
    cols = [F.max(F.when(F.col("pos") == i, F.col("value"))) for i in range(length)]
    cols = cols if fill is None else [F.coalesce(c, F.lit(fill)) for c in cols]
    return rows.groupBy("window_id").agg(*[c.alias(f"p{i}") for i, c in enumerate(cols)])


def pad(rows: DataFrame, length: int, fill: float | None) -> DataFrame:
    """(window_id, pos, value) for pos 0 to length-1 of every window; longer ones are cut, missing values filled."""
    spots = rows.select("window_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    return spots.join(rows, ["window_id", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(fill).cast("double")))


def metadata(window_days: DataFrame, epochs: DataFrame) -> DataFrame:
    """Per window: days, missing days (count and text in window order), whether it is exported, its epochs."""
    n = epochs.groupBy("subject_id", "day").agg(F.count("*").alias("n"))
    at = window_days.join(n, ["subject_id", "day"], "left")
    gone = F.sort_array(F.collect_list(F.when(F.col("n").isNull(), F.struct("day_idx", F.col("day").cast("string").alias("d")))))
    return at.groupBy("window_id").agg(
        F.count("*").alias("n_days"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.array_join(F.transform(gone, lambda x: x["d"]), ";").alias("missing_days"),
        (F.count_if(F.col("n").isNull()) == 0).alias("exported"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_epochs"))


def summary(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("n_windows"), F.count_if("exported").alias("n_exported"), F.sum("n_missing").alias("n_missing_days"), F.max("n_missing").alias("most_missing"))


def write_step(df: DataFrame, path: str, number: int, name: str) -> str:
    """A pipeline step's rows as Parquet at {path}/{number}-{name}, which is returned."""
    to = f"{path.rstrip('/')}/{number:02d}-{name}"
    df.write.mode("overwrite").parquet(to)
    return to


def legend(df: DataFrame, meanings: dict[str, str]) -> DataFrame:
    """(column, type, meaning) of df's columns in their order; a column without a meaning has an empty one."""
    rows = [(i, c, kind, meanings.get(c, "")) for i, (c, kind) in enumerate(df.dtypes)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, meaning string")


def write_results(df: DataFrame, path: str, meanings: dict[str, str], score: str = "elpd_loo") -> DataFrame:
    """Results as CSV with a header, their legend and a summary as JSON, under path; the summary is returned.

    summary: rows, ok rows, and the best, mean and worst score of the ok ones."""
    to = path.rstrip("/")
    df.write.mode("overwrite").option("header", "true").csv(f"{to}/results")
    legend(df, meanings).coalesce(1).write.mode("overwrite").json(f"{to}/legend")
    ok = F.when(F.col("status") == "ok", F.col(score))
    out = df.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), F.max(ok).alias("best"), F.avg(ok).alias("mean"), F.min(ok).alias("worst"))
    out.write.mode("overwrite").json(f"{to}/summary")
    return out


def error_matrix(pairs: DataFrame, classes: int = 3) -> DataFrame:
    """One row a true class, a column n0, n1, ... a predicted one, and the class's share of right ones."""
    cols = [F.count_if(F.col("y_pred") == c).alias(f"n{c}") for c in range(classes)]
    return pairs.groupBy("y_true").agg(*cols, F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("right"))


def sample_head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order: a report's look at a table."""
    return df.orderBy(*order).limit(n)


def exported_rows(meta: DataFrame, samples: DataFrame, order: str = "window_id") -> DataFrame:
    """meta's exported rows with row_index, their place in an exported matrix.

    samples: the matrix; its number of rows must be that of the exported ones, else it's an error that names both."""
    from epochlane.operators.ranking import rank_column

    out = rank_column(meta.where("exported"), [F.asc(order)], "_r").withColumn("row_index", F.col("_r") - 1).drop("_r")
    n, m = out.count(), samples.count()
    if n != m:
        raise ValueError(f"{n} rows of the metadata are exported, but the matrix has {m}")
    return out


def read_metadata(spark, path: str, samples: DataFrame) -> DataFrame:
    """The exported rows of a metadata file (CSV with a header, columns exported and row_index), checked against the matrix."""
    meta = spark.read.option("header", "true").option("inferSchema", "true").csv(path)
    if "exported" not in meta.columns:
        raise ValueError(f"{path} has no column exported")
    out = meta.where(F.lower(F.col("exported").cast("string")).isin("true", "1"))
    n, m = out.count(), samples.count()
    if n != m:
        raise ValueError(f"{n} rows of the metadata are exported, but the matrix has {m}")
    return out
