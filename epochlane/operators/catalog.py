"""Which subject-days there are, are needed, and are missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = ["subject_id", "day"]


def first_available(sources: list[tuple[str, DataFrame]], keys: list[str] = DAY) -> DataFrame:
    """Rows of all sources; where several have a key, only those of the first that does."""
    tagged = [df.withColumns({"origin": F.lit(name), "_rank": F.lit(i)}) for i, (name, df) in enumerate(sources)]
    all_ = reduce(DataFrame.unionByName, tagged)
    return all_.withColumn("_best", F.min("_rank").over(Window.partitionBy(*keys))).where("_rank = _best").drop("_rank", "_best")


def days(epochs: DataFrame) -> DataFrame:
    return epochs.select(*DAY).distinct()


def required(window_days: DataFrame) -> DataFrame:
    return window_days.select(*DAY).distinct()


def availability(needed: DataFrame, catalog: DataFrame) -> DataFrame:
    """needed with `available`; the missing ones are those without."""
    return needed.join(catalog.select(*DAY).distinct().withColumn("_has", F.lit(True)), DAY, "left").withColumn("available", F.coalesce("_has", F.lit(False))).drop("_has")


def require(needed: DataFrame, catalog: DataFrame, show: int = 5) -> DataFrame:
    """needed as it is; a ValueError that names some of the missing days if any is (strict mode)."""
    gone = availability(required(needed), catalog).where("not available")
    n = gone.count()
    if n:
        first = ", ".join(f"{r['subject_id']} {r['day']}" for r in gone.orderBy(*DAY).limit(show).collect())
        raise ValueError(f"{n} days are missing: {first}")
    return needed


def complete_windows(window_days: DataFrame, catalog: DataFrame) -> DataFrame:
    """The window days of windows that lack no day."""
    bad = window_days.join(catalog.select(*DAY).distinct(), DAY, "left_anti").select("window_id").distinct()
    return window_days.join(bad, "window_id", "left_anti")


def resume(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is left to do: the wanted rows whose key is not among those done."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")
