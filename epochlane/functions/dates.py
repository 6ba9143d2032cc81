"""Dates in text, channels by date and quality, and the encoding of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """A date from 2022_11_07, 2022-11-07 or 20221107; null for anything else."""
    return F.coalesce(*[F.when(text.rlike(rf"^{p}$"), F.try_to_date(text, f)) for p, f in ((r"\d{4}_\d\d_\d\d", "yyyy_MM_dd"), (r"\d{4}-\d\d-\d\d", "yyyy-MM-dd"), (r"\d{8}", "yyyyMMdd"))])


def event_key(text: Column) -> Column:
    """Trimmed, _ as -, the first ten characters."""
    return F.substring(F.translate(F.trim(text), "_", "-"), 1, 10)


def channels_in_use(cutoff: str, after: int = 2, before: int = 4) -> Column:
    """Whether `channel` is used on `day`: the first `after` from the cutoff on, the first `before` earlier."""
    return F.col("channel") < F.when(F.col("day") >= F.lit(cutoff).cast("date"), after).otherwise(before)


def channel_decision(channels: DataFrame, quality: DataFrame, good: Sequence[int], least: float) -> DataFrame:
    """(subject_id, day, channel, good, reason): a channel without a quality row is accepted."""
    at = channels.join(quality, ["subject_id", "day", "channel"], "left")
    bad_class = ~F.coalesce(F.col("predicted_class").isin(list(good)), F.lit(True))
    unsure = F.coalesce("probability_good", F.lit(1.0)) < least
    return at.select("subject_id", "day", "channel", (~bad_class & ~unsure).alias("good"), F.when(bad_class, "class").when(unsure, "probability").otherwise("accepted").alias("reason"))


def encode_event(events: DataFrame) -> DataFrame:
    """The date as YYYYMMDD and the number in the subject's name, 0 where it has none."""
    n = F.regexp_extract("subject_id", r"(\d+)", 1)
    return events.select("trigger_id", F.date_format("event_date", "yyyyMMdd").cast("int").alias("day_number"), F.when(n != "", n.cast("int")).otherwise(0).alias("subject_number"))


def hours_to_points(width: Column, step: Column) -> tuple[Column, Column]:
    """Points a day and overlap that stand for windows of `width` hours every `step`."""
    return F.floor(24 / step).cast("int"), F.least(F.lit(0.99), F.greatest(F.lit(0.0), 1 - step / width))
