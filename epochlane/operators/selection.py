"""Which features a configuration asks for: selections in words, as rows, and named presets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

#: The words that selections are made of.
METRIC_WORDS = frozenset(["range", "mean", "std", "skewness", "kurtosis", "shape_shift"])
GROUP_WORDS = frozenset(["all", "odd", "even", "concat", "daily", "day", "night"])
#: The groups that have a shape shift.
SHIFT_GROUPS = frozenset(["all", "odd", "even"])
#: Another word for a group.
SAME_GROUP = {"single": "all"}
#: Number of chunks and groups of the named presets, each with mean and range.
CHUNK_PRESETS = {"ten_unsplit": (10, ["all"]), "twenty_even_odd": (20, ["even", "odd"]), "twenty_even_only": (20, ["even"])}

Pair = tuple[str, str]


def _pairs(selection: Mapping[str, str | Iterable[str]] | Iterable[str]) -> Iterable[Pair]:
    if isinstance(selection, Mapping):
        for group, metrics in selection.items():
            for m in [metrics] if isinstance(metrics, str) else metrics:
                yield group, m
        return
    for text in selection:
        words = text.lower().replace("shape shift", "shape_shift").replace("-", " ").split()
        if len(words) == 1:  # group_metric in one word
            first, _, rest = words[0].partition("_")
            words = [first, rest]
        metrics = [w for w in words if w in METRIC_WORDS]
        if len(words) != 2 or len(metrics) != 1:
            raise ValueError(f"{text!r} doesn't name one group and one metric")
        yield next(w for w in words if w not in METRIC_WORDS), metrics[0]


def parse(selection: Mapping[str, str | Iterable[str]] | Iterable[str]) -> list[Pair]:
    """Distinct (group, metric) in the order given, from {group: metrics} or texts like "mean even"."""
    out: dict[Pair, None] = {}
    for group, metric in _pairs(selection):
        g, m = group.strip().lower(), metric.strip().lower()
        g = SAME_GROUP.get(g, g)
        if g not in GROUP_WORDS or m not in METRIC_WORDS:
            raise ValueError(f"unknown feature {group} {metric}")
        if m == "shape_shift" and g not in SHIFT_GROUPS:
            raise ValueError(f"{g} has no shape shift")
        out[g, m] = None
    return list(out)


def as_rows(spark: SparkSession, selections: Mapping[str, Mapping | Iterable[str]]) -> DataFrame:
    """(config_id, grp, metric) for named selections: the side that a feature store is joined to."""
    rows = [(name, *pair) for name, s in selections.items() for pair in parse(s)]
    return spark.createDataFrame(rows, "config_id string, grp string, metric string")


def preset(name: str) -> tuple[int, list[Pair]]:
    """Number of chunks and features of a named preset. Groups are 0-based: even means chunks 0, 2, 4, ..."""
    if name not in CHUNK_PRESETS:
        raise ValueError(f"unknown preset {name}")
    chunks, groups = CHUNK_PRESETS[name]
    return chunks, [(g, m) for g in groups for m in ("mean", "range")]
