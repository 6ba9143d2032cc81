import pytest

from epochlane.operators import selection


def test_either_order_and_doubles():
    assert selection.parse(["mean even", "Even Mean", "odd shape_shift", "single range"]) == [("even", "mean"), ("odd", "shape_shift"), ("all", "range")]
    assert selection.parse({"concat": ["mean", "range"], "single": "std"}) == [("concat", "mean"), ("concat", "range"), ("all", "std")]


@pytest.mark.parametrize("bad", [["mean"], ["mean even odd"], ["mean range"], ["even odd"], ["mean noon"], {"noon": "mean"}, {"even": ["depth"]}])
def test_unknown_words(bad):
    with pytest.raises(ValueError):
        selection.parse(bad)


def test_presets(spark):
    assert selection.preset("twenty_even_only") == (20, [("even", "mean"), ("even", "range")])
    with pytest.raises(ValueError):
        selection.preset("none")
    assert selection.as_rows(spark, {"A": ["even mean"], "B": {"odd": ["mean", "std"]}}).count() == 3
