"""What is sent or worked out doesn't grow with copies of rows."""

import numpy as np
import pytest

from epochlane.operators import models


@pytest.mark.parametrize("metric", sorted(models.METRICS))
def test_nearest_rows_over_tiles(monkeypatch, metric):
    """Tiles smaller than either side, copies of rows that tie, and rows kept apart."""
    monkeypatch.setattr(models, "TILE", (7, 11))
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(30, 6)), rng.normal(size=(50, 6))
    y[40:] = y[:10]
    fold = np.arange(30) % 3, np.arange(50) % 3
    row, other, dist = models._nearest(x, y, 4, metric, fold)
    for i in range(30):
        d = models.ROW_METRICS[metric](np.repeat(x[i : i + 1], 50, axis=0), y)
        want = [j for j in np.lexsort((np.arange(50), d)) if fold[1][j] != fold[0][i]][:4]
        assert other[row == i].tolist() == want and np.allclose(dist[row == i], d[want])


def test_blocks_of_neighbours_are_few():
    assert [models.n_blocks(n, 2000) for n in (0, 2000, 2001, 100_000, 600_000, 1_600_000)] == [1, 1, 2, 8, 8, 16]


def test_refits_count_events_of_the_same_values_once(spark):
    """Events alike are sent once and give the history of all of them, each removed on its own."""
    import inspect
    import random

    from epochlane.operators import refit

    assert "same" in inspect.signature(refit.refit).parameters
    random.seed(5)
    first = {w: [(c, random.gauss(c > 3, 0.3) + 4 * (w == 3)) for c in range(8)] for w in range(1, 8)}
    ids = [(w + 10 * i, w) for w in first for i in range(3 if w == 3 else 2)]
    make = lambda rows: spark.createDataFrame(rows, "grp string, window_id long, chunk_idx int, value double")
    every = make([("a", i, c, v) for i, w in ids for c, v in first[w]])
    once = make([("a", w, c, v) for w in first for c, v in first[w]])
    same = spark.createDataFrame(ids, "window_id long, first_id long")
    rows = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.orderBy("attempt").collect()]
    want = rows(refit.refit(every, ["grp"], 2, 8, 60, threshold=0.2))
    assert rows(refit.refit(once, ["grp"], 2, 8, 60, threshold=0.2, same=same)) == want and len(want) > 1


def test_most_series_take_few_lags(spark, monkeypatch):
    """The first pass takes a few lags, later ones more, and the result doesn't depend on how many."""
    import random

    from epochlane.operators import posterior

    random.seed(2)
    rows, x = [], 0.0
    for chain in range(2):
        for draw in range(120):
            x = 0.95 * x + random.gauss(0, 1)
            rows += [("slow", chain, draw, x), ("fast", chain, draw, random.gauss(0, 1))]
    draws = spark.createDataFrame(rows, "config_id string, chain int, draw int, value double")
    assert posterior.FIRST_LAGS < posterior.LAGS
    found = lambda: {r["config_id"]: (r["n"], round(r["ess_bulk"], 6), round(r["ess_tail"], 6)) for r in posterior.ess(draws).collect()}
    few = found()
    monkeypatch.setattr(posterior, "FIRST_LAGS", 32)
    assert few == found() and few["slow"][1] < few["fast"][1]


def test_models_meet_cells_of_replicated_values(spark, monkeypatch):
    """Ten times the windows make no more cells once each cell has a value."""
    import random

    from epochlane.operators import predictive

    random.seed(6)
    monkeypatch.setattr(predictive, "STEPS", 4)
    written, keep = [], predictive.materialise
    monkeypatch.setattr(predictive, "materialise", lambda df: written.append(keep(df)) or written[-1])
    sizes = []
    for windows in (150, 1500):
        written.clear()
        rows = [("a", w, c, y, (y + 1) / 2) for w in range(windows) for c in range(4) for y in [random.uniform(-0.9, 0.9)]]
        values = spark.createDataFrame(rows, "grp string, window_id long, chunk_idx int, y double, u double")
        got = predictive.replicates(values, ["grp"], ["normal", "beta", "interval_inflated_beta"], 2, 2, 3).collect()
        assert {r["n"] for r in got} == {4 * windows} and len(got) == 6
        sizes += [df.count() for df in written if "k" in df.columns]
    assert len(sizes) == 2 and sizes[1] <= 1.5 * sizes[0] < 4 * 150
