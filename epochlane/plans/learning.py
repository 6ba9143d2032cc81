"""Splits, classifiers and metrics (section 2.12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlane.operators import agreement, export, folds, metrics, mixed_effects, models, ranking, stacked, windows

from epochlane.plans.profiling import _labelled, _V, causal_sql
from epochlane.plans.registry import query
from epochlane.session import materialise
from epochlane.sources.adapt import ctes, view
from epochlane.sources.tables import table

SC = ctes("scored")
MD5 = "md5('42:' || id)"


def _r(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def _scored(spark, d):
    return view(spark, d, "scored")


@query("folds", SC + f"SELECT id, ((row_number() OVER (ORDER BY {MD5}, id) - 1) % 5)::INT AS fold FROM scored")
def folds_k(spark, d):
    return folds.k_fold(_scored(spark, d), "id").select("id", "fold")


@query("folds_stratified", SC + f"SELECT id, ((row_number() OVER (PARTITION BY y ORDER BY {MD5}, id) - 1) % 5)::INT AS fold FROM scored")
def folds_stratified(spark, d):
    return folds.stratified(_scored(spark, d), "id", "y").select("id", "fold")


@query("folds_loo", SC + "SELECT id, row_number() OVER (ORDER BY id) - 1 AS fold FROM scored")
def folds_loo(spark, d):
    return folds.leave_one_out(_scored(spark, d).select("id"), "id")


@query("folds_lpo", SC + "SELECT a.grp AS a, b.grp AS b FROM (SELECT DISTINCT grp FROM scored) a JOIN (SELECT DISTINCT grp FROM scored) b ON a.grp < b.grp")
def folds_lpo(spark, d):
    return folds.leave_two_groups_out(_scored(spark, d), "grp")


@query("folds_shuffle", SC + "SELECT id, split, ('0x' || substr(md5('42:' || split || ':' || id), 1, 8))::BIGINT < (0.2 * 4294967296)::BIGINT AS test FROM scored, (SELECT unnest(range(3))::INT AS split)")
def folds_shuffle(spark, d):
    return folds.shuffle_split(_scored(spark, d).select("id"), "id", 3, 0.2)


@query("folds_stratified_shuffle", SC + """, s AS (SELECT id, y, split, row_number() OVER (PARTITION BY split, y ORDER BY md5('42:' || split || ':' || id), id) AS k, count(*) OVER (PARTITION BY split, y) AS n FROM scored, (SELECT unnest(range(3))::INT AS split))
    SELECT id, split, k <= floor(n * 0.2) AS test FROM s""")
def folds_stratified_shuffle(spark, d):
    return folds.stratified_shuffle_split(_scored(spark, d).select("id", "y"), "id", "y", 3, 0.2).select("id", "split", "test")


@query("folds_time", ctes("trigger") + """, r AS (SELECT trigger_id, row_number() OVER (ORDER BY event_date, trigger_id) AS r, count(*) OVER () AS n FROM trigger)
    SELECT trigger_id, split, CASE WHEN r <= n - (5 - split) * (n // 6) THEN 'train' ELSE 'test' END AS role FROM r, (SELECT unnest(range(5))::INT AS split) WHERE r <= n - (4 - split) * (n // 6)""")
def folds_time(spark, d):
    return folds.time_series(view(spark, d, "trigger").select("event_date", "trigger_id"), ["event_date", "trigger_id"]).select("trigger_id", "split", "role")


@query("folds_group", ctes("hypno") + "SELECT DISTINCT subject_id, day, ((dense_rank() OVER (ORDER BY subject_id) - 1) % 3)::INT AS fold FROM hypno")
def folds_group(spark, d):
    return folds.grouped(view(spark, d, "hypno").select("subject_id", "day").distinct(), "subject_id", 3)


@query("temporal_split", ctes("trigger") + "SELECT trigger_id, CASE WHEN dense_rank() OVER (ORDER BY event_date) <= greatest(1, floor(0.8 * (SELECT count(DISTINCT event_date) FROM trigger))) THEN 'train' ELSE 'test' END AS role FROM trigger")
def temporal_split(spark, d):
    return folds.temporal(view(spark, d, "trigger"), "event_date").select("trigger_id", "role")


@query("design_matrix", causal_sql(x="SELECT subject_id, day, mean, range, mean - lag(mean) OVER (PARTITION BY subject_id ORDER BY day) AS delta FROM dv",
    m="SELECT quantile_cont(mean, 0.5) AS m1, quantile_cont(range, 0.5) AS m2, quantile_cont(delta, 0.5) AS m3 FROM x WHERE day < DATE '2024-01-21'", f="SELECT subject_id, day, coalesce(mean, m1) AS mean, coalesce(range, m2) AS range, coalesce(delta, m3) AS delta FROM x, m",
    s="SELECT avg(mean) a1, stddev_samp(mean) s1, avg(range) a2, stddev_samp(range) s2, avg(delta) a3, stddev_samp(delta) s3 FROM f WHERE day < DATE '2024-01-21'") +
    "SELECT subject_id, day, round((mean - a1) / s1, 5) AS mean, round((range - a2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END, 5) AS range, round((delta - a3) / s3, 5) AS delta FROM f, s")
def design_matrix(spark, d):
    from epochlane.operators.causal import delta1
    from epochlane.plans.profiling import _values

    x = delta1(_values(spark, d), ["subject_id"], "day").select("subject_id", "day", "mean", "range", F.col("delta_mean").alias("delta"))
    return _r(folds.design(x, ["mean", "range", "delta"], F.col("day") < F.lit("2024-01-21").cast("date")), "mean", "range", "delta", n=5)


@query("roc_auc", SC + ", r AS (SELECT y, (rank() OVER (ORDER BY p) + count(*) OVER (ORDER BY p)) / 2.0 AS r FROM scored) SELECT round((sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)), 6) AS roc_auc FROM r")
def roc_auc(spark, d):
    return _r(metrics.roc_auc(_scored(spark, d)), "roc_auc")


@query("pr_auc", SC + ", g AS (SELECT p, sum(y) AS k, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT k, sum(k) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY p DESC)), q AS (SELECT k, tp / n AS b, coalesce((tp - k) / nullif(lag(n) OVER (ORDER BY n), 0), 1) AS a FROM c) SELECT round(sum(k * (a + b) / 2) / sum(k), 6) AS pr_auc FROM q")
def pr_auc(spark, d):
    return _r(metrics.pr_auc(_scored(spark, d)), "pr_auc")


@query("brier_log", SC + ", c AS (SELECT y, p, greatest(least(p, 1 - 1e-15), 1e-15) AS q FROM scored) SELECT round(avg((p - y) ** 2), 6) AS brier, round(avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_score FROM c")
def brier_log(spark, d):
    return _r(metrics.brier_log(_scored(spark, d)), "brier", "log_score")


@query("ece", SC + ", b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(y) AS a FROM scored GROUP BY 1) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return _r(metrics.ece(_scored(spark, d)), "ece")


@query("accuracy", SC + "SELECT grp, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM scored GROUP BY 1")
def accuracy(spark, d):
    return _scored(spark, d).groupBy("grp").agg(F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")), 6).alias("accuracy"))


@query("fold_metrics", SC + """, f AS (SELECT y, (p >= 0.5)::INT AS q, ((row_number() OVER (ORDER BY md5('42:' || id), id) - 1) % 5)::INT AS fold FROM scored),
    c AS (SELECT fold, avg((y = q)::INT) AS accuracy, coalesce(count(*) FILTER (WHERE y = 1 AND q = 1) / nullif(count(*) FILTER (WHERE q = 1), 0), 0) AS p1, coalesce(count(*) FILTER (WHERE y = 0 AND q = 0) / nullif(count(*) FILTER (WHERE q = 0), 0), 0) AS p0,
    coalesce(count(*) FILTER (WHERE y = 1 AND q = 1) / nullif(count(*) FILTER (WHERE y = 1), 0), 0) AS r1, coalesce(count(*) FILTER (WHERE y = 0 AND q = 0) / nullif(count(*) FILTER (WHERE y = 0), 0), 0) AS r0 FROM f GROUP BY 1)
    SELECT fold, round(accuracy, 6) AS accuracy, round(p1, 6) AS precision_1, round(p0, 6) AS precision_0, round((r0 + r1) / 2, 6) AS macro_recall FROM c""")
def fold_metrics(spark, d):
    pred = folds.k_fold(_scored(spark, d), "id").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    return _r(metrics.fold_metrics(pred, ["fold"]), "accuracy", "precision_1", "precision_0", "macro_recall")


@query("regression_metrics", """SELECT l_returnflag, round(100 * sum(l_tax * abs(p - y) / nullif(abs(y), 0)) / sum(l_tax), 4) AS mape, round(sum(l_tax * (p - y)) / sum(l_tax), 4) AS bias, round(sum(l_tax * (p - y) ** 2) / sum(l_tax), 4) AS mse, round(sum(l_tax * abs(p - y)) / sum(l_tax), 4) AS mae,
    round(1 - (sum(l_tax * (p - y) ** 2) / sum(l_tax)) / (sum(l_tax * y * y) / sum(l_tax) - (sum(l_tax * y) / sum(l_tax)) ** 2), 5) AS r2 FROM (SELECT l_returnflag, l_tax, l_extendedprice / 1000 AS y, l_quantity * 1.5 AS p FROM lineitem) x GROUP BY 1""")
def regression_metrics(spark, d):
    out = metrics.regression(table(spark, d, "lineitem"), F.col("l_extendedprice") / 1000, F.col("l_quantity") * 1.5, F.col("l_tax"), ["l_returnflag"])
    return _r(_r(out, "mape", "bias", "mse", "mae", n=4), "r2", n=5)


NEXT_SQL = "SELECT subject_id, coalesce(lead(subject_id) OVER (ORDER BY subject_id), min(subject_id) OVER ()) AS other FROM (SELECT DISTINCT subject_id FROM hypno)"
PAIR_SQL = f"SELECT a.subject_id || '-' || n.other AS pair, a.day, a.epoch_idx, a.stage AS t, b.stage AS p FROM hypno a JOIN ({NEXT_SQL}) n ON a.subject_id = n.subject_id JOIN hypno b ON b.subject_id = n.other AND a.day = b.day AND a.epoch_idx = b.epoch_idx"


def _pairs(spark, d):
    """Every subject's epochs beside the next one's of the same day."""
    return agreement.with_next(view(spark, d, "hypno"), 0, 0)


@query("confusion", ctes("hypno", x=PAIR_SQL) + "SELECT pair, day, t AS y_true, p AS y_pred, count(*) AS n FROM x GROUP BY 1, 2, 3, 4")
def confusion(spark, d):
    return agreement.confusion(_pairs(spark, d), ["pair", "day"])


@query("kappa", ctes("hypno", x=PAIR_SQL) + """, m AS (SELECT a.t, b.p, a.n * b.m / (SELECT count(*) FROM x) AS e FROM (SELECT t, count(*) AS n FROM x GROUP BY 1) a, (SELECT p, count(*) AS m FROM x GROUP BY 1) b)
    SELECT round(avg((t = p)::INT), 6) AS accuracy, round((avg((t = p)::INT) - (SELECT sum(e) FILTER (WHERE t = p) FROM m) / count(*)) / (1 - (SELECT sum(e) FILTER (WHERE t = p) FROM m) / count(*)), 6) AS kappa,
    round(1 - sum((t - p) ** 2) / (SELECT sum(e * (t - p) ** 2) FROM m), 6) AS kappa_quadratic FROM x""")
def kappa(spark, d):
    return _r(agreement.kappa(agreement.confusion(_pairs(spark, d))), "accuracy", "kappa", "kappa_quadratic")


@query("stage_agreement", ctes("hypno", x=PAIR_SQL) + """, c AS (SELECT t AS stage, count(*) AS support, count(*) FILTER (WHERE t = p) / count(*) AS recall, count(*) FILTER (WHERE t = p) / (SELECT count(*) FROM x y WHERE y.p = x.t) AS precision FROM x GROUP BY t)
    SELECT stage, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, support FROM c""")
def stage_agreement(spark, d):
    return _r(agreement.per_class(agreement.confusion(_pairs(spark, d))), "precision", "recall", "f1")


@query("error_matrix", ctes("hypno", x=PAIR_SQL) + "SELECT t AS y_true, count(*) FILTER (WHERE p = 0) AS n0, count(*) FILTER (WHERE p = 1) AS n1, count(*) FILTER (WHERE p = 2) AS n2, round(avg((t = p)::INT), 6) AS right FROM x GROUP BY 1".replace(" AS right", ' AS "right"'))
def error_matrix(spark, d):
    return _r(export.error_matrix(_pairs(spark, d)), "right")


@query("score_by_position", ctes("trigger", "hypno", w="SELECT trigger_id, position, subject_id, CAST(event_date + CAST(-position - 2 + i AS INT) AS DATE) AS day FROM trigger, (SELECT unnest(range(3))::INT AS i), (SELECT unnest(range(-4, 5))::INT AS position)",
    r="SELECT subject_id, day, count(*) FILTER (WHERE stage = 2) / count(*) AS share FROM hypno GROUP BY 1, 2") + "SELECT position, count(*) AS n, round(avg(share), 6) AS mean_share FROM w JOIN r ON w.subject_id = r.subject_id AND w.day = r.day GROUP BY 1")
def score_by_position(spark, d):
    share = view(spark, d, "hypno").groupBy("subject_id", "day").agg(F.avg((F.col("stage") == 2).cast("double")).alias("share"))
    w = windows.sweep(view(spark, d, "trigger"), 3, range(4, -5, -1))
    return w.join(share, ["subject_id", "day"]).groupBy("position").agg(F.count("*").alias("n"), F.round(F.avg("share"), 6).alias("mean_share"))


#: Parameters of the result table.
SLICED = ["family", "feature_kind", "n_points", "overlap"]


def slices_sql() -> str:
    """Every pair of parameters with the others at the best row's values."""
    from itertools import combinations

    parts = []
    for a, b in combinations(SLICED, 2):
        rest = " AND ".join(f"s.{c} IS NOT DISTINCT FROM b.{c}" for c in SLICED if c not in (a, b))
        parts.append(f"SELECT '{a}' AS param_1, '{b}' AS param_2, s.{a}::VARCHAR AS value_1, s.{b}::VARCHAR AS value_2, s.score, s.score = b.score AS best, s.n FROM s, b WHERE {rest}")
    by = ", ".join(SLICED)
    return ctes("search_result") + f""", s AS (SELECT {by}, max(elpd_loo) AS score, count(*) AS n FROM search_result WHERE elpd_loo IS NOT NULL GROUP BY {by}),
        b AS (SELECT * FROM s ORDER BY score DESC, {by} LIMIT 1) """ + " UNION ALL ".join(parts)


@query("param_slices", slices_sql())
def param_slices(spark, d):
    """Scores over every pair of parameters with all others at the best row's values."""
    at = view(spark, d, "search_result").where("elpd_loo is not null")
    return ranking.slices(at, ranking.varying(at, SLICED), "elpd_loo")


def _vecs(spark, d):
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("target", (F.col("label") == 0).cast("int"))
    return folds.k_fold(e, "vec_id", 5)


@query("knn", """WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 0)::INT AS y, (row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1) % 5 AS fold FROM embeddings),
    n AS (SELECT a.vec_id, a.fold, b.y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS k FROM f a JOIN f b ON a.fold <> b.fold)
    SELECT vec_id AS id, fold::INT AS fold, (2 * sum(y) > 5)::INT AS pred FROM n WHERE k <= 5 GROUP BY 1, 2""")
def knn(spark, d):
    """Each row's label by its five nearest rows of the other folds."""
    f = _vecs(spark, d).select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), F.col("target").alias("label"), F.col("fold").cast("int").alias("fold"))
    f = materialise(f)
    return models.knn(f, f, 5, apart="fold").join(f.select("id", "fold"), "id").select("id", "fold", "pred")


def _ml(spark, d):
    return models.vectors(_vecs(spark, d), "embedding", "target").select("vec_id", "features", "y", "fold")


@query("logreg")
def logreg(spark, d):
    return models.cv_scores(_ml(spark, d), models.logistic, 5)


@query("linear_svc")
def linear_svc(spark, d):
    return models.cv_scores(_ml(spark, d), models.linear_svc, 5)


@query("tree")
def tree(spark, d):
    return models.cv_scores(_ml(spark, d), models.tree, 5)


@query("cv_scores")
def cv_scores(spark, d):
    return models.cv_scores(_ml(spark, d), lambda: models.logistic(0.1, 0.5), 5)


@query("cv_predict")
def cv_predict(spark, d):
    return models.out_of_fold(_ml(spark, d), models.logistic, 5).select("vec_id", "fold", "y", "pred")


def _stack(spark, d, k=3):
    """Vectors with a target of two classes, in an order by hash and dealt into k folds."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    e = e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("label") == 0).cast("int").alias("y"))
    return materialise(stacked.ranked_folds(e, "vec_id", k))


def _options(regs, l1s):
    return [stacked.Model(f"reg={r},l1={a}", r, a) for r in regs for a in l1s]


@query("learning_curve")
def learning_curve(spark, d):
    """Growing shares of every fold's training rows, each the beginning of the next, with training and test scores."""
    return stacked.curve(_stack(spark, d), stacked.Model("reg=0.01,l1=0.0"), [0.1, 0.325, 0.55, 0.775, 1.0], 3)


@query("validation_curve")
def validation_curve(spark, d):
    """Training and test scores of every fold over a range of one parameter."""
    return stacked.validated(_stack(spark, d), _options((0.0001, 0.001, 0.01, 0.1, 1.0), (0.0,)), 3)[0].drop("n_train", "n_test")


@query("cv_validate")
def cv_validate(spark, d):
    """Every fold's training and test scores of one model; the folds are fitted together, in so many passes and seconds."""
    found, fitted = stacked.validated(_stack(spark, d, 5), [stacked.Model("reg=0.01,l1=0.0")], 5)
    return found.withColumns({"passes": F.lit(fitted.passes), "fit_seconds": F.lit(round(fitted.seconds, 3))})


@query("grid_search")
def grid_search(spark, d):
    """All options of a grid on the same folds, fitted together: means and deviations of five metrics, and training scores."""
    return stacked.search(_stack(spark, d), _options((0.001, 0.01, 0.1), (0.0, 0.5, 1.0)), 3)


@query("random_search")
def random_search(spark, d):
    """The same for options drawn by a hash from a finer grid."""
    return stacked.search(_stack(spark, d), stacked.sampled(_options([round(10 ** (-k / 4), 6) for k in range(13)], (0.0, 0.25, 0.5, 0.75, 1.0)), 8, 42), 3)


@query("pca")
def pca(spark, d):
    out, _ = models.principal_components(models.vectors(table(spark, d, "embeddings").where("embedding is not null"), "embedding", "label"), 3)
    return out.select("vec_id", F.posexplode("components").alias("component", "value")).withColumn("value", F.round("value", 6))


@query("pca_share")
def pca_share(spark, d):
    """As many components as hold 30 % of the variance, of at most 32."""
    at = materialise(models.vectors(table(spark, d, "embeddings").where("embedding is not null"), "embedding", "label"))
    out, _ = models.principal_components_for(at, 0.3, 32)
    return out.select("vec_id", F.posexplode("components").alias("component", "value")).withColumn("value", F.round("value", 6))


@query("quality_model")
def quality_model(spark, d):
    """Channel quality from statistics of each channel-day, by a small perceptron that has not seen the day."""
    stats = view(spark, d, "signal_raw").groupBy("subject_id", "day", "channel").agg(F.avg("sample").alias("m"), F.stddev_pop("sample").alias("s"), F.max("sample").alias("x"))
    at = stats.join(view(spark, d, "channel_quality"), ["subject_id", "day", "channel"]).withColumn("f", F.array(F.col("m") / 50, F.col("s") / 50, F.col("x") / 300)).withColumn("good", (F.col("predicted_class") < 2).cast("int"))
    at = at.withColumn("fold", F.pmod(F.crc32(F.concat_ws(":", "subject_id", F.col("day").cast("string"))), F.lit(3)).cast("int"))
    v = materialise(models.vectors(at, "f", "good"))
    return models.out_of_fold(v, lambda: models.perceptron([3, 4, 2]), 3).select("subject_id", "day", "channel", "fold", F.col("y").cast("int").alias("y"), F.col("pred").cast("int").alias("predicted_class"))


#: The risk model's variants: the features that each has, and whether subjects and months have effects.
VARIANTS = {"null": ([], False), "calendar": ([], True), "full": (_V, True), "no_shape": (["mean", "std"], True)}


@query("risk_model")
def risk_model(spark, d):
    """Next-day risk by logistic regression with effects of subjects and months, scored on the last fifth of dates."""
    rows, _ = _labelled(spark, d)
    rows = folds.design(folds.temporal(rows, "day"), _V, F.col("role") == "train")
    rows = materialise(rows.select("role", "subject_id", F.month("day").alias("month"), F.array(*[F.col(c).cast("double") for c in _V]).alias("x"), "label"))
    fixed, own = mixed_effects.fit(rows.where("role = 'train'"), [[c in cols for c in _V] for cols, _ in VARIANTS.values()], [cal for _, cal in VARIANTS.values()])
    scored = materialise(mixed_effects.predict(rows.where("role = 'test'"), fixed, own, list(VARIANTS)))
    parts = []
    for name in VARIANTS:  # four at most
        p = scored.where(F.col("variant") == name)
        one = [metrics.brier_log(p), metrics.roc_auc(p), metrics.pr_auc(p), metrics.ece(p), p.agg(F.count("*").alias("n_test"))]
        parts.append(reduce(lambda a, b: a.crossJoin(b), one).withColumn("variant", F.lit(name)))  # of one row each
    return reduce(DataFrame.unionByName, parts)


@query("stage_rem_error", ctes("hypno", x=PAIR_SQL) + "SELECT pair, day, count(*) FILTER (WHERE t = 2) * 5 / 60.0 AS rem_true, count(*) FILTER (WHERE p = 2) * 5 / 60.0 AS rem_pred FROM x GROUP BY 1, 2")
def stage_rem_error(spark, d):
    """Minutes of stage 2 in either coding, epochs of five seconds."""
    return _pairs(spark, d).groupBy("pair", "day").agg((F.count_if(F.col("y_true") == 2) * 5 / 60.0).alias("rem_true"), (F.count_if(F.col("y_pred") == 2) * 5 / 60.0).alias("rem_pred"))
