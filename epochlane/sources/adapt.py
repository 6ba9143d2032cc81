"""Epoch tables derived from the given tables, by one SQL text for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from epochlane.sources.tables import table

#: name -> (tables and views it reads, SQL with their names in braces)
VIEWS: dict[str, tuple[list[str], str]] = {
    "hypno": (["events"], """
        SELECT concat('S', user_id % 4) AS subject_id, CAST(ts AS DATE) AS day,
            CAST(row_number() OVER (PARTITION BY user_id % 4, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS INT) AS epoch_idx,
            CAST(CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'error') THEN 1 ELSE 2 END AS INT) AS stage
        FROM {events}"""),
    "missing_day": (["hypno"], """
        SELECT DISTINCT subject_id, day FROM {hypno}
        WHERE (extract(day FROM day) + CAST(substr(subject_id, 2, 1) AS INT)) % 13 = 0"""),
    "artifact_day": (["hypno"], """
        SELECT DISTINCT subject_id, day FROM {hypno}
        WHERE (extract(day FROM day) * 3 + CAST(substr(subject_id, 2, 1) AS INT)) % 11 = 0"""),
    "hypno_local": (["hypno", "missing_day"], """
        SELECT h.subject_id, h.day, h.epoch_idx, h.stage FROM {hypno} h
        LEFT JOIN {missing_day} m ON h.subject_id = m.subject_id AND h.day = m.day WHERE m.day IS NULL"""),
    "trigger": (["events"], """
        SELECT event_id AS trigger_id, concat('S', user_id % 4) AS subject_id, CAST(ts AS DATE) AS event_date,
            CASE WHEN user_id % 8 < 4 THEN 'before' ELSE 'after_reversed' END AS direction
        FROM {events} WHERE event_type = 'purchase' AND value >= 120"""),
    "signal_raw": (["events"], """
        SELECT concat('S', user_id % 4) AS subject_id, CAST(ts AS DATE) AS day, CAST(event_id % 2 AS INT) AS channel,
            CAST(row_number() OVER (PARTITION BY user_id % 4, CAST(ts AS DATE), event_id % 2 ORDER BY ts, event_id) - 1 AS INT) AS sample_idx,
            value AS sample
        FROM {events}"""),
    "channel_quality": (["signal_raw"], """
        SELECT subject_id, day, channel,
            CAST((extract(day FROM day) + channel) % 3 AS INT) AS predicted_class,
            (count(*) % 20) / 20.0E0 AS probability_good
        FROM {signal_raw} GROUP BY subject_id, day, channel"""),
    "config": (["part"], """
        SELECT concat('C', p_partkey) AS config_id, 12 * (1 + p_size % 4) AS n_points, (p_size % 3) * 0.25E0 AS overlap,
            concat(CASE WHEN p_partkey % 2 = 0 THEN 'daily:' ELSE 'night:' END, lower(p_type)) AS block,
            CASE WHEN p_size % 2 = 0 THEN 'mean=student_t' ELSE 'mean=skew_normal' END AS mean_part,
            CASE WHEN p_partkey % 3 = 0 THEN 'range=beta' WHEN p_partkey % 3 = 1 THEN 'range=beta_constrained' ELSE '' END AS range_part
        FROM {part}"""),
    "search_result": (["orders"], """
        SELECT concat('R', o_orderkey) AS config_id,
            CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE 'ok' END AS status,
            CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice / 1000 - 250 END AS elpd_loo,
            CAST(1 + o_custkey % 3 AS INT) AS n_features, CAST(20 + o_orderkey % 15 AS INT) AS n_events, 8 AS n_days,
            1 + (o_custkey % 60) / 1000.0E0 AS r_hat_max, 100.0E0 + o_custkey % 900 AS ess_min_bulk,
            CAST(CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS INT) AS n_divergences,
            (o_orderkey % 100) / 110.0E0 AS pareto_k_max,
            2 + (o_custkey % 600) / 100.0E0 AS e_tau, (o_orderkey % 50) / 10.0E0 AS tau_hdi_width,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'beta' WHEN '2-HIGH' THEN 'beta_constrained' WHEN '3-MEDIUM' THEN 'zero_inflated_beta' WHEN '5-LOW' THEN 'normal' ELSE 'interval_inflated_beta' END AS family,
            CASE WHEN o_custkey % 3 = 0 THEN 'mean' WHEN o_custkey % 3 = 1 THEN 'range' ELSE 'mean+range' END AS feature_kind,
            CAST(12 * (1 + o_custkey % 3) AS INT) AS n_points, (o_orderkey % 3) * 0.25E0 AS overlap
        FROM {orders}"""),
    "draws": (["lineitem"], """
        SELECT config_id, CAST(chain AS INT) AS chain, CAST(row_number() OVER (PARTITION BY config_id, chain ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, value) - 1 AS INT) AS draw, value FROM (
            SELECT concat('D', l_suppkey) AS config_id, l_partkey % 2 AS chain, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 10000 AS value FROM {lineitem}) x"""),
    "param_draws": (["supplier"], """
        SELECT concat('N', s_nationkey) AS config_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS draw, s_acctbal / 12000 AS mu FROM {supplier}"""),
    "scored": (["labels"], """
        SELECT doc_id AS id, doc_id % 7 AS grp, quality AS y, ((doc_id * 37 + quality * 29) % 101) / 101.0E0 AS p FROM {labels}"""),
}


def tables_of(name: str) -> list[str]:
    """The given tables that a view reads in the end."""
    return sorted({t for d in VIEWS[name][0] for t in (tables_of(d) if d in VIEWS else [d])})


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    needs, sql = VIEWS[name]
    return spark.sql(sql, **{d: view(spark, sf_dir, d) if d in VIEWS else table(spark, sf_dir, d) for d in needs})


def ctes(*names: str, **more: str) -> str:
    """A WITH clause that defines views, and further ones given as name=sql, for the oracle."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            needs, sql = VIEWS[name]
            for d in needs:
                if d in VIEWS:
                    add(d)
            done[name] = sql.format(**{d: d for d in needs})

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in (done | more).items()) + " "
