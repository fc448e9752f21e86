"""Monitors on clean and changed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewatch.operators.local_rows import union_all
from tablewatch.plans import monitors as M
from tablewatch.sources.history import history_rows

from .common import AS_OF, AS_OF_SQL, flat_monitor, injected_sql, monitor_sql, table
from .statistics import _HALF, _JS, _Y, ED, _cells_sql, _chi_sql, _ks_sql

UNION = "\nUNION ALL\n"


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age per event type, once against a fixed limit and once against limits learned from daily ages."""
    events = table(spark, sf_dir, "events")
    daily = events.groupBy(
        F.concat(F.lit("learned:"), "event_type").alias("monitor_id"),
        F.date_trunc("day", "ts").cast("timestamp").alias("checked_at"),
    ).agg((F.max("value") * 10000.0).alias("score"))
    fixed = M.check_freshness(
        events, M.Freshness("fresh", "events", by=["event_type"], max_age_seconds=432_500, auto_threshold=False), AS_OF
    )
    learned = M.check_freshness(
        events, M.Freshness("learned", "events", by=["event_type"], max_age_seconds=3600), AS_OF,
        daily.withColumn("threshold", F.lit(0.0)),
    )
    return flat_monitor(fixed.unionByName(learned))


_AGES = f"(SELECT event_type, epoch_us({AS_OF_SQL}) - epoch_us(max(ts)) AS us FROM events GROUP BY 1)"
_FRESH_MESSAGE = """CASE WHEN age > lim THEN 'Freshness alert: table ''events'' last updated ' || CAST(age AS BIGINT)
  || 's ago (threshold: ' || CAST(trunc(lim) AS BIGINT) || 's)' ELSE 'Freshness OK: table ''events'' updated ' || CAST(age AS BIGINT) || 's ago' END"""


def _fresh_sql(prefix: str, limit: str, source: str) -> str:
    return monitor_sql(
        f"(SELECT event_type, age, {limit} AS lim FROM (SELECT *, CAST(us // 1000000 AS DOUBLE) AS age FROM {source}))",
        monitor_id=f"'{prefix}:' || event_type", kind="freshness", table_name="events", alert="age > lim",
        critical="age > 2 * lim", score="age", threshold="lim", message=_FRESH_MESSAGE, ts=AS_OF_SQL,
    )


_LEARNED_SOURCE = f"""(SELECT a.event_type, a.us, list_median(h) AS med,
    list_median(list_transform(h, lambda x: abs(x - list_median(h)))) AS dev
  FROM {_AGES} a JOIN (
    SELECT event_type, list(v) AS h FROM (
      SELECT event_type, date_trunc('day', ts) AS d, max(value) * 10000.0 AS v,
        row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('day', ts) DESC) AS rn
      FROM events GROUP BY 1, 2) WHERE rn <= 20 GROUP BY 1) USING (event_type))"""


def _volume_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a quiet day, a missing day and a day loaded four times."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    day = F.to_date("ts")
    quiet = (day != F.lit("2024-01-20").cast("date")) | (F.col("event_id") % 25 == 0)
    e = e.where(quiet & (day != F.lit("2024-01-22").cast("date")))
    copies = F.when(day == F.lit("2024-01-25").cast("date"), F.sequence(F.lit(1), F.lit(4))).otherwise(F.array(F.lit(1)))
    return e.withColumn("copy", F.explode(copies)).drop("copy")


_VOLUME_ROWS = """(SELECT event_type, ts FROM events
  WHERE (CAST(ts AS DATE) <> DATE '2024-01-20' OR event_id % 25 = 0) AND CAST(ts AS DATE) <> DATE '2024-01-22'
  UNION ALL
  SELECT e.event_type, e.ts FROM events e, range(3) WHERE CAST(e.ts AS DATE) = DATE '2024-01-25')"""


def _volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _volume_tables(spark, sf_dir)
    whole = M.check_volume(df, M.Volume("vol", "events"))
    typed = M.check_volume(df, M.Volume("vol", "events", by=["event_type"], bucket="12 hours"))
    sigma = M.ThresholdConfig(method="sigma", sensitivity=1.0)
    other = M.check_volume(df, M.Volume("vol-sigma", "events", threshold=sigma, cold_start="reference"))
    return flat_monitor(union_all([whole, typed, other]))


def volume_relation(key: str, step: str, limit: str) -> str:
    """Relation (key, b, c, k, lim, pct) of the bucket counts."""
    cold = "k <= 3"
    bucket = f"time_bucket(INTERVAL '{step}', ts)"
    return f"""(SELECT *, CASE WHEN {cold} THEN c * 0.5 ELSE greatest({limit}, 0.001) END AS lim,
    CASE WHEN k > 1 AND base > 0 THEN (c - base) / base * 100 ELSE 0 END AS pct
  FROM (SELECT *, len(h) AS k, list_median(h) AS med,
      list_avg(h[1:len(h) - 1]) AS base
    FROM (SELECT key, b, c, list(c) OVER (PARTITION BY key ORDER BY b ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h
      FROM (SELECT g.key, g.b, CAST(coalesce(n, 0) AS DOUBLE) AS c
        FROM (SELECT key, unnest(generate_series(lo, (SELECT max({bucket}) FROM {_VOLUME_ROWS}), INTERVAL '{step}')) AS b
              FROM (SELECT {key} AS key, min({bucket}) AS lo FROM {_VOLUME_ROWS} GROUP BY 1)) g
        LEFT JOIN (SELECT {key} AS key, {bucket} AS b, count(*) AS n FROM {_VOLUME_ROWS} GROUP BY 1, 2) x
          ON x.key = g.key AND x.b = g.b))))"""


def _volume_sql(monitor_id: str, key: str, step: str, limit: str, quiet: bool) -> str:
    cold = "k <= 3"
    off = "(c > lim * 1.5 OR c < lim * 0.1)"
    far = "(c > lim * 2.0 OR c < lim * 0.05)"
    alert = f"CASE WHEN {cold} THEN c = 0 ELSE {off} END" if quiet else off
    critical = f"(c = 0 OR (NOT ({cold}) AND {far}))" if quiet else f"(c = 0 OR {far})"
    return monitor_sql(
        volume_relation(key, step, limit), monitor_id=monitor_id, kind="volume", table_name="events", alert=alert, critical=critical,
        score="c", threshold="lim",
        message=f"""CASE WHEN {alert} THEN 'Volume alert: table ''events'' has ' || CAST(c AS BIGINT) || ' rows (change: '
  || printf('%.1f', pct) || '%)' ELSE 'Volume OK: table ''events'' has ' || CAST(c AS BIGINT) || ' rows' END""",
        ts="b",
    )


_MAD = "med + 3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - list_median(h))))"


def _volume_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = M.ThresholdConfig(method="fixed", fixed=40.0)
    return flat_monitor(
        M.check_volume(_volume_tables(spark, sf_dir), M.Volume("fixed", "events", threshold=fixed, by=["event_type"]))
    )


def _volume_fixed_sql() -> str:
    alert = "(c > 60.0 OR c < 4.0)"
    source = f"""(SELECT g.key, g.b, coalesce(n, 0) AS c
  FROM (SELECT key, unnest(generate_series(lo, (SELECT max(date_trunc('day', ts)) FROM {_VOLUME_ROWS}), INTERVAL '1 day')) AS b
        FROM (SELECT event_type AS key, min(date_trunc('day', ts)) AS lo FROM {_VOLUME_ROWS} GROUP BY 1)) g
  LEFT JOIN (SELECT event_type AS key, date_trunc('day', ts) AS b, count(*) AS n FROM {_VOLUME_ROWS} GROUP BY 1, 2) x
    ON x.key = g.key AND x.b = g.b)"""
    return monitor_sql(
        source, monitor_id="'fixed:' || key", kind="volume", table_name="events", alert=alert, critical="c = 0",
        score="c", threshold="40.0",
        message=f"""CASE WHEN {alert} THEN 'Volume alert: table ''events'' has ' || c || ' rows'
  ELSE 'Volume OK: table ''events'' has ' || c || ' rows' END""",
        ts="b",
    )


def _changed_orders(df: DataFrame) -> DataFrame:
    return df.drop("o_custkey").withColumns(
        {"o_orderkey": F.col("o_orderkey").cast("string"), "o_channel": F.lit("web")}
    )


def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against a changed copy, against itself, and without an earlier snapshot."""
    orders = table(spark, sf_dir, "orders")
    now, before = M.schema_snapshot(_changed_orders(orders), "orders"), M.schema_snapshot(orders, "orders")
    results = union_all(
        [
            M.check_schema(M.Schema("schema-changed", "orders"), now, before, AS_OF),
            M.check_schema(M.Schema("schema-same", "orders"), before, before, AS_OF),
            M.check_schema(M.Schema("schema-first", "orders"), now, None, AS_OF),
        ]
    )
    # The row count shows the table the verdict belongs to.
    n = orders.agg(F.count(F.lit(1)).alias("n")).scalar()
    return flat_monitor(results).withColumn("table_rows", n)


_SCHEMA_CHANGES = "~o_orderkey: bigint -> string, +o_channel (string), -o_custkey (bigint)"
_SCHEMA_SQL = f"""
SELECT m AS monitor_id, 'schema' AS monitor_type, 'orders' AS table_name, s > 0 AS alert,
  CASE WHEN s > 0 THEN 'WARNING' ELSE 'INFO' END AS severity, CAST(s AS DOUBLE) AS score, 0.0::DOUBLE AS threshold,
  CASE WHEN s > 0 THEN 'Schema alert: table ''orders'' schema changed — [{_SCHEMA_CHANGES}]'
    ELSE 'Schema OK: table ''orders'' schema unchanged' END AS message,
  '{AS_OF}' AS ts, (SELECT count(*) FROM orders) AS table_rows
FROM (VALUES ('schema-changed', 3), ('schema-same', 0), ('schema-first', 0)) t(m, s)"""

YEARS = tuple(range(1997, 2002))


def _dist(cfg: M.Distribution, years: tuple[int, ...] = YEARS):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Every year against 1996; limits are learned from the years before once there are six."""
        column = "l_shipdate" if cfg.table == "lineitem" else "o_orderdate"
        targets = {f"{y}-01-01 00:00:00": f"year({column}) = {y}" for y in years}
        return flat_monitor(M.drift_series(table(spark, sf_dir, cfg.table), cfg, targets))

    return run


def _dist_sql(cfg_id: str, scores: str, table_name: str, metric: str, limit: str, critical: str, bad: str, good: str) -> str:
    return monitor_sql(
        f"(SELECT name, s AS score, {limit} AS lim, make_timestamp(CAST(name AS BIGINT), 1, 1, 0, 0, 0) AS moment FROM {scores})",
        monitor_id=f"'{cfg_id}'", kind="distribution", table_name=table_name, alert="score > lim", critical=critical,
        score="score", threshold="lim", message=f"CASE WHEN score > lim THEN {bad} ELSE {good} END", ts="moment",
    )


def _drift_texts(table_name: str, metric: str) -> tuple[str, str]:
    return (
        f"printf('Distribution drift detected on ''{table_name}'': {metric} score=%.4f (threshold=%.4f)', score, lim)",
        f"printf('Distribution OK on ''{table_name}'': {metric} score=%.4f', score)",
    )


_KS_SCORES = "(SELECT name, score AS s FROM (" + UNION.join(
    _ks_sql(str(y), "lineitem", "l_extendedprice", _Y + "1996", _Y + str(y)) for y in YEARS
) + "))"
_JS_SCORES = f"(SELECT name, sum({_JS}) / 2 AS s FROM (" + UNION.join(
    _cells_sql(str(y), "lineitem", "l_extendedprice", _Y + "1996", _Y + str(y)) for y in YEARS
) + ") GROUP BY name)"
_CHI_SCORES = "(SELECT name, score AS s FROM (" + UNION.join(
    _chi_sql(str(y), "lineitem", "CAST(l_quantity AS VARCHAR)", _Y + "1996", _Y + str(y)) for y in YEARS
) + "))"
_CAT_SCORES = "(SELECT name, score AS s FROM (" + UNION.join(
    _chi_sql(str(y), "orders", "o_orderpriority", "year(o_orderdate) = 1996", f"year(o_orderdate) = {y}") for y in YEARS
) + "))"


def _dist_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shifted half of the events against the first: a stored baseline, and limits from history.

    The history is the daily mean of the values, scaled down to drift size.
    """
    events = table(spark, sf_dir, "events_drift")
    first = events.where(F.expr(_HALF))
    baseline = M.capture_reference(first, "moved")
    history = (
        first.groupBy(F.date_trunc("day", "ts").cast("timestamp").alias("checked_at"))
        .agg((F.avg("moved") / 1000.0).alias("score"))
        .select(F.lit("drift").alias("monitor_id"), "score", F.lit(0.3).alias("threshold"), "checked_at")
    )
    cfg = M.Distribution("drift", "events", column="moved", target=f"NOT ({_HALF})")
    return flat_monitor(
        M.against_summary(events, cfg, baseline, AS_OF, history).unionByName(
            M.check_distribution(
                events, M.Distribution("plain", "events", column="moved", metric="js", reference=_HALF, target=f"NOT ({_HALF})"),
                AS_OF, history,
            )
        )
    )


_DIST_HISTORY_SQL = UNION.join(
    monitor_sql(
        source, monitor_id=f"'{name}'", kind="distribution", table_name="events", alert="score > lim",
        critical="score > 2 * lim", score="score", threshold="lim",
        message="CASE WHEN score > lim THEN {} ELSE {} END".format(*_drift_texts("events", metric)), ts=AS_OF_SQL,
    )
    for name, metric, source in (
        (
            "drift", "ks",
            f"""(SELECT k.score, list_median(h) + 3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - list_median(h)))) AS lim
  FROM ({_ks_sql("x", ED, "moved", _HALF, f"NOT ({_HALF})")}) k,
    (SELECT list(v) AS h FROM (SELECT avg(moved) / 1000.0 AS v FROM {ED} WHERE {_HALF} GROUP BY date_trunc('day', ts)
      ORDER BY date_trunc('day', ts) DESC LIMIT 20)))""",
        ),
        (
            "plain", "js",
            f"(SELECT sum({_JS}) / 2 AS score, 0.1 AS lim FROM ({_cells_sql('x', ED, 'moved', _HALF, f'NOT ({_HALF})')}))",
        ),
    )
)


def _custom_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"orders": table(spark, sf_dir, "orders"), "lineitem": table(spark, sf_dir, "lineitem")}
    avg = "SELECT avg(o_totalprice) FROM orders"
    late = "SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate"
    cfgs = [
        M.CustomSql("sql-high", "orders", query=avg, expected=1000.0, comparison=">"),
        M.CustomSql("sql-low", "orders", query=avg, expected=1000.0, comparison="<"),
        M.CustomSql("sql-late", "orders", query=late, expected=0.0, comparison="="),
        M.CustomSql("sql-count", "orders", query="SELECT count(*) FROM orders", expected=None, comparison="="),
    ]
    return flat_monitor(union_all([M.check_custom_sql(tables, c, AS_OF) for c in cfgs]), 3)


def _custom_sql_sql() -> str:
    avg = "(SELECT avg(o_totalprice) AS o FROM orders)"
    late = "(SELECT count(*) AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate)"
    parts = (
        ("sql-high", avg, "o > 1000", ">", "1000.0"),
        ("sql-low", avg, "o < 1000", "<", "1000.0"),
        ("sql-late", late, "abs(o - 0) > 1e-6", "=", "0.0"),
        ("sql-count", "(SELECT count(*) AS o FROM orders)", "false", "=", "0.0"),
    )
    return UNION.join(
        monitor_sql(
            source, monitor_id=f"'{name}'", kind="custom_sql", table_name="orders", alert=alert, critical="false",
            score="o", threshold=expected, digits=3,
            message=f"""CASE WHEN {alert} THEN printf('Custom SQL alert: observed=%.4f {op} expected=%.4f', CAST(o AS DOUBLE), CAST({expected} AS DOUBLE))
  ELSE printf('Custom SQL OK: observed=%.4f', CAST(o AS DOUBLE)) END""",
            ts=AS_OF_SQL,
        )
        for name, source, alert, op, expected in parts
    )


def _correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part, ev = (table(spark, sf_dir, n) for n in ("lineitem", "part", "events_nan"))
    cfgs = [
        (li, M.Correlation("corr-weak", "lineitem", column_x="l_quantity", column_y="l_extendedprice", min_abs=0.8)),
        (part, M.Correlation("corr-rank", "part", column_x="p_partkey", column_y="p_retailprice", method="spearman", min_abs=0.1)),
        (ev, M.Correlation("corr-constant", "events", column_x="value", column_y="one", min_abs=0.5)),
    ]
    return flat_monitor(union_all([M.check_correlation(df, c, AS_OF) for df, c in cfgs]))


def _correlation_sql() -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    parts = (
        ("corr-weak", "lineitem", "(SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem)", "pearson", 0.8),
        (
            "corr-rank", "part",
            f"(SELECT corr(a, b) AS c FROM (SELECT {rank('p_partkey')} AS a, {rank('p_retailprice')} AS b FROM part))",
            "spearman", 0.1,
        ),
        ("corr-constant", "events", "(SELECT CASE WHEN count(*) >= 3 THEN 0.0::DOUBLE END AS c FROM events)", "pearson", 0.5),
    )
    return UNION.join(
        monitor_sql(
            source, monitor_id=f"'{name}'", kind="correlation", table_name=tab, alert=f"abs(c) < {limit}", critical="false",
            score="c", threshold=str(limit),
            message=f"""CASE WHEN abs(c) < {limit} THEN printf('Correlation alert: {method}=%.4f below threshold %.4f', c, CAST({limit} AS DOUBLE))
  ELSE printf('Correlation OK: {method}=%.4f', c) END""",
            ts=AS_OF_SQL,
        )
        for name, tab, source, method, limit in parts
    )


def _uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfgs = [
        M.Uniqueness("uniq-line", "lineitem", columns=["l_orderkey", "l_linenumber"], max_ratio=0.1),
        M.Uniqueness("uniq-order", "orders", columns=["o_orderkey"], max_ratio=0.0),
        M.Uniqueness("uniq-text", "documents", columns=["text"], max_ratio=0.01),
    ]
    return flat_monitor(union_all([M.check_uniqueness(table(spark, sf_dir, c.table), c, AS_OF) for c in cfgs]))


def _uniqueness_sql() -> str:
    parts = (
        ("uniq-line", "lineitem", "l_orderkey, l_linenumber", 0.1),
        ("uniq-order", "orders", "o_orderkey", 0.0),
        ("uniq-text", "documents", "text", 0.01),
    )
    return UNION.join(
        monitor_sql(
            f"(SELECT (sum(n) - count(*)) / CAST(sum(n) AS DOUBLE) AS share FROM (SELECT {key}, count(*) AS n FROM {tab} GROUP BY ALL))",
            monitor_id=f"'{name}'", kind="uniqueness", table_name=tab, alert=f"share > {limit}", critical="false",
            score="share", threshold=str(limit),
            message=f"""CASE WHEN share > {limit} THEN printf('Uniqueness alert: %.1f%% duplicates (threshold: %.1f%%)', share * 100, {limit} * 100.0::DOUBLE)
  ELSE printf('Uniqueness OK: %.1f%% duplicates', share * 100) END""",
            ts=AS_OF_SQL,
        )
        for name, tab, key, limit in parts
    )


def _referential(spark: SparkSession, sf_dir: str) -> DataFrame:
    load = lambda n: table(spark, sf_dir, n)
    ref = M.ReferentialIntegrity
    return flat_monitor(
        union_all(
            [
                M.check_referential(load("documents"), load("labels"), ref("ref-labels", "documents", columns=["doc_id"]), AS_OF),
                M.check_referential(
                    load("lineitem"), load("orders"),
                    ref("ref-orders", "lineitem", columns=["l_orderkey"], target_columns=["o_orderkey"]), AS_OF,
                ),
                M.check_referential(
                    load("lineitem_bad"), load("part"),
                    ref("ref-part", "lineitem", columns=["part_bad"], target_columns=["p_partkey"]), AS_OF,
                ),
            ]
        )
    )


def _referential_sql() -> str:
    parts = (
        ("ref-labels", "documents", "documents", "doc_id", "labels", "doc_id"),
        ("ref-orders", "lineitem", "lineitem", "l_orderkey", "orders", "o_orderkey"),
        ("ref-part", "lineitem", injected_sql("lineitem_bad"), "part_bad", "part", "p_partkey"),
    )
    return UNION.join(
        monitor_sql(
            f"""(SELECT count(*) AS n, count_if(k IS NOT NULL AND NOT hit) AS o FROM (
    SELECT s.{key} AS k, t.{target_key} IS NOT NULL AS hit FROM {source} s LEFT JOIN {target} t ON s.{key} = t.{target_key}))""",
            monitor_id=f"'{name}'", kind="referential", table_name=tab, alert="o > 0", critical="true",
            score="o", threshold="0",
            message="""CASE WHEN o > 0 THEN 'Referential integrity alert: ' || o || printf(' orphan rows (%.1f%%)', o * 100.0::DOUBLE / n)
  ELSE 'Referential integrity OK: no orphan rows' END""",
            ts=AS_OF_SQL,
        )
        for name, tab, source, key, target, target_key in parts
    )


def _ml_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by year, a shifted score, and the accuracy of a length rule for document quality."""
    li, ev = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events_drift")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "lang", "quality", (F.col("n_chars") > 1000).cast("int").alias("predicted")
    )
    return flat_monitor(
        union_all(
            [
                M.check_ml_drift(
                    li,
                    M.MlDrift("ml-features", "lineitem", model="pricing", metric="feature_drift",
                              columns=["l_quantity", "l_extendedprice"], baseline=_Y + "1996", current=_Y + "1997", limit=0.1),
                    AS_OF,
                ),
                M.check_ml_drift(
                    ev,
                    M.MlDrift("ml-scores", "events", model="value", metric="prediction_drift", columns=["moved"],
                              baseline=_HALF, current=f"NOT ({_HALF})", limit=0.1, statistic="ks"),
                    AS_OF,
                ),
                M.check_ml_drift(
                    docs,
                    M.MlDrift("ml-accuracy", "documents", model="quality", metric="accuracy_drop", columns=["predicted"],
                              label="quality", baseline="lang = 'en'", current="lang <> 'en'", limit=0.02),
                    AS_OF,
                ),
            ]
        )
    )


def _ml_drift_sql() -> str:
    js = lambda c: f"(SELECT sum({_JS}) / 2 AS s FROM ({_cells_sql('x', 'lineitem', c, _Y + '1996', _Y + '1997')}))"
    hit = "CAST((n_chars > 1000) = (quality = 1) AS INT)"
    parts = (
        ("ml-features:l_quantity", "lineitem", js("l_quantity"), "pricing", "feature_drift", 0.1),
        ("ml-features:l_extendedprice", "lineitem", js("l_extendedprice"), "pricing", "feature_drift", 0.1),
        (
            "ml-scores", "events", f"(SELECT score AS s FROM ({_ks_sql('x', ED, 'moved', _HALF, f'NOT ({_HALF})')}))",
            "value", "prediction_drift", 0.1,
        ),
        (
            "ml-accuracy", "documents",
            f"(SELECT avg({hit}) FILTER (lang = 'en') - avg({hit}) FILTER (lang <> 'en') AS s FROM documents JOIN labels USING (doc_id))",
            "quality", "accuracy_drop", 0.02,
        ),
    )
    return UNION.join(
        monitor_sql(
            source, monitor_id=f"'{name}'", kind="ml_drift", table_name=tab, alert=f"s > {limit}",
            critical=f"s > {2 * limit}", score="s", threshold=str(limit),
            message=f"""CASE WHEN s > {limit} THEN printf('ML drift alert: model ''{model}'' {metric}=%.4f (threshold=%.4f)', s, CAST({limit} AS DOUBLE))
  ELSE printf('ML drift OK: model ''{model}'' {metric}=%.4f', s) END""",
            ts=AS_OF_SQL,
        )
        for name, tab, source, model, metric, limit in parts
    )


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per supplier as cost, against budgets derived from the account balance."""
    usage = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("s_suppkey"), F.round("l_extendedprice", 0).alias("cost")
    )
    budgets = table(spark, sf_dir, "supplier").select(
        "s_suppkey", (F.greatest(F.round("s_acctbal", 0), F.lit(1.0)) * 6000.0).alias("budget")
    )
    per_supplier = M.check_cost(
        usage, M.Cost("cost", "lineitem", resource="storage_cost", resource_column="s_suppkey"), AS_OF, budgets
    )
    whole = M.check_cost(usage, M.Cost("cost-all", "lineitem", resource="query_cost", budget=1e15), AS_OF)
    return flat_monitor(per_supplier.unionByName(whole), 2)


def _cost_sql() -> str:
    def part(source: str, monitor_id: str, resource: str) -> str:
        times = "CASE WHEN b > 0 THEN c / b ELSE 1 END"
        return monitor_sql(
            source, monitor_id=monitor_id, kind="cost", table_name="lineitem", alert="c > b",
            critical=f"{times} > 2", score="c", threshold="b", digits=2,
            message=f"""CASE WHEN c > b THEN printf('Cost alert: {resource} cost=%.2f exceeds budget=%.2f (x%.1f)', c, b, {times})
  ELSE printf('Cost OK: {resource} cost=%.2f within budget=%.2f', c, b) END""",
            ts=AS_OF_SQL,
        )

    cost = "sum(round(l_extendedprice, 0))"
    return UNION.join(
        (
            part(
                f"""(SELECT s_suppkey AS k, c, greatest(round(s_acctbal, 0), 1.0) * 6000.0 AS b FROM supplier
  JOIN (SELECT l_suppkey, {cost} AS c FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey)""",
                "'cost:' || k", "storage_cost",
            ),
            part(f"(SELECT {cost} AS c, 1e15 AS b FROM lineitem)", "'cost-all'", "query_cost"),
        )
    )


def _run_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configured set with one monitor switched off."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    cfgs = [
        M.Uniqueness("set-uniq", "orders", columns=["o_custkey"], max_ratio=0.5),
        M.ReferentialIntegrity("set-ref", "lineitem", columns=["l_orderkey"], target_table="orders", target_columns=["o_orderkey"]),
        M.Freshness("set-fresh", "events", max_age_seconds=100_000),
        M.CustomSql("set-off", "orders", query="SELECT 1", enabled=False),
    ]
    return flat_monitor(M.run_monitors(cfgs, tables, AS_OF))


_RUN_SET_SQL = f"""
SELECT * FROM ({monitor_sql(
    "(SELECT 1 - count(DISTINCT o_custkey) / CAST(count(*) AS DOUBLE) AS share FROM orders)",
    monitor_id="'set-uniq'", kind="uniqueness", table_name="orders", alert="share > 0.5", critical="false",
    score="share", threshold="0.5", ts=AS_OF_SQL,
    message="CASE WHEN share > 0.5 THEN printf('Uniqueness alert: %.1f%% duplicates (threshold: 50.0%%)', share * 100) "
            "ELSE printf('Uniqueness OK: %.1f%% duplicates', share * 100) END")})
UNION ALL
SELECT * FROM ({monitor_sql(
    "(SELECT count(*) AS o FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))",
    monitor_id="'set-ref'", kind="referential", table_name="lineitem", alert="o > 0", critical="true",
    score="o", threshold="0", ts=AS_OF_SQL, message="CASE WHEN o > 0 THEN 'bad' ELSE 'Referential integrity OK: no orphan rows' END")})
UNION ALL
SELECT * FROM ({monitor_sql(
    f"(SELECT CAST((epoch_us({AS_OF_SQL}) - epoch_us(max(ts))) // 1000000 AS DOUBLE) AS age, 100000.0 AS lim FROM events)",
    monitor_id="'set-fresh'", kind="freshness", table_name="events", alert="age > lim", critical="age > 2 * lim",
    score="age", threshold="lim", ts=AS_OF_SQL, message=_FRESH_MESSAGE)})"""


def _run_set_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitors that fail while they run, beside others that share their tables' scans."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "lineitem", "events")}
    cfgs = [
        M.CustomSql("err-sql", "orders", query="SELECT sum(o_totalprice / (o_orderkey % 2)) FROM orders"),
        M.Cost("err-cost", "lineitem", cost_column="l_extendedprice / (l_orderkey % 2)", budget=1.0),
        M.Freshness("err-by", "events", max_age_seconds=100_000, by=["event_type"]),
        M.Freshness("err-fresh", "events", max_age_seconds=100_000),
        M.Cost("err-spent", "lineitem", cost_column="l_discount", resource_column="l_returnflag", budget=1e9),
        M.Correlation("err-pearson", "lineitem", column_x="l_quantity", column_y="l_extendedprice", min_abs=0.5),
        M.ReferentialIntegrity("err-ref", "lineitem", columns=["l_orderkey"], target_table="orders", target_columns=["o_orderkey"]),
        M.Uniqueness("err-column", "orders", columns=["o_nothing"]),
    ]
    return flat_monitor(M.run_monitors(cfgs, tables, AS_OF))


def _error_sql(monitor: str, table_name: str, problem: str) -> str:
    return monitor_sql(
        "(SELECT 1)", monitor_id=f"'{monitor}'", kind="error", table_name=table_name, alert="true", critical="true",
        score="NULL", threshold="NULL", ts=AS_OF_SQL, message=f"'Monitor failed: {problem}'",
    )


_RUN_SET_ERRORS_SQL = "\nUNION ALL\n".join(f"SELECT * FROM ({q})" for q in (
    _error_sql("err-sql", "orders", "DIVIDE_BY_ZERO"),
    _error_sql("err-cost", "lineitem", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
    _error_sql("err-column", "orders", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
    monitor_sql(
        f"(SELECT event_type, CAST((epoch_us({AS_OF_SQL}) - epoch_us(max(ts))) // 1000000 AS DOUBLE) AS age, 100000.0 AS lim FROM events GROUP BY 1)",
        monitor_id="'err-by:' || event_type", kind="freshness", table_name="events", alert="age > lim", critical="age > 2 * lim",
        score="age", threshold="lim", ts=AS_OF_SQL, message=_FRESH_MESSAGE),
    monitor_sql(
        f"(SELECT CAST((epoch_us({AS_OF_SQL}) - epoch_us(max(ts))) // 1000000 AS DOUBLE) AS age, 100000.0 AS lim FROM events)",
        monitor_id="'err-fresh'", kind="freshness", table_name="events", alert="age > lim", critical="age > 2 * lim",
        score="age", threshold="lim", ts=AS_OF_SQL, message=_FRESH_MESSAGE),
    monitor_sql(
        "(SELECT l_returnflag, sum(l_discount) AS spent FROM lineitem GROUP BY 1)",
        monitor_id="'err-spent:' || l_returnflag", kind="cost", table_name="lineitem", alert="spent > 1e9", critical="false",
        score="spent", threshold="1e9", ts=AS_OF_SQL, message="printf('Cost OK: query_cost cost=%.2f within budget=1000000000.00', spent)"),
    monitor_sql(
        "(SELECT corr(l_quantity, l_extendedprice) AS c FROM lineitem)",
        monitor_id="'err-pearson'", kind="correlation", table_name="lineitem", alert="abs(c) < 0.5", critical="false",
        score="c", threshold="0.5", ts=AS_OF_SQL,
        message="CASE WHEN abs(c) < 0.5 THEN printf('Correlation alert: pearson=%.4f below threshold 0.5000', c) ELSE printf('Correlation OK: pearson=%.4f', c) END"),
    monitor_sql(
        "(SELECT count(*) AS o FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))",
        monitor_id="'err-ref'", kind="referential", table_name="lineitem", alert="o > 0", critical="true",
        score="o", threshold="0", ts=AS_OF_SQL, message="CASE WHEN o > 0 THEN 'bad' ELSE 'Referential integrity OK: no orphan rows' END"),
))


def event_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-day volume results per event type, the input of histories, hints and incidents."""
    cfg = M.Volume("vol", "events", by=["event_type"], bucket="12 hours")
    return M.check_volume(_volume_tables(spark, sf_dir), cfg)


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_rows(event_volumes(spark, sf_dir))


VOLUME_BY_TYPE = volume_relation("event_type", "12 hours", _MAD)
VOLUME_BY_TYPE_SQL = _volume_sql("'vol:' || key", "event_type", "12 hours", _MAD, True)

KS = M.Distribution("dist-ks", "lineitem", column="l_extendedprice", metric="ks", reference=_Y + "1996")
JS = M.Distribution("dist-js", "lineitem", column="l_extendedprice", metric="js", reference=_Y + "1996")
CHI = M.Distribution("dist-chi2", "lineitem", column="l_quantity", metric="chi_square", reference=_Y + "1996")
CAT = M.Distribution("dist-cat", "orders", column="o_orderpriority", metric="categorical", reference="year(o_orderdate) = 1996")

QUERIES = {
    "mon_freshness": _freshness,
    "mon_volume": _volume,
    "mon_volume_fixed": _volume_fixed,
    "mon_schema": _schema,
    "mon_dist_ks": _dist(KS),
    "mon_dist_js": _dist(JS),
    "mon_dist_chi2": _dist(CHI),
    "mon_dist_categorical": _dist(CAT),
    "mon_dist_history": _dist_history,
    "mon_custom_sql": _custom_sql,
    "mon_correlation": _correlation,
    "mon_uniqueness": _uniqueness,
    "mon_referential": _referential,
    "mon_ml_drift": _ml_drift,
    "mon_cost": _cost,
    "mon_run_set": _run_set,
    "mon_run_set_errors": _run_set_errors,
}

_KS_TEXT, _JS_TEXT, _CHI_TEXT = (_drift_texts("lineitem", m) for m in ("ks", "js", "chi_square"))

ORACLE = {
    "mon_freshness": _fresh_sql("fresh", "432500.0", _AGES)
    + UNION
    + _fresh_sql("learned", "greatest(med + 3.0 * 1.4826 * dev, 3600.0)", _LEARNED_SOURCE),
    "mon_volume": UNION.join(
        (
            _volume_sql("'vol'", "1", "1 day", _MAD, True),
            VOLUME_BY_TYPE_SQL,
            _volume_sql("'vol-sigma'", "1", "1 day", "list_avg(h) + list_stddev_pop(h)", False),
        )
    ),
    "mon_volume_fixed": _volume_fixed_sql(),
    "mon_schema": _SCHEMA_SQL,
    "mon_dist_ks": _dist_sql("dist-ks", _KS_SCORES, "lineitem", "ks", "0.3", "score > 2 * lim", *_KS_TEXT),
    "mon_dist_js": _dist_sql("dist-js", _JS_SCORES, "lineitem", "js", "0.1", "score > 2 * lim", *_JS_TEXT),
    "mon_dist_chi2": _dist_sql("dist-chi2", _CHI_SCORES, "lineitem", "chi_square", "3.841", "score > 2 * lim", *_CHI_TEXT),
    "mon_dist_categorical": _dist_sql(
        "dist-cat", _CAT_SCORES, "orders", "categorical", "3.841", "false",
        "printf('Categorical distribution drift on ''orders'': chi-sq=%.4f', score)",
        "printf('Categorical distribution OK on ''orders'': chi-sq=%.4f', score)",
    ),
    "mon_dist_history": _DIST_HISTORY_SQL,
    "mon_custom_sql": _custom_sql_sql(),
    "mon_correlation": _correlation_sql(),
    "mon_uniqueness": _uniqueness_sql(),
    "mon_referential": _referential_sql(),
    "mon_ml_drift": _ml_drift_sql(),
    "mon_cost": _cost_sql(),
    "mon_run_set": _RUN_SET_SQL,
    "mon_run_set_errors": _RUN_SET_ERRORS_SQL,
}
