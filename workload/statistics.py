"""Statistics on whole columns of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewatch.functions.arrays import auto_threshold
from tablewatch.operators.chi_square import chi_square_drift
from tablewatch.operators.correlation import pearson, spearman
from tablewatch.operators.histogram import divergences, histogram, js_drift, paired_histogram
from tablewatch.operators.ks import ks_drift
from tablewatch.operators.local_rows import union_all
from tablewatch.operators.outliers import iqr_outliers, median_and_mad, with_modified_zscore, with_zscore

from .common import injected_sql, r, stamp, table

YEARS = (1997, 1998, 1999)


def _year(column: str, y: int):
    return F.year(column) == y


def _ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price by year against 1996, and a shifted copy of event values against its first half."""
    li, ev = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events_drift")
    half = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    parts = [
        ks_drift(li, "l_extendedprice", _year("l_shipdate", 1996), {str(y): _year("l_shipdate", y) for y in YEARS}),
        ks_drift(li, "l_quantity", _year("l_shipdate", 1996), {"qty1997": _year("l_shipdate", 1997)}),
        ks_drift(ev, "moved", half, {"moved": ~half}),
    ]
    return union_all(parts).select(
        "name", r("score", 9).alias("score"), r("p_value_approx", 9).alias("p_value_approx"), "n_reference", "n_target"
    )


def _ks_sql(name: str, source: str, column: str, ref: str, tgt: str) -> str:
    return f"""
SELECT '{name}' AS name, round(d, 9) AS score,
  round(2 * least(exp(-2 * sqrt(n1 * n2 / (n1 + n2)) * d), 0.5), 9) AS p_value_approx,
  CAST(n1 AS BIGINT) AS n_reference, CAST(n2 AS BIGINT) AS n_target
FROM (
  SELECT max(abs(c1 / n1 - c2 / n2)) AS d, max(n1) AS n1, max(n2) AS n2 FROM (
    SELECT CAST(sum(a) OVER (ORDER BY v) AS DOUBLE) AS c1, CAST(sum(b) OVER (ORDER BY v) AS DOUBLE) AS c2,
      CAST(sum(a) OVER () AS DOUBLE) AS n1, CAST(sum(b) OVER () AS DOUBLE) AS n2
    FROM (SELECT {column} AS v, count_if({ref}) AS a, count_if({tgt}) AS b FROM {source}
          WHERE ({ref}) OR ({tgt}) GROUP BY 1)))"""


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty bins of order prices; a constant column puts everything into bin 0."""
    price = histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20).withColumn("name", F.lit("price"))
    one = histogram(table(spark, sf_dir, "events_nan"), "one", 5).withColumn("name", F.lit("constant"))
    return price.unionByName(one).select(
        "name", "bin", r("bin_low", 4).alias("bin_low"), r("bin_high", 4).alias("bin_high"), "count", r("share", 9).alias("share")
    )


def _histogram_sql(name: str, source: str, column: str, bins: int) -> str:
    return f"""
SELECT '{name}' AS name, CAST(g.i AS INTEGER) AS bin, round(lo + g.i * w, 4) AS bin_low,
  round(lo + (g.i + 1) * w, 4) AS bin_high, coalesce(h.c, 0) AS count,
  round(coalesce(h.c, 0) / n, 9) AS share
FROM (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins}.0 AS w,
        CAST(count(*) AS DOUBLE) AS n FROM {source}) s,
  (SELECT unnest(range({bins})) AS i) g
LEFT JOIN (SELECT b, count(*) AS c FROM (
    SELECT CASE WHEN w <= 0 THEN 0 ELSE least(floor(({column} - lo) / w), {bins} - 1) END AS b
    FROM {source}, (SELECT min({column}) AS lo, (max({column}) - min({column})) / {bins}.0 AS w FROM {source}))
  GROUP BY 1) h ON h.b = g.i"""


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_histogram(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", _year("l_shipdate", 1996),
        {str(y): _year("l_shipdate", y) for y in YEARS},
    )


def _kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_pair(spark, sf_dir), "p", "q", ["name"]).select(
        "name", r("kl", 9).alias("kl"), r("js", 9).alias("js")
    )


def _js(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, ev = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "events_drift")
    half = F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    parts = [
        js_drift(li, "l_extendedprice", _year("l_shipdate", 1996), {str(y): _year("l_shipdate", y) for y in YEARS}),
        js_drift(ev, "moved", half, {"moved": ~half, "nothing": F.lit(False)}),
    ]
    return union_all(parts).select("name", r("score", 9).alias("score"), "n_reference", "n_target")


def _cells_sql(name: str, source: str, column: str, ref: str, tgt: str) -> str:
    """Cells (name, a, b, p, q) of 20 bins on shared limits."""
    return f"""
SELECT '{name}' AS name, a, b, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM (
  SELECT CASE WHEN w <= 0 THEN 0 ELSE least(floor(({column} - lo) / w), 19) END AS bin,
    CAST(count_if({ref}) AS DOUBLE) AS a, CAST(count_if({tgt}) AS DOUBLE) AS b
  FROM {source}, (SELECT min({column}) AS lo, (max({column}) - min({column})) / 20.0 AS w FROM {source}
                  WHERE ({ref}) OR ({tgt}))
  WHERE ({ref}) OR ({tgt}) GROUP BY 1)"""


_KL = "CASE WHEN p > 0 THEN p * ln(p / CASE WHEN q > 0 THEN q ELSE q + 1e-10 END) ELSE 0 END"
_JS = (
    "(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END"
    " + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)"
)
_Y = "year(l_shipdate) = "
_HALF = "ts < TIMESTAMP '2024-01-16 00:00:00'"
_YEAR_CELLS = "\nUNION ALL\n".join(
    _cells_sql(str(y), "lineitem", "l_extendedprice", _Y + "1996", _Y + str(y)) for y in YEARS
)


def _chi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    years = {str(y): _year("o_orderdate", y) for y in YEARS}
    li = table(spark, sf_dir, "lineitem")
    parts = [
        chi_square_drift(orders, "o_orderpriority", _year("o_orderdate", 1996), years),
        # Numbers as labels, and a label the reference has not seen.
        chi_square_drift(
            li, F.when(F.col("l_quantity") > 49, F.lit("top")).otherwise(F.col("l_returnflag")),
            (F.col("l_quantity") <= 49) & _year("l_shipdate", 1996), {"unseen": _year("l_shipdate", 1997)},
        ),
    ]
    return union_all(parts).select(
        "name", r("score").alias("score"), "degrees_of_freedom", "critical_value", "significant", "unseen_labels",
        "n_reference", "n_target",
    )


def _chi_sql(name: str, source: str, label: str, ref: str, tgt: str) -> str:
    return f"""
SELECT '{name}' AS name, round(stat, 6) AS score, dof AS degrees_of_freedom, 3.841::DOUBLE AS critical_value,
  stat > 3.841 AS significant, unseen AS unseen_labels, CAST(tr AS BIGINT) AS n_reference, CAST(tt AS BIGINT) AS n_target
FROM (
  SELECT sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e END) AS stat, count(*) - 1 AS dof,
    count_if(e = 0 AND o > 0) AS unseen, max(tr) AS tr, max(tt) AS tt
  FROM (SELECT o, tr, tt, r / tr * tt AS e FROM (
    SELECT o, CAST(r AS DOUBLE) AS r, CAST(sum(r) OVER () AS DOUBLE) AS tr, CAST(sum(o) OVER () AS DOUBLE) AS tt
    FROM (SELECT {label} AS l, count_if({ref}) AS r, count_if({tgt}) AS o FROM {source}
          WHERE ({ref}) OR ({tgt}) GROUP BY 1))))"""


def _iqr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iqr_outliers(table(spark, sf_dir, "events"), "value", 1.5).select(
        "event_id", "value", r("q1").alias("q1"), r("q3").alias("q3"),
        r("lower_fence").alias("lower_fence"), r("upper_fence").alias("upper_fence"),
    )


def _zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all orders over the whole table and per priority, added up per status."""
    df = with_zscore(table(spark, sf_dir, "orders"), "o_totalprice", name="z")
    df = with_zscore(df, "o_totalprice", ["o_orderpriority"], "z_group")
    return df.groupBy("o_orderstatus").agg(
        r(F.sum(F.abs("z")), 4).alias("sum_abs_z"), r(F.max("z")).alias("max_z"),
        r(F.sum(F.abs("z_group")), 4).alias("sum_abs_z_group"), r(F.min("z_group")).alias("min_z_group"),
    )


def _modified_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_modified_zscore(table(spark, sf_dir, "events"), "value")
    return df.groupBy("event_type").agg(
        r(F.max("modified_zscore")).alias("max_score"), r(F.min("modified_zscore")).alias("min_score"),
        F.count_if(F.abs("modified_zscore") > 3.5).alias("far"),
    )


def _median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    median, mad = median_and_mad(li, "l_extendedprice")
    return li.agg(
        F.count(F.lit(1)).alias("n"), r(F.lit(median)).alias("median"), r(F.lit(mad)).alias("mad")
    )


DAILY = "SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2"


def _threshold(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Limit of the daily event count per type over the last 20 days."""
        daily = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(
            F.count(F.lit(1)).cast("double").alias("n")
        )
        last20 = Window.partitionBy("event_type").orderBy("day").rowsBetween(-19, 0)
        past = daily.withColumn("past", F.collect_list("n").over(last20))
        limit = auto_threshold(F.col("past"), method, 3.0, 0.001, 95.0)
        return past.select("event_type", stamp("day").alias("day"), r(limit).alias("threshold"))

    return run


def _threshold_sql(limit: str) -> str:
    return f"""
SELECT event_type, strftime(day, '%Y-%m-%d %H:%M:%S') AS day,
  round(least(greatest({limit}, 0.001), 95.0), 6) AS threshold
FROM (SELECT *, list_sort(h) AS s, len(h) AS k, list_median(h) AS med FROM (
  SELECT event_type, day, list(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS h
  FROM ({DAILY})))"""


def _pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    by_flag = pearson(li, "l_quantity", "l_extendedprice", ["l_returnflag"])
    constant = pearson(table(spark, sf_dir, "events_nan"), "value", "one").withColumn("l_returnflag", F.lit("constant"))
    part = pearson(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice").withColumn("l_returnflag", F.lit("part"))
    return union_all([by_flag, constant, part]).select(
        F.col("l_returnflag").alias("name"), r("correlation").alias("correlation"), "n"
    )


def _spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        spearman(table(spark, sf_dir, "part"), "p_size", "p_retailprice").withColumn("name", F.lit("part")),
        spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").withColumn("name", F.lit("lineitem")),
    ]
    return union_all(parts).select("name", r("correlation").alias("correlation"), "n")


def _spearman_sql(name: str, source: str, x: str, y: str) -> str:
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (
        f"SELECT '{name}' AS name, round(corr(a, b), 6) AS correlation, count(*) AS n "
        f"FROM (SELECT {rank(x)} AS a, {rank(y)} AS b FROM {source})"
    )


ED = injected_sql("events_drift")

def _chi_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper tail of the test of order priorities against those of 1996: five of them, four degrees of freedom."""
    orders = table(spark, sf_dir, "orders")
    of = lambda year: F.year("o_orderdate") == year
    drift = chi_square_drift(orders, "o_orderpriority", of(1996), {str(y): of(y) for y in (1995, 1997, 1999)}, p_value=True)
    return drift.select("name", F.col("degrees_of_freedom").cast("int").alias("degrees_of_freedom"), r("score").alias("score"), r("p_value").alias("p_value"))


def _chi_p_sql(year: int) -> str:
    """With four degrees of freedom the upper tail of x is exp(-x / 2) * (1 + x / 2)."""
    return f"""
SELECT '{year}' AS name, CAST(k AS INTEGER) AS degrees_of_freedom, round(x, 6) AS score, round(exp(-x / 2) * (1 + x / 2), 6) AS p_value
FROM (
  SELECT sum((b - a * nb / na) ** 2 / (a * nb / na)) AS x, count(*) - 1 AS k FROM (
    SELECT o_orderpriority, count_if(year(o_orderdate) = 1996)::DOUBLE AS a, count_if(year(o_orderdate) = {year})::DOUBLE AS b,
      sum(count_if(year(o_orderdate) = 1996)) OVER ()::DOUBLE AS na, sum(count_if(year(o_orderdate) = {year})) OVER ()::DOUBLE AS nb
    FROM orders GROUP BY 1))"""


QUERIES = {
    "stat_ks": _ks,
    "stat_histogram": _histogram,
    "stat_kl": _kl,
    "stat_js": _js,
    "stat_chi_square": _chi,
    "stat_chi_square_p": _chi_p,
    "stat_iqr_outliers": _iqr,
    "stat_zscore": _zscore,
    "stat_modified_zscore": _modified_z,
    "stat_median_mad": _median_mad,
    "stat_auto_threshold_mad": _threshold("mad"),
    "stat_auto_threshold_iqr": _threshold("iqr"),
    "stat_auto_threshold_sigma": _threshold("sigma"),
    "stat_pearson": _pearson,
    "stat_spearman": _spearman,
}

ORACLE = {
    "stat_ks": "\nUNION ALL\n".join(
        [
            *[_ks_sql(str(y), "lineitem", "l_extendedprice", _Y + "1996", _Y + str(y)) for y in YEARS],
            _ks_sql("qty1997", "lineitem", "l_quantity", _Y + "1996", _Y + "1997"),
            _ks_sql("moved", ED, "moved", _HALF, f"NOT ({_HALF})"),
        ]
    ),
    "stat_histogram": _histogram_sql("price", "orders", "o_totalprice", 20)
    + "\nUNION ALL\n"
    + _histogram_sql("constant", injected_sql("events_nan"), "one", 5),
    "stat_kl": f"SELECT name, round(sum({_KL}), 9) AS kl, round(sum({_JS}) / 2, 9) AS js FROM ({_YEAR_CELLS}) GROUP BY name",
    "stat_js": f"""
SELECT name, round(sum({_JS}) / 2, 9) AS score, CAST(sum(a) AS BIGINT) AS n_reference, CAST(sum(b) AS BIGINT) AS n_target
FROM ({_YEAR_CELLS} UNION ALL {_cells_sql("moved", ED, "moved", _HALF, f"NOT ({_HALF})")}) GROUP BY name
UNION ALL
SELECT 'nothing', NULL, count_if({_HALF}), 0 FROM events""",
    "stat_chi_square_p": "\nUNION ALL\n".join(_chi_p_sql(y) for y in (1995, 1997, 1999)),
    "stat_chi_square": "\nUNION ALL\n".join(
        [
            *[
                _chi_sql(str(y), "orders", "o_orderpriority", "year(o_orderdate) = 1996", f"year(o_orderdate) = {y}")
                for y in YEARS
            ],
            _chi_sql(
                "unseen", "lineitem", "CASE WHEN l_quantity > 49 THEN 'top' ELSE l_returnflag END",
                "l_quantity <= 49 AND year(l_shipdate) = 1996", "year(l_shipdate) = 1997",
            ),
        ]
    ),
    "stat_iqr_outliers": """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
SELECT event_id, value, round(q1, 6) AS q1, round(q3, 6) AS q3,
  round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence
FROM events, q WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""",
    "stat_zscore": """
SELECT o_orderstatus, round(sum(abs(z)), 4) AS sum_abs_z, round(max(z), 6) AS max_z,
  round(sum(abs(zg)), 4) AS sum_abs_z_group, round(min(zg), 6) AS min_z_group
FROM (SELECT o_orderstatus,
    (o_totalprice - avg(o_totalprice) OVER ()) / stddev_samp(o_totalprice) OVER () AS z,
    (o_totalprice - avg(o_totalprice) OVER g) / stddev_samp(o_totalprice) OVER g AS zg
  FROM orders WINDOW g AS (PARTITION BY o_orderpriority)) GROUP BY 1""",
    "stat_modified_zscore": """
WITH m AS (SELECT median(value) AS med, mad(value) AS mad FROM events)
SELECT event_type, round(max(0.6745 * (value - med) / mad), 6) AS max_score,
  round(min(0.6745 * (value - med) / mad), 6) AS min_score,
  count_if(abs(0.6745 * (value - med) / mad) > 3.5) AS far
FROM events, m GROUP BY 1""",
    "stat_median_mad": """
SELECT count(*) AS n, round(median(l_extendedprice), 6) AS median, round(mad(l_extendedprice), 6) AS mad FROM lineitem""",
    "stat_auto_threshold_mad": _threshold_sql("med + 3.0 * 1.4826 * list_median(list_transform(h, lambda x: abs(x - med)))"),
    "stat_auto_threshold_iqr": _threshold_sql(
        "s[CAST(floor(k * 0.75) AS INT) + 1] + 3.0 * (s[CAST(floor(k * 0.75) AS INT) + 1] - s[CAST(floor(k * 0.25) AS INT) + 1])"
    ),
    "stat_auto_threshold_sigma": _threshold_sql("list_avg(h) + 3.0 * list_stddev_pop(h)"),
    "stat_pearson": """
SELECT l_returnflag AS name, round(corr(l_quantity, l_extendedprice), 6) AS correlation, count(*) AS n FROM lineitem GROUP BY 1
UNION ALL
SELECT 'constant', 0.0, count(*) FROM events
UNION ALL
SELECT 'part', round(corr(p_partkey, p_retailprice), 6), count(*) FROM part""",
    "stat_spearman": _spearman_sql("part", "part", "p_size", "p_retailprice")
    + "\nUNION ALL\n"
    + _spearman_sql("lineitem", "lineitem", "l_quantity", "l_extendedprice"),
}
