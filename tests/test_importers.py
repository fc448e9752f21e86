import json

from tablewatch.plans import expectations as E
from tablewatch.plans.importers import airflow, dbt, expectation_suites, sql_lineage, statement_scopes
from tablewatch.plans.suite import run_suite


def texts(spark, *values, name="sql"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id INT, {name} STRING")


def test_statements(spark):
    cases = {
        "CREATE TABLE shop.sales AS SELECT s.k FROM in.receipts s JOIN in.people p ON s.who = p.k": ("shop.sales", ["in.receipts", "in.people"]),
        "insert into out.weekly select w, max(v) as top from in.raw group by w": ("out.weekly", ["in.raw"]),
        "INSERT OVERWRITE TABLE out.x SELECT l.a FROM in.l l, in.r AS r WHERE l.k = r.k": ("out.x", ["in.l", "in.r"]),
        "MERGE INTO out.m t USING in.news AS n ON t.k = n.k WHEN MATCHED THEN UPDATE SET v = n.v": ("out.m", ["in.news"]),
        "CREATE OR REPLACE VIEW out.v AS SELECT * FROM `in`.`q`": ("out.v", ["in.q"]),
        "CREATE TABLE IF NOT EXISTS t -- from nowhere\n AS /* join hidden */ SELECT * FROM s WHERE c <> 'from dual'": ("t", ["s"]),
        "WITH c AS (SELECT k FROM base), d AS (SELECT * FROM C) INSERT INTO t SELECT k FROM d": ("t", ["base"]),
        "SELECT EXTRACT(year FROM ts), trim(BOTH 'x' FROM n) FROM logs": (None, ["logs"]),
        "SELECT a.k IS DISTINCT FROM a.j FROM logs a": (None, ["logs"]),
        "SELECT * FROM `my tab` m JOIN \"Other `Tab\" USING (k)": (None, ["my tab", "Other `Tab"]),
        "CREATE TABLE t USING parquet AS (SELECT x.a FROM (SELECT a FROM deep) x, (one o JOIN two ON o.a = two.a))": ("t", ["deep", "one", "two"]),
        "INSERT INTO t SELECT x FROM range(10) r LATERAL VIEW explode(r.xs) e AS x WHERE x IN (SELECT k FROM known)": ("t", ["known"]),
        "WITH RECURSIVE r AS (SELECT id FROM tree UNION ALL SELECT t.id FROM tree t JOIN r ON t.up = r.id) SELECT id FROM r": (None, ["tree"]),
        "MERGE INTO m USING (SELECT k FROM fresh) f ON m.k = f.k WHEN NOT MATCHED THEN INSERT (k) VALUES (f.k)": ("m", ["fresh"]),
        "DROP TABLE old; INSERT INTO new SELECT a FROM b": ("new", ["b"]),
        "SELECT a FROM": (None, []), "WITH": (None, []), "SELECT ((": (None, []), "": (None, []), "CREATE": (None, []), "'open": (None, []),
        "SELECT 1": (None, []),
    }
    got = sql_lineage.statements(texts(spark, *cases)).orderBy("id").collect()
    assert [(r["target_table"], r["source_tables"]) for r in got] == list(cases.values())


def test_column_mappings(spark):
    cases = {
        "INSERT INTO wine SELECT upper(v.grape), v.year, 12 bottles, *, v.* FROM cellar.vat v": [
            (0, "upper(v.grape)", "cellar.vat", "grape"), (1, "year", "cellar.vat", "year"), (2, "bottles", None, None)],
        "SELECT least(n.low, m.high) edge, day, -m.depth FROM north n, south m": [
            (0, "edge", "north", "low"), (0, "edge", "south", "high"), (1, "day", None, "day"), (2, "-m.depth", "south", "depth")],
        "SELECT CAST(q.z AS DECIMAL(9, 2)) AS z, date '2024-01-01' + INTERVAL 3 day AS due, q.w::int w, lag(q.p) OVER (PARTITION BY q.o ORDER BY r) FROM q": [
            (0, "z", "q", "z"), (1, "due", None, None), (2, "w", "q", "w"), (3, "lag(q.p) OVER (PARTITION BY q.o ORDER BY r)", "q", "p"),
            (3, "lag(q.p) OVER (PARTITION BY q.o ORDER BY r)", "q", "o"), (3, "lag(q.p) OVER (PARTITION BY q.o ORDER BY r)", None, "r")],
        "WITH c AS (SELECT k, a + b AS ab FROM base), d AS (SELECT c.ab, c.k FROM c) SELECT d.ab, d.k AS id FROM d": [
            (0, "ab", "base", "a"), (0, "ab", "base", "b"), (1, "id", "base", "k")],
        "SELECT s.x, s.gone FROM (SELECT * FROM deep) s": [(0, "x", "deep", "x"), (1, "gone", "deep", "gone")],
        "SELECT t.u AS v FROM t UNION SELECT w.x FROM w": [(0, "v", "t", "u"), (0, "v", "w", "x")],
        "SELECT (SELECT max(i.n) FROM inner_t i WHERE i.k = o.k) AS top, o.k IS DISTINCT FROM o.j FROM outer_t o": [
            (0, "top", "inner_t", "n"), (1, "o.k IS DISTINCT FROM o.j", "outer_t", "k"), (1, "o.k IS DISTINCT FROM o.j", "outer_t", "j")],
        "WITH RECURSIVE r AS (SELECT id FROM tree UNION ALL SELECT r.id FROM r) SELECT r.id FROM r": [(0, "id", "tree", "id")],
        "SELECT 'a, b FROM c' AS words, CASE WHEN f.on_sale THEN 'x' END sale FROM f": [(0, "words", None, None), (1, "sale", "f", "on_sale")],
        "CREATE TABLE t AS SELECT * FROM s": [], "SELECT ,": [], "nothing": [],
    }
    rows = sql_lineage.column_mappings(texts(spark, *cases, None)).collect()
    for k, (sql, want) in enumerate(cases.items()):
        got = [(r["position"], r["target_column"], r["source_table"], r["source_column"]) for r in rows if r["id"] == k]
        assert sorted(got, key=str) == sorted(want, key=str), sql
    assert {r["expression"] for r in rows if r["id"] == 8} == {"'a, b FROM c' AS words", "CASE WHEN f.on_sale THEN 'x' END sale"}


def test_statements_that_differ_in_numbers_are_read_once():
    read = []
    own = statement_scopes.ByTemplate(lambda sql: read.append(sql) or statement_scopes.mappings_of(sql))
    for a, b in ((1, 2), (30, 4), (5, 5), (6, 6), (1, 20)):
        sql = f"INSERT INTO t_{a} SELECT x{b}.c_{a} AS d{b}, 7.9 + x{b}.e{a}{b} FROM s_{b}_{a} x{b} WHERE k = {a}"
        assert own(sql) == statement_scopes.mappings_of(sql)
    assert len(read) == 2  # two different numbers, or the same one twice
    for sql in ("SELECT 1 a" + "".join(f", c{k} d" for k in range(60)), "SELECT \U0001d7ce1 FROM t2"):
        assert own(sql) == statement_scopes.mappings_of(sql)


def test_table_lineage(spark):
    log = ["CREATE VIEW m AS SELECT k FROM l", "CREATE TABLE n AS SELECT k FROM m", "INSERT INTO n SELECT k FROM l", "SELECT k FROM alone"]
    got = {r["table"]: (r["upstream_tables"], r["downstream_tables"]) for r in sql_lineage.table_lineage(texts(spark, *log)).collect()}
    assert got == {"l": ([], ["m", "n"]), "m": (["l"], ["n"]), "n": (["l", "m"], []), "alone": ([], [])}
    rows = {tuple(r) for r in sql_lineage.neighbours(texts(spark, *log)).collect()}
    assert ("alone", None, None) in rows and ("n", "upstream", "m") in rows and len(rows) == 7


MANIFEST = {
    "metadata": {}, "sources": {"s.k": {"name": "tab", "source_name": "src", "database": "raw", "columns": {"id": {"name": "id"}},
                                         "freshness": {"warn_after": {"count": 6, "period": "hours"}}}},
    "nodes": {
        "model.a": {"name": "a", "resource_type": "model", "columns": {"x": {}, "b": {}}, "depends_on": {"nodes": ["model.b", "source.q"]}, "tags": ["hourly"]},
        "model.b": {"name": "b", "resource_type": "model", "database": "db"},
        "test.t": {"name": "t", "resource_type": "test"},
    },
    "child_map": {"model.b": ["model.a", "gone"]}, "parent_map": {"model.a": ["model.b", "source.q"]},
}


def manifests(spark, *docs):
    return spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "manifest_id INT, manifest STRING")


def test_dbt(spark):
    df = manifests(spark, MANIFEST, {"metadata": {}, "nodes": {}, "sources": {}})
    models = {r["name"]: r for r in dbt.models(df).collect()}
    assert set(models) == {"a", "b"}
    assert models["a"]["upstream_models"] == ["b"] and models["a"]["downstream_models"] == [] and models["a"]["columns"] == ["b", "x"]
    assert models["b"]["downstream_models"] == ["a"] and models["b"]["database"] == "db" and models["b"]["tags"] == []
    (source,) = dbt.sources(df).collect()
    assert source["freshness_warn"] == "6 hours" and source["schema"] == ""
    assert {(r["parent"], r["child"], r["kind"]) for r in dbt.edges(df).collect()} == {("b", "a", "dbt_model"), ("source.q", "a", "dbt_model")}


def test_pipeline_events(spark):
    docs = [
        {"dag_id": "load_orders", "run_id": "m1", "state": "success", "execution_date": "2026-07-12T10:00:00Z", "event": "dag_run_success"},
        {"dag_id": "etl_daily", "state": "failed", "execution_date": "2026-07-12T12:00:00+02:00"},
        {"dag_id": "Sync_Users_All", "state": "running", "execution_date": "2026-07-12"},
        {"dag_id": "x", "event": "task_instance_success", "state": "success"},
        {"dag_id": "x", "event": "task_instance_failed"},
        {"dag_id": "x"},
    ]
    got = airflow.events(texts(spark, *map(json.dumps, docs), name="payload")).orderBy("id").collect()
    assert [r["event"] for r in got] == ["DagRunSuccess", "DagRunFailed", "DagRunRunning", "DagRunSuccess", "TaskInstanceFailed", "Unknown"]
    assert [r["affected_table"] for r in got[:3]] == ["orders", "daily", "users.all"]
    assert str(got[1]["execution_date"]) == "2026-07-12 10:00:00" and got[2]["execution_date"] is None
    assert [r["is_terminal"] for r in got] == [True, True, False, True, True, False] and got[5]["unknown_event"] == "no_event"


def test_suite_documents_run(spark, people):
    doc = {"expectation_suite_name": "people", "expectations": [
        {"expectation_type": "expect_column_values_to_not_be_null", "kwargs": {"column": "name"}},
        {"expectation_type": "expect_column_values_to_not_be_in_set", "kwargs": {"column": "dept", "value_set": ["hr", "o'neil"]}},
        {"expectation_type": "expect_column_values_to_be_between", "kwargs": {"column": "age", "min_value": 20}},
        {"expectation_type": "expect_column_to_exist", "kwargs": {"column": "gone"}},
        {"expectation_type": "expect_unknown_custom_thing", "kwargs": {"column": "x"}},
        {"expectation_type": "expect_column_values_to_be_of_type", "kwargs": {"column": "age", "value": "double"}},
    ]}
    rows = expectation_suites.translate(spark.createDataFrame([(json.dumps(doc),)], "document STRING"))
    suite = expectation_suites.to_suites(rows)["people"]
    got = run_suite(suite, people).orderBy("position").collect()
    assert [r["success"] for r in got] == [True, True, True, False, True]
    assert suite.expectations[3].kind == E.COLUMN_EXISTS


def test_all_document_names_are_mapped():
    assert len(expectation_suites.NAMES) == 19


def test_documents_of_one_row_group_are_dealt_out(spark):
    """A small file is read by one task; what follows runs in as many as a shuffle has."""
    from workload.lineages import manifests

    assert manifests(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_edges_parse_only_what_they_read(spark):
    """Columns and tags of a node are not built for its edges."""
    text = '{"nodes": {"model.a": {"name": "a", "resource_type": "model", "tags": ["t"], "columns": {"x": {"name": "x"}}, "depends_on": {"nodes": ["model.b"]}}}}'
    found = dbt.edges(spark.createDataFrame([(1, text)], "manifest_id LONG, manifest STRING"))
    assert [tuple(r) for r in found.collect()] == [(1, "model.b", "a", "dbt_model")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "depends_on" in plan and "StructField(tags" not in plan and "StructField(columns" not in plan
