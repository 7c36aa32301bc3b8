"""Every registered query of the engine against its SQL, at the smallest scale."""

import glob
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fernweave import queries as Q

from .conftest import SMALL

duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    df = Q.QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(Q.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert have == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sections(spark):
    assert Q.QUERIES["f20_sections"](spark, SMALL).where("n_sections > 0").count() == 50
    assert Q.QUERIES["f22_markdown"](spark, SMALL).where("n_sections >= 2").count() == 200
    assert Q.QUERIES["i2_embed"](spark, SMALL).where("norm = 1").count() == 200
    assert Q.QUERIES["s20_crawl"](spark, SMALL).count() > 0


def test_anchors_of_all_first_lines(spark):
    """Every language and the whole line, by the rule in Python."""

    def anchor(text):
        s = re.sub(r"[^\w\s-]", "", text.split("\n")[0].lower()).strip()
        return re.sub("-+", "-", re.sub(r"[\s_]+", "-", s)).strip("-")

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    have = {r.doc_id: r.anchor for r in Q.QUERIES["f19_anchor"](spark, SMALL).collect()}
    assert have == {r.doc_id: anchor(r.text) for r in docs}
    assert len({r.lang for r in docs}) > 1 and max(map(len, have.values())) > 60


@pytest.mark.parametrize("name, most", [("i1_cards", 8), ("r3_hybrid_rrf", 27), ("r10_history_merged", 16), ("r1_lexical_search", 10), ("a7_inventory", 16)])
def test_plans_read_few_tables(spark, name, most):
    """A query reads the predicates that it names, each a part of the stored quads, and no text table again and again."""
    plan = Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") <= most
    assert plan.count("documents.parquet") == 0


def test_graph_is_stored_once_for_each_state(spark, tmp_path):
    from fernweave.plans.tables import table_graph

    at = str(tmp_path / "t")
    write = lambda name, df: df.write.mode("overwrite").parquet(f"file://{at}/{name}.parquet")
    docs = lambda n: spark.range(n).selectExpr("id doc_id", "'some text' text", "'en' lang", "'s' source", "9L n_chars")
    write("labels", spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    write("documents", docs(3))
    n = lambda: table_graph(spark, f"file://{at}", "docs").where("http://purl.org/dc/terms/title").count()
    assert n() == 4 and n() == 4
    write("documents", docs(5))
    assert n() == 6


def same_as_sql(spark, name, **tables):
    """The rows of a query over tables {name: folder or file}, after they have been compared with those of its SQL."""
    at = os.path.commonpath(list(tables.values())) if len(tables) > 1 else os.path.dirname(next(iter(tables.values())))
    c = duckdb.connect()
    for t, path in tables.items():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = Q.QUERIES[name](spark, f"file://{at}")
    rel = c.sql(Q.SQL[name]).select(*df.columns)
    have = sorted((tuple(map(plain, r)) for r in df.collect()), key=repr)
    assert have == sorted((tuple(map(plain, r)) for r in rel.fetchall()), key=repr)
    return have


def written(spark, at, **tables):
    """tables {name: DataFrame} as Parquet in a folder; their paths by name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"file://{at}/{name}.parquet")
    return {name: f"{at}/{name}.parquet" for name in tables}


def test_pages_of_one_url(spark, tmp_path):
    """A page that was fetched more than once, changed or not, has its anchors numbered by itself."""
    pages = spark.createDataFrame([(1, "https://s/a", "<p>1</p>"), (2, "https://s/a", "<p>2</p>"), (2, "https://s/a", "<p>2</p>"), (3, "https://s/b", None)], "page_id long, url string, html string")
    rows = same_as_sql(spark, "c13_page_quads", **written(spark, tmp_path, pages=pages))
    assert {r[2] for r in rows if r[0].endswith("a#same-part-2") and r[1].endswith("#text")} == {"two"}


def test_graph_of_odd_tables(spark, tmp_path, monkeypatch):
    """Repeated, changed and missing keys, and one subject in two sets: the stored quads are the set that the SQL makes, and no task has many rows."""
    from fernweave.plans import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    long = "x" * 300 + "\n" + "y" * 300
    at = written(
        spark,
        tmp_path,
        documents=make([(1, "a\nb", "en", "user8"), (1, "a\nb", "en", "user8"), (1, "other", "de", "s"), (2, long, None, "s"), (2, long + "z", None, "s"), (3, None, "de", None), (None, "t", "de", "s"), (None, "t", "de", "s")], "doc_id long, text string, lang string, source string"),
        labels=make([(1, 1), (1, 0), (2, None), (3, 0), (3, 0), (None, 1)], "doc_id long, quality int"),
        events=make([(1, 8, "view"), (1, 9, "view"), (1, 8, "purchase"), (2, 58, "signup"), (2, 58, "signup"), (3, 8, "error"), (4, None, "click"), (None, 1, "view")], "event_id long, user_id long, event_type string").selectExpr("*", "timestamp_ntz '2024-01-02 03:04:05' + make_interval(0, 0, 0, event_id) ts"),
        orders=make([(i, i % 7, "FOP"[i % 3], "1-URGENT") for i in range(1500)] + [(5, 5, "O", "AI-Implement"), (7, 0, "F", "AI-Implement"), (None, 1, "F", None), (None, 2, "O", "2-HIGH")], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string"),
        customer=make([(i, i % 3, "ABC"[i % 3]) for i in range(7)] + [(2, 1, "Z"), (None, 1, "A")], "c_custkey long, c_nationkey int, c_mktsegment string"),
        supplier=make([(1, 2), (1, 2), (1, None)], "s_suppkey long, s_nationkey int"),
        nation=make([(i, i % 2) for i in range(3)], "n_nationkey int, n_regionkey int"),
    )
    c = duckdb.connect()
    for name, path in at.items():
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'")
    cols = ["g", "s", "p", "o", "o_kind", "o_dt"]
    for names in (("docs", "events", "orders", "places"), ("docs",), ("orders",)):
        have = sorted(map(tuple, tables.table_graph(spark, f"file://{tmp_path}", *names).quads.select(*cols).collect()), key=repr)
        assert have == sorted(c.sql(f"WITH {tables.quads_sql(*names)} SELECT {', '.join(cols)} FROM quads").fetchall(), key=repr)
    rows = tables.set_rows(spark, f"file://{tmp_path}", "orders", f"file://{tmp_path}/rows")
    assert max(r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()) < 250
    keys = {r.k for r in rows.where("_one").collect()}
    assert len(keys) == 1500 - 2 - len([i for i in range(1500) if i % 7 == 2]) and None not in keys


def exchanges(spark, name):
    """(columns, tasks) by which a query's plan deals out rows."""
    plan = Q.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    return [(tuple(re.sub(r"#\d+L?", "", c) for c in cols.split(", ")[:-1]), int(cols.split(", ")[-1])) for cols in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]


@pytest.mark.parametrize("name", ["a2_nodes_by_type", "a4_edge_counts_zero"])
def test_counts_move_no_statements(spark, name):
    """The stored quads are distinct, so they are counted where they lie."""
    assert all(len(cols) == 1 and cols[0] not in ("s", "iri") for cols, _ in exchanges(spark, name))


@pytest.mark.parametrize("name, n, factor", [("a3_by_team", 2, 1), ("a7_inventory", 8, 1), ("r10_history_merged", 8, 1), ("q13_groupby", 1, 4), ("i1_cards", 1, 2)])
def test_tasks_of_nodes_have_a_bounded_number_of_rows(spark, monkeypatch, name, n, factor):
    from fernweave.plans import tables

    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    rows = {"r10_history_merged": 11}.get(name, 16)  # 1,000 events, 1,500 orders
    assert sum(tasks == factor * rows and "s" in cols for cols, tasks in exchanges(spark, name)) >= n


def test_closure_writes_a_pair_once(spark, monkeypatch):
    from fernweave.operators import explore

    cut, n = explore._cut, []
    monkeypatch.setattr(explore, "_cut", lambda df: (out := cut(df), n.append(out.count()))[0])
    edges = spark.createDataFrame([(f"n{i}", "p", f"n{i + 1}") for i in range(6)] + [("n6", "p", "n0"), ("n2", "q", "n9")], "src string, pred string, dst string")
    assert explore.closure(edges, "p", edges.select("src")).distinct().count() == 49
    assert sum(n) == 7 + 49
