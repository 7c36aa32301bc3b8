"""The star-schema and text tables as a graph: one list of facts, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT_NAMESPACE, GraphConfig
from ..model import QUAD, TERM
from ..storage import delete, fresh_dir, state_of
from . import graph as G
from .construct import DATETIME, INTEGER, STRING
from .graph import Graph

R, O = DEFAULT_NAMESPACE + "resource/", DEFAULT_NAMESPACE + "onto#"  # noqa: E741
SPINE, RUN = R + "graph/spine", R + "graph/run/r0"


def s(x: str) -> str:
    """A number as text, in SQL."""
    return f"CAST({x} AS STRING)"


def o(name: str) -> str:
    return f"'{O}{name}'"


#: (base rows, facts): a fact is (graph, subject, predicate, object, kind, datatype); a null object is no fact.
SETS: dict[str, tuple[str, list[tuple[str, str, str, str, str, str | None]]]] = {
    "docs": (
        f"""SELECT id, text, lang, source, quality, cls, title, '{R}topic/' || lang AS topic, '{R}repo/' || source AS repo, '{R}doc/corpus/' || {s('id')} AS doc, '{R}run/r0' AS run,
          CASE cls WHEN 'Learning' THEN '{R}learning/corpus/solutions/' WHEN 'Decision' THEN '{R}decision/corpus/adr/' ELSE '{R}doc/corpus/' END || {s('id')} AS node
        FROM (SELECT d.doc_id AS id, d.text, d.lang, d.source, l.quality, CASE l.quality WHEN 1 THEN 'Learning' WHEN 0 THEN 'Decision' ELSE 'Doc' END AS cls,
            'DOC-' || {s('d.doc_id')} || ' ' || substr(regexp_extract(d.text, '^[^' || chr(10) || ']*', 0), 1, 80) AS title
          FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id) x""",
        [
            (SPINE, "node", G.RDF_TYPE, f"'{O}' || cls", "iri", None),
            (SPINE, "node", G.TITLE, "title", "literal", STRING),
            (RUN, "node", O + "fix", "CASE WHEN quality = 1 THEN substr(text, 1, 400) END", "literal", None),
            (RUN, "node", O + "detail", "CASE WHEN quality = 1 THEN NULL ELSE substr(text, 1, 400) END", "literal", None),
            (RUN, "node", O + "category", "CASE WHEN quality = 1 THEN source END", "literal", None),
            (RUN, "node", O + "priority", f"CASE WHEN quality = 1 THEN 'P' || {s('id % 5')} END", "literal", None),
            (SPINE, "node", O + "tagged", "topic", "iri", None),
            (SPINE, "topic", G.RDF_TYPE, o("Topic"), "iri", None),
            (SPINE, "topic", G.PREF_LABEL, "lang", "literal", None),
            (SPINE, "node", O + "partOf", "repo", "iri", None),
            (SPINE, "repo", G.RDF_TYPE, o("Repo"), "iri", None),
            (SPINE, "repo", G.TITLE, "source", "literal", None),
            (SPINE, "repo", O + "sourceId", "source", "literal", None),
            (SPINE, "doc", G.RDF_TYPE, o("Doc"), "iri", None),
            (SPINE, "doc", O + "path", f"'docs/' || {s('id')} || '.md'", "literal", None),
            (RUN, "node", G.DERIVED, "CASE WHEN quality IS NOT NULL THEN doc END", "iri", None),
            (SPINE, "doc", G.DERIVED, f"CASE WHEN id >= 2 THEN '{R}doc/corpus/' || {s('CAST(floor(id / 2.0) AS BIGINT)')} END", "iri", None),
            (RUN, "node", G.GENERATED, "CASE WHEN quality IS NOT NULL AND id % 17 <> 0 THEN run END", "iri", None),
            (RUN, "run", O + "pipelineVer", "'0.1.0'", "literal", None),
            (RUN, "run", O + "model", "'deterministic'", "literal", None),
        ],
    ),
    "events": (
        f"""SELECT event_id, event_type, slug, branch, date, is_commit, is_pull, '{R}repo/' || slug AS repo, CASE WHEN is_commit THEN '{R}commit/' WHEN is_pull THEN '{R}pr/' END || slug || '/' || {s('event_id')} AS node
        FROM (SELECT event_id, event_type, 'user' || {s('user_id % 50')} AS slug, CASE WHEN user_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch,
            replace(substr({s('ts')}, 1, 19), ' ', 'T') || 'Z' AS date, event_type IN ('view', 'click') AS is_commit, event_type IN ('purchase', 'signup') AS is_pull FROM {{events}}) x WHERE is_commit OR is_pull""",
        [
            (SPINE, "repo", G.RDF_TYPE, o("Repo"), "iri", None),
            (SPINE, "repo", O + "sourceId", "slug", "literal", None),
            (SPINE, "repo", O + "historyBranch", "branch", "literal", None),
            (SPINE, "node", G.RDF_TYPE, f"CASE WHEN is_commit THEN {o('Commit')} ELSE {o('PullRequest')} END", "iri", None),
            (SPINE, "node", G.TITLE, f"event_type || ' ' || {s('event_id')}", "literal", None),
            (SPINE, "node", O + "partOf", "repo", "iri", None),
            (SPINE, "node", G.CREATED, "CASE WHEN is_commit THEN date END", "literal", DATETIME),
            (SPINE, "node", O + "sourceId", f"CASE WHEN is_commit THEN {s('event_id')} END", "literal", None),
            (SPINE, "node", O + "number", f"CASE WHEN is_pull THEN {s('event_id')} END", "literal", INTEGER),
            (SPINE, "node", O + "state", "CASE WHEN event_type = 'purchase' THEN 'merged' WHEN is_pull THEN 'open' END", "literal", None),
            (SPINE, "node", O + "mergedAt", "CASE WHEN event_type = 'purchase' THEN date END", "literal", DATETIME),
            (SPINE, "node", O + "baseRefName", "CASE WHEN is_pull THEN CASE WHEN event_id % 3 = 0 THEN 'main' ELSE 'dev' END END", "literal", None),
        ],
    ),
    "orders": (
        f"""SELECT k, o_orderstatus, o_orderpriority, c_mktsegment, '{R}issue/ORD-' || {s('k')} AS node, '{R}customer/' || {s('c_custkey')} AS customer, '{R}project/' || c_mktsegment AS project,
          '{R}issue/ORD-' || {s('k - k % 5')} AS parent FROM (SELECT o.o_orderkey AS k, o.o_orderstatus, o.o_orderpriority, c.c_custkey, c.c_mktsegment FROM {{orders}} o JOIN {{customer}} c ON o.o_custkey = c.c_custkey) x""",
        [
            (SPINE, "node", G.RDF_TYPE, o("Issue"), "iri", None),
            (SPINE, "node", O + "trackerKey", f"'ORD-' || {s('k')}", "literal", None),
            (SPINE, "node", O + "trackerTeam", "'T' || substr(o_orderpriority, 1, 1)", "literal", None),
            (SPINE, "node", G.TITLE, f"'order ' || {s('k')}", "literal", None),
            (SPINE, "node", O + "label", "o_orderpriority", "literal", None),
            (SPINE, "node", O + "label", "CASE WHEN o_orderstatus = 'F' THEN 'AI-Implement' END", "literal", None),
            (SPINE, "node", O + "status", "CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'in-progress' END", "literal", None),
            (SPINE, "node", O + "inProject", "project", "iri", None),
            (SPINE, "project", G.TITLE, "c_mktsegment", "literal", None),
            (SPINE, "project", G.RDF_TYPE, o("Project"), "iri", None),
            (SPINE, "node", O + "partOf", "CASE WHEN k % 5 <> 0 THEN parent END", "iri", None),
            (SPINE, "node", O + "dependsOn", f"CASE WHEN k % 7 = 0 THEN '{R}issue/ORD-' || {s('k + 1')} END", "iri", None),
            (SPINE, "node", G.ATTRIBUTED, "customer", "iri", None),
        ],
    ),
    "places": (
        f"""SELECT a, p, b FROM (
          SELECT '{R}customer/' || {s('c_custkey')} AS a, '{O}partOf' AS p, '{R}nation/' || {s('c_nationkey')} AS b FROM {{customer}}
          UNION ALL SELECT '{R}supplier/' || {s('s_suppkey')}, '{O}partOf', '{R}nation/' || {s('s_nationkey')} FROM {{supplier}}
          UNION ALL SELECT '{R}nation/' || {s('n_nationkey')}, '{O}partOf', '{R}region/' || {s('n_regionkey')} FROM {{nation}}) x""",
        [(SPINE, "a", O + "partOf", "b", "iri", None)],
    ),
}


#: (table whose rows a set has, key of its rows, subjects that the key names, columns without which these are null):
#: the other subjects are shared by many rows.
KEYS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "docs": ("documents", ("id",), ("node", "doc"), ("id",)),
    "events": ("events", ("event_id",), ("node",), ("event_id", "slug")),
    "orders": ("orders", ("k",), ("node",), ("k",)),
    "places": ("customer", ("a", "b"), ("a",), ("a",)),
}
#: Rows of a set in one task; the characters of a text that facts show.
ROWS_A_TASK, SHOWN = 200_000, 400


class _Names(dict):
    def __missing__(self, key: str) -> str:
        return key


TABLES = ("documents", "labels", "events", "orders", "customer", "supplier", "nation")


def used_tables(base: str) -> list[str]:
    return [t for t in TABLES if "{" + t + "}" in base]


def table_quads(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The named sets as quads; each set is one pass over its rows."""
    out = None
    for name in names:
        base, facts = SETS[name]
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used_tables(base)}
        text = lambda v: "cast(null as string)" if v is None else f"'{v}'"
        each = ", ".join(f"struct('{g}' as g, {sub} as s, '{p}' as p, {obj} as o, '{kind}' as o_kind, {text(dt)} as o_dt)" for g, sub, p, obj, kind, dt in facts)
        df = spark.sql(base, **used).selectExpr(f"inline(array({each}))").where("o is not null").selectExpr("g", "s", "p", "o", "o_kind", "o_dt", "cast(null as string) as o_lang")
        out = df if out is None else out.unionByName(df)
    return out.dropDuplicates()


def tasks_for(spark: SparkSession, rows: int) -> int:
    return 1 + max(rows // ROWS_A_TASK, min(rows // 10_000, spark.sparkContext.defaultParallelism))


def set_rows(spark: SparkSession, sf_dir: str, name: str, path: str) -> DataFrame:
    """The distinct rows that a set's facts are made of, stored at path, with _one: whether a row is the only one of its key, and names its subjects.

    They are far narrower than their facts. Tasks have a bounded number of rows, whatever the size of the tables.
    """
    base, table, key = SETS[name][0], KEYS[name][0], [F.col(c) for c in KEYS[name][1]]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used_tables(base)}
    if "documents" in used:  # facts show no more of a text, and the join needn't move it
        used["documents"] = used["documents"].withColumn("text", F.substring("text", 1, SHOWN))
    rows = spark.sql("SELECT * FROM (" + base.split("FROM (", 1)[1], **used)
    tasks = tasks_for(spark, used[table].count())
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in KEYS[name][3]])
    rows = rows.repartition(tasks, *key).distinct().withColumn("_one", known & (F.count("*").over(W.partitionBy(*key)) == 1))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def facts_of(rows: DataFrame, facts: list[tuple]) -> DataFrame:
    """The facts of rows; equal ones of one row are one."""
    text = lambda v: "cast(null as string)" if v is None else f"'{v}'"
    each = [f"'{g}' as g, {sub} as s, {obj} as o, '{kind}' as o_kind, {text(dt)} as o_dt" for g, sub, _, obj, kind, dt in facts]
    if len(each) == 1:
        return rows.where(f"({facts[0][3]}) is not null").select(F.expr(f"struct({each[0]})").alias("x")).select("x.*")
    return rows.selectExpr(f"inline(array_distinct(array({', '.join(f'struct({e})' for e in each)})))").where("o is not null")


def write_graph(spark: SparkSession, sf_dir: str, names: tuple[str, ...], path: str) -> None:
    """The distinct quads of the sets by predicate, each predicate written as it is made.

    The facts of a key with one row are distinct as they are, and are neither moved nor sorted. Those of shared subjects
    and of keys with several rows, or with none, are made distinct.
    """
    folder = fresh_dir(spark, "rows")
    stored = {n: set_rows(spark, sf_dir, n, f"{folder}/{n}") for n in dict.fromkeys(names)}
    view = {n: spark.sql(SETS[n][0].split("FROM (", 1)[0].replace("SELECT ", "SELECT _one, ", 1) + "FROM {rows}", rows=df) for n, df in stored.items()}
    several = {n for n, df in stored.items() if not df.where("not _one").isEmpty()}
    alone: dict[str, list[DataFrame]] = {}
    others: dict[str, list[DataFrame]] = {}
    for n, df in view.items():
        facts = SETS[n][1]
        for p in dict.fromkeys(f[2] for f in facts):
            own = [f for f in facts if f[2] == p and f[1] in KEYS[n][2]]
            shared = [f for f in facts if f[2] == p and f[1] not in KEYS[n][2]]
            if own:
                alone.setdefault(p, []).append(facts_of(df.where("_one"), own))
            if own and n in several:
                others.setdefault(p, []).append(facts_of(df.where("not _one"), own))
            if shared:
                others.setdefault(p, []).append(facts_of(df, shared))

    def write(p: str) -> None:
        frames = alone.get(p, []) + ([reduce(DataFrame.unionByName, others[p]).distinct()] if p in others else [])
        value = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(p)
        reduce(DataFrame.unionByName, frames).withColumn("o_lang", F.lit(None).cast("string")).write.option("compression", "zstd").parquet(f"{path}/p={value}")

    with ThreadPoolExecutor(4) as pool:  # the last tasks of a predicate run beside the next
        list(pool.map(write, dict.fromkeys([*alone, *others])))
    delete(spark, folder)


#: Where the graphs of this process are stored, by session, tables and their state.
_stored: dict[tuple, str] = {}


def table_graph(spark: SparkSession, sf_dir: str, *names: str) -> Graph:
    """The sets as a graph, built once for each state of their tables, and read from there.

    Quads lie by predicate, so a query reads the predicates that it names. No fact is in two graphs, so
    the graph's triples are distinct as they are.
    """
    tables = sorted({t for n in names for t in used_tables(SETS[n][0])})
    key = (spark.sparkContext.applicationId, sf_dir, tuple(sorted(names)), tuple(state_of(spark, f"{sf_dir}/{t}.parquet") for t in tables))
    path = _stored.get(key)
    if path is None or state_of(spark, path) is None:
        path = fresh_dir(spark, "graph")
        write_graph(spark, sf_dir, names, path)
        _stored[key] = path
    tasks = tasks_for(spark, max(spark.read.parquet(f"{sf_dir}/{KEYS[n][0]}.parquet").count() for n in names))
    return Graph(spark.read.schema(QUAD).parquet(path).select("g", *TERM), GraphConfig(), distinct=True, tasks=tasks)


def quads_sql(*names: str) -> str:
    """The same as a DuckDB common table expression `quads`, after `WITH`."""
    parts, out = [], []
    for name in names:
        base, facts = SETS[name]
        parts.append(f"base_{name} AS ({base.format_map(_Names())})")
        text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else f"'{v}'"
        out += [f"SELECT '{g}' AS g, {sub} AS s, '{p}' AS p, {obj} AS o, '{kind}' AS o_kind, {text(dt)} AS o_dt FROM base_{name}" for g, sub, p, obj, kind, dt in facts]
    return ", ".join(parts) + ", quads AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join(out) + ") WHERE o IS NOT NULL)"


__all__ = ["QUAD", "SETS", "quads_sql", "table_graph", "table_quads"]
