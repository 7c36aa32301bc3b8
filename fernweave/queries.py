"""The registered queries of the graph engine over the test tables, each beside its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as K
from .config import GraphConfig
from .functions import text as X
from .functions.iri import Iris, local_name, page_hash, part_of, run_id, seg
from .functions.markup import html_pages, markdown_pages
from .operators import aggregates as A
from .operators.aggregates import at_least_as_high as aggregates_rank
from .operators import explore as E
from .operators import guard, incremental, search, snapshot, validate
from .operators.cards import build_cards
from .operators.embed import HashingEmbedder, embed_cards
from .plans import graph as G
from .plans.construct import Construct, anchored_rows
from .plans.tables import O, R, quads_sql, table_graph
from .sources import git, site, tracker

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CFG = GraphConfig()


def query(name: str, sql: str | None = None, sets: tuple[str, ...] = ()):
    """Registers a query; sql may use `quads` (the sets) and the common views below."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {quads_sql(*sets)}, {VIEWS}, {sql.strip()}" if sets else sql
        return f

    return put


VIEWS = f"""
triples AS (SELECT DISTINCT s, p, o, o_kind, o_dt FROM quads),
types AS (SELECT DISTINCT s, o AS type FROM quads WHERE p = '{G.RDF_TYPE}'),
titles AS (SELECT DISTINCT s, o AS title FROM quads WHERE p = '{G.TITLE}'),
tags AS (SELECT DISTINCT a.s, a.o AS topic, b.o AS label FROM quads a JOIN quads b ON b.s = a.o AND b.p = '{G.PREF_LABEL}' WHERE a.p = '{O}tagged')"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- keyword search -------------------------------------------------------
def lexical_ctes(term: str, limit: int | None, name: str = "lex", cap: bool = True) -> str:
    own = "', '".join(O + t for t in search.SEMANTIC)
    return f"""
{name}_m AS (
  SELECT DISTINCT t.s AS iri, t.type, i.title, CASE WHEN contains(lower(g.label), '{term}') THEN g.label WHEN contains(lower(i.title), '{term}') THEN '{search.TITLE_MATCH}' END AS matched
  FROM types t JOIN titles i ON i.s = t.s LEFT JOIN tags g ON g.s = t.s WHERE t.type IN ('{own}')
  UNION SELECT t.s, t.type, i.title, '{search.TITLE_MATCH}' FROM types t JOIN titles i ON i.s = t.s WHERE t.type IN ('{O}PullRequest', '{O}Repo') AND contains(lower(i.title), '{term}')),
{name}_r AS (
  SELECT DISTINCT m.iri, m.type, m.title, c.o AS category, p.o AS priority, f.o AS fix, m.matched FROM {name}_m m
  LEFT JOIN quads c ON c.s = m.iri AND c.p = '{O}category' LEFT JOIN quads p ON p.s = m.iri AND p.p = '{O}priority' LEFT JOIN quads f ON f.s = m.iri AND f.p = '{O}fix'
  WHERE m.matched IS NOT NULL ORDER BY 1, 2, 3, 4 NULLS FIRST, 5 NULLS FIRST, 6 NULLS FIRST, 7 {f"LIMIT {6 * limit}" if cap and limit else ""}),
{name} AS (
  SELECT iri, regexp_extract(min(type), '[^#/]*$', 0) AS type, min(title) AS title, min(category) AS category, min(priority) AS priority, nullif(substr(min(fix), 1, 400), '') AS fix, string_agg(DISTINCT matched, ',' ORDER BY matched) AS matched_topics
  FROM {name}_r GROUP BY iri ORDER BY iri {f'LIMIT {limit}' if limit else ''})"""


def search_query(name: str, term: str, limit: int | None, cap: bool = True) -> None:
    @query(name, lexical_ctes(term, limit, cap=cap) + " SELECT * FROM lex", ("docs",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return search.lexical(table_graph(spark, sf_dir, "docs"), term, limit, cap).withColumn("matched_topics", F.array_join("matched_topics", ","))


search_query("r1_lexical_search", "de", 10)
search_query("r1_title_only", "eriner", 10)
search_query("r1_tag_match", "en", 50)
search_query("r1_every_match", "de", None, cap=False)
search_query("r1_exact_key", "doc-98", 10)


# --- vectors and fusion ---------------------------------------------------
def vectors_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, by their documents' nodes."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    kind = F.when(F.col("quality") == 1, R + "learning/corpus/solutions/").when(F.col("quality") == 0, R + "decision/corpus/adr/").otherwise(R + "doc/corpus/")
    return v.join(read(spark, sf_dir, "labels"), "doc_id", "left").select(F.concat(kind, F.col("doc_id").cast("string")).alias("iri"), "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id; without vectors one of zeros."""
    row = read(spark, sf_dir, "embeddings").orderBy("vec_id").first()
    return list(row["embedding"]) if row else [0.0]


def cards_of(graph: G.Graph) -> Callable[[DataFrame], DataFrame]:
    return lambda nodes: build_cards(graph, nodes)


VECTOR_CTES = f"""
q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1),
vec AS (SELECT CASE l.quality WHEN 1 THEN '{R}learning/corpus/solutions/' WHEN 0 THEN '{R}decision/corpus/adr/' ELSE '{R}doc/corpus/' END || CAST(e.vec_id AS VARCHAR) AS iri, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id),
scored AS (SELECT iri, list_inner_product(v, q) / (sqrt(list_inner_product(q, q)) + 1e-12) AS score FROM vec, q)"""


def card_ctes() -> str:
    return f"""cards AS (SELECT t.s AS iri, regexp_extract(t.type, '[^#/]*$', 0) AS type, i.title, coalesce(substr(x.o, 1, 400), '') AS snippet FROM types t JOIN titles i ON i.s = t.s LEFT JOIN quads x ON x.s = t.s AND x.p = CASE t.type WHEN '{O}Learning' THEN '{O}fix' ELSE '{O}detail' END WHERE t.type IN ('{O}Learning', '{O}Decision', '{O}Doc'))"""


@query("r2_vector_topk", VECTOR_CTES + " SELECT iri, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, iri LIMIT 10", ("docs",))
def _(spark, sf_dir):
    return search.vector_topk(vectors_of(spark, sf_dir), query_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("r5_semantic_grouped", VECTOR_CTES + ", " + card_ctes() + " SELECT scored.iri, round(score, 6) AS score, c.type, c.title, c.snippet FROM scored LEFT JOIN cards c ON c.iri = scored.iri ORDER BY scored.score DESC, scored.iri LIMIT 10", ("docs",))
def _(spark, sf_dir):
    return search.vector_grouped(vectors_of(spark, sf_dir), cards_of(table_graph(spark, sf_dir, "docs")), query_vector(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


def hybrid_sql(term: str, limit: int, boost: str | None, semantic: bool = True) -> str:
    b = f"CASE WHEN regexp_matches(upper(iri || ' ' || title), '\\b(?:{boost})\\b') THEN 1.0 ELSE 0.0 END" if boost else "0.0"
    sem = f"""
sem AS (SELECT s.iri, c.type, c.title, c.snippet, row_number() OVER (ORDER BY s.score DESC, s.iri) - 1 AS rank0 FROM (SELECT * FROM scored ORDER BY score DESC, iri LIMIT {limit}) s LEFT JOIN cards c ON c.iri = s.iri),""" if semantic else ""
    more = "UNION ALL SELECT iri, type, title, snippet, rank0, 'semantic' AS leg, 0 AS pri FROM sem" if semantic else ""
    return f"""{VECTOR_CTES}, {card_ctes()}, {lexical_ctes(term, limit)}, {sem}
legs AS (SELECT iri, type, title, fix AS snippet, row_number() OVER (ORDER BY iri) - 1 AS rank0, 'lexical' AS leg, 1 AS pri FROM lex {more}),
f AS (SELECT iri, arg_min(type, pri) FILTER (type <> '') AS type, coalesce(arg_min(title, pri) FILTER (title <> ''), '') AS title, coalesce(arg_min(snippet, pri) FILTER (snippet <> ''), '') AS snippet, sum(1.0::DOUBLE / (61 + rank0)) AS rrf, string_agg(DISTINCT leg, ',' ORDER BY leg) AS matched_by FROM legs GROUP BY iri)
SELECT iri, type, title, snippet, matched_by, round(rrf + {b}, 6) AS score, {str(not semantic).lower()} AS degraded FROM f ORDER BY rrf + {b} DESC, iri LIMIT {limit}"""


def hybrid_query(name: str, text: str, boost: str | None, semantic: bool = True) -> None:
    @query(name, hybrid_sql(search.term_of(text), 10, boost, semantic), ("docs",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = table_graph(spark, sf_dir, "docs")
        more = {"vectors": vectors_of(spark, sf_dir), "cards": cards_of(g), "embedding": query_vector(spark, sf_dir)} if semantic else {}
        return search.hybrid(g, text, 10, **more).withColumn("score", F.round("score", 6)).withColumn("matched_by", F.array_join("matched_by", ","))


hybrid_query("r3_hybrid_rrf", "de", None)
hybrid_query("r3_exact_id_boost", "DOC-98", "DOC\\-98")
hybrid_query("r3_degraded", "de", None, semantic=False)


@query(
    "r6_hybrid_tied_ranks",
    VECTOR_CTES + ", " + lexical_ctes("de", 10) + """,
top AS (SELECT iri, round(score, 2) AS score FROM scored ORDER BY 2 DESC, iri LIMIT 10),
legs AS (SELECT a.iri, 'semantic' AS leg, 1.0::DOUBLE / (60 + count(*)) AS c FROM top a JOIN top b ON b.score >= a.score GROUP BY a.iri UNION ALL SELECT a.iri, 'lexical', 1.0::DOUBLE / (60 + count(*)) FROM lex a JOIN lex b ON b.iri <= a.iri GROUP BY a.iri)
SELECT iri, coalesce(min(title), '') AS title, string_agg(DISTINCT leg, ',' ORDER BY leg) AS matched, round(sum(c), 6) AS score FROM legs LEFT JOIN titles ON titles.s = legs.iri GROUP BY iri ORDER BY sum(c) DESC, iri LIMIT 10""",
    ("docs",),
)
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    v = vectors_of(spark, sf_dir).select("iri", F.round(search.dot(F.col("embedding"), F.array(*map(F.lit, search.normalised(query_vector(spark, sf_dir))))), 2).alias("score"))
    sem = v.orderBy(F.desc("score"), "iri").limit(10).join(g.values(G.TITLE, "title").withColumnRenamed("s", "iri"), "iri", "left")
    return search.hybrid_tied(search.lexical(g, "de", 10).select("iri", "title"), sem, "de", 10).withColumn("score", F.round("score", 6)).withColumn("title", F.coalesce("title", F.lit("")))


PREFLIGHT = ("de", "eriner", "en")


@query(
    "r11_preflight",
    ", ".join(lexical_ctes(t, 5, f"lex{i}") for i, t in enumerate(PREFLIGHT)) + ", u AS (" + " UNION ALL ".join(f"SELECT iri, title, type, priority, {i} AS t FROM lex{i}" for i in range(3)) + ") SELECT iri, min(title) AS title, min(type) AS type, min(priority) AS priority, count(DISTINCT t) AS n_terms FROM u GROUP BY iri ORDER BY n_terms DESC, coalesce(min(priority), 'P9'), iri LIMIT 5",
    ("docs",),
)
def _(spark, sf_dir):
    return search.preflight(table_graph(spark, sf_dir, "docs"), PREFLIGHT)


@query(
    "r11_benchmark_terms",
    f"""b AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark),
w AS (SELECT DISTINCT i.s, unnest(regexp_extract_all(lower(i.title), '[a-z]+')) AS term FROM titles i JOIN types t ON t.s = i.s AND t.type IN ('{O}Learning', '{O}Decision'))
SELECT term, count(*) AS n FROM w JOIN b USING (term) GROUP BY term""",
    ("docs",),
)
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))).alias("term")
    titles = g.instances("Learning", "Decision").select("s").distinct().join(g.values(G.TITLE, "title"), "s").select("s", words("title")).distinct()
    n = titles.groupBy("term").agg(F.count("*").alias("n"))  # summed before the join: a frequent word is one row
    return n.join(read(spark, sf_dir, "benchmark").select(words("text")).distinct(), "term", "left_semi")


# --- exploration ----------------------------------------------------------
NODE = R + "learning/corpus/solutions/1"
HUB = R + "topic/en"


def neighbor_sql(node: str, limit: int) -> str:
    return f"""e AS (SELECT 'out' AS direction, p, o AS x FROM triples WHERE s = '{node}' UNION ALL SELECT 'in', p, s FROM triples WHERE o = '{node}' AND o_kind = 'iri'),
l AS (SELECT s, coalesce(min(o) FILTER (p = '{G.TITLE}'), min(o) FILTER (p = '{G.PREF_LABEL}'), min(o) FILTER (p = '{O}path')) AS label FROM triples GROUP BY s)
SELECT direction, regexp_extract(p, '[^#/]*$', 0) AS predicate, p AS predicate_iri, x AS neighbor, label FROM e LEFT JOIN l ON l.s = e.x ORDER BY direction, p, x LIMIT {limit}"""


@query("r7_neighbors", neighbor_sql(NODE, 30), ("docs",))
def _(spark, sf_dir):
    return E.neighbors(table_graph(spark, sf_dir, "docs"), NODE)


@query("r7_neighbors_hub", neighbor_sql(HUB, 200), ("docs",))
def _(spark, sf_dir):
    return E.neighbors(table_graph(spark, sf_dir, "docs"), HUB, 200)


@query(
    "r8_provenance",
    f"""n AS (SELECT DISTINCT s AS iri FROM types WHERE type IN ('{O}Learning', '{O}Decision')),
t AS (SELECT s, string_agg(DISTINCT regexp_extract(type, '[^#]*$', 0), ',' ORDER BY regexp_extract(type, '[^#]*$', 0)) AS types FROM types GROUP BY s),
d AS (SELECT q.s, string_agg(DISTINCT q.o || '=' || coalesce(p.o, ''), ',' ORDER BY q.o || '=' || coalesce(p.o, '')) AS derived FROM quads q LEFT JOIN quads p ON p.s = q.o AND p.p = '{O}path' WHERE q.p = '{G.DERIVED}' GROUP BY q.s),
r AS (SELECT s, max(o) AS run FROM quads WHERE p = '{G.GENERATED}' GROUP BY s), v AS (SELECT s, max(o) FILTER (p = '{O}pipelineVer') AS pipeline_ver, max(o) FILTER (p = '{O}model') AS model, max(o) FILTER (p = '{O}promptHash') AS prompt_hash FROM quads GROUP BY s)
SELECT n.iri, i.title, t.types, d.derived, r.run, CASE WHEN r.run IS NOT NULL THEN v.pipeline_ver END AS pipeline_ver, v.model, v.prompt_hash FROM n LEFT JOIN titles i ON i.s = n.iri LEFT JOIN t ON t.s = n.iri LEFT JOIN d ON d.s = n.iri LEFT JOIN r ON r.s = n.iri LEFT JOIN v ON v.s = r.run""",
    ("docs",),
)
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    out = E.provenance(g, g.instances("Learning", "Decision").select(F.col("s").alias("iri")))
    derived = F.array_join(F.array_sort(F.transform("derived_from", lambda d: F.concat(d["iri"], F.lit("="), F.coalesce(d["path"], F.lit(""))))), ",")
    return out.select("iri", "title", F.array_join("types", ",").alias("types"), derived.alias("derived"), "run", "pipeline_ver", "model", "prompt_hash")


def history_ctes(slug: str, branch: str | None, since: str | None, until: str | None, kind: str | None, limit: int) -> str:
    val = lambda p, name: f"LEFT JOIN (SELECT s, o AS {name} FROM quads WHERE p = '{p}') x_{name} ON x_{name}.s = n.s"
    bound = lambda: (f" AND date >= '{since}'" if since else "") + (f" AND date <= '{until}'" if until else "")
    repo = f"(SELECT DISTINCT s FROM quads WHERE p = '{O}sourceId' AND o = '{slug}')"
    at_branch = f" AND r.s IN (SELECT s FROM quads WHERE p = '{O}historyBranch' AND o = '{branch}')" if branch else ""
    own = f"JOIN (SELECT DISTINCT s, o AS repo FROM quads WHERE p = '{O}partOf') w ON w.s = n.s JOIN {repo} r ON r.s = w.repo"
    legs = []
    if kind in (None, "commit"):
        legs.append(f"(SELECT 'Commit' AS type, n.s AS iri, title, sha, NULL::BIGINT AS number, NULL::VARCHAR AS state, NULL::VARCHAR AS base_ref, date FROM types n {own} {val(G.TITLE, 'title')} {val(O + 'sourceId', 'sha')} {val(G.CREATED, 'date')} WHERE n.type = '{O}Commit' AND date IS NOT NULL{at_branch}{bound()} ORDER BY date DESC, iri LIMIT {limit})")
    if kind in (None, "pr"):
        base = f" AND base_ref = '{branch}'" if branch else ""
        legs.append(f"(SELECT 'PullRequest' AS type, n.s AS iri, title, NULL::VARCHAR AS sha, CAST(num AS BIGINT) AS number, state, base_ref, date FROM types n {own} {val(G.TITLE, 'title')} {val(O + 'number', 'num')} {val(O + 'state', 'state')} {val(O + 'mergedAt', 'date')} {val(O + 'baseRefName', 'base_ref')} WHERE n.type = '{O}PullRequest'{base}{bound()} ORDER BY number DESC, iri LIMIT {limit})")
    return f"h AS ({' UNION ALL '.join(legs)}) SELECT * FROM h ORDER BY date DESC NULLS LAST, iri LIMIT {limit}"


def history_query(name: str, **kw) -> None:
    args = {"branch": None, "since": None, "until": None, "kind": None, "limit": 40} | kw
    full = {k: E.as_datetime(v) if k in ("since", "until") and v else v for k, v in args.items()}

    @query(name, history_ctes("user8", **full), ("events",))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.history(table_graph(spark, sf_dir, "events"), "user8", **args)


history_query("r10_history_commits", kind="commit", branch="main")
history_query("r10_history_prs", kind="pr", branch="dev", limit=100)
history_query("r10_history_merged", since="2024-01-03")
history_query("r10_history_range", since="2024-01-02", until="2024-01-20T12:00:00Z", limit=500)

START = R + "region/1"


def walk_ctes(start: str, most: int) -> str:
    return f"""e AS MATERIALIZED (SELECT DISTINCT s AS a, o AS b FROM quads WHERE o_kind = 'iri' UNION SELECT o, s FROM quads WHERE o_kind = 'iri'),
w(node, hops) AS (SELECT '{start}', 0 UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < {most}),
best AS (SELECT node, min(hops) AS hops FROM w GROUP BY node)"""


@query("g2_bfs_reached", walk_ctes(START, 3) + " SELECT node, CAST(hops AS INT) AS hops FROM best", ("places",))
def _(spark, sf_dir):
    return E.reached(table_graph(spark, sf_dir, "places").edges, START, 3).select("node", "hops")


@query("g3_shortest_path", walk_ctes(R + "nation/1", 4) + f" SELECT CAST(hops AS INT) AS length FROM best WHERE node = '{R}nation/6' AND hops > 0", ("places",))
def _(spark, sf_dir):
    return E.path(table_graph(spark, sf_dir, "places"), R + "nation/1", R + "nation/6", 4).agg(F.max("step").alias("length")).where("length is not null")


@query(
    "g4_closure",
    f"""e AS (SELECT DISTINCT s, o FROM quads WHERE p = '{G.DERIVED}'), l AS (SELECT DISTINCT s FROM types WHERE type = '{O}Learning'),
c(s, o) AS (SELECT e.s, e.o FROM e JOIN l ON l.s = e.s UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.o)
SELECT s AS src, count(*) AS n FROM c GROUP BY s""",
    ("docs",),
)
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    return E.closure(g.edges, G.DERIVED, g.instances("Learning").select(F.col("s").alias("src"))).groupBy("src").agg(F.count("*").alias("n"))


@query("g1_one_hop", f"SELECT DISTINCT 'out' AS direction, o AS neighbor FROM quads WHERE s = '{NODE}' AND o_kind = 'iri' UNION SELECT 'in', s FROM quads WHERE o = '{NODE}' AND o_kind = 'iri'".join(["x AS (", ") SELECT * FROM x"]), ("docs",))
def _(spark, sf_dir):
    e = table_graph(spark, sf_dir, "docs").edges
    return e.where(F.col("src") == NODE).select(F.lit("out").alias("direction"), F.col("dst").alias("neighbor")).unionByName(e.where(F.col("dst") == NODE).select(F.lit("in").alias("direction"), F.col("src").alias("neighbor"))).distinct()


@query(
    "g5_relations",
    f"""WITH r AS (SELECT 'PRT-' || p_partkey AS k, 'PRT-' || (p_partkey + 1) AS other, CASE p_size % 4 WHEN 0 THEN 'Blocks' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'related' END AS t FROM part)
SELECT DISTINCT '{R}issue/' || CASE WHEN lower(t) = 'blocks' THEN other ELSE k END AS s, '{O}' || CASE lower(t) WHEN 'blocks' THEN 'dependsOn' WHEN 'duplicate' THEN 'duplicateOf' ELSE 'relatedTo' END AS p, '{R}issue/' || CASE WHEN lower(t) = 'blocks' THEN k ELSE other END AS o FROM r
UNION SELECT '{R}issue/' || other, '{G.RDF_TYPE}', '{O}Issue' FROM r""",
)
def _(spark, sf_dir):
    kind = F.when(F.col("p_size") % 4 == 0, "Blocks").when(F.col("p_size") % 4 == 1, "duplicate").when(F.col("p_size") % 4 == 2, "related")
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("PRT-"), "p_partkey").alias("identifier"), kind.alias("type"), F.concat(F.lit("PRT-"), F.col("p_partkey") + 1).alias("other"))
    return Construct(CFG).relations(rows).select("s", "p", "o")


@query(
    "g6_tracker_links",
    f"""WITH t AS (SELECT event_id, event_type || ' fixes abc-' || (event_id % 9) || ' and XY1-' || (event_id % 5) || ', not A-1' AS text FROM events),
k AS (SELECT event_id, upper(unnest(regexp_extract_all(text, '(?i)\\b[A-Z][A-Z0-9]{{1,9}}-\\d+\\b'))) AS key FROM t)
SELECT DISTINCT '{R}commit/e/' || event_id AS s, '{O}references' AS p, '{R}issue/' || key AS o FROM k UNION SELECT '{R}issue/' || key, '{O}addressedBy', '{R}commit/e/' || event_id FROM k
UNION SELECT '{R}issue/' || key, '{G.RDF_TYPE}', '{O}Issue' FROM k UNION SELECT '{R}issue/' || key, '{O}trackerKey', key FROM k""",
)
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    text = F.concat("event_type", F.lit(" fixes abc-"), F.col("event_id") % 9, F.lit(" and XY1-"), F.col("event_id") % 5, F.lit(", not A-1"))
    return Construct(CFG).links(e.select(F.concat(F.lit(R + "commit/e/"), "event_id").alias("node"), text.alias("text"))).select("s", "p", "o")


@query("g7_merge_semi", f"""WITH c AS (SELECT event_id FROM events WHERE event_type IN ('view', 'click'))
SELECT '{R}pr/corpus/' || event_id AS s, '{R}commit/corpus/' || (event_id + 1) AS o FROM events WHERE event_type = 'purchase' AND event_id + 1 IN (SELECT event_id FROM c)""")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    pulls = e.where("event_type = 'purchase'").select(F.lit("corpus").alias("slug"), F.col("event_id").alias("number"), F.lit("t").alias("title"), F.lit(None).cast("string").alias("body"), F.lit("closed").alias("state"), F.lit("2024-01-01T00:00:00Z").alias("merged_at"), (F.col("event_id") + 1).cast("string").alias("merge_commit_sha"), F.struct(F.lit("main").alias("ref")).alias("base"), F.struct(F.lit("ann").alias("login")).alias("user"))
    commits = e.where("event_type in ('view', 'click')").select(F.lit("corpus").alias("slug"), F.col("event_id").cast("string").alias("sha"))
    return Construct(CFG).pulls(pulls, commits).where(F.col("p") == O + "mergeCommit").select("s", "o")


@query(
    "g8_related_solutions",
    f"""WITH d AS (SELECT doc_id, 'docs/solutions/' || source || '/' || (doc_id % 100) || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN 'docs/solutions/' || source || '/' || ((doc_id + 20) % 100) || '.md' ELSE (doc_id % 90) || '.md' END AS want FROM documents),
h AS (SELECT path, regexp_extract(path, '[^/]*$', 0) AS base FROM d), b AS (SELECT base, min(path) AS path FROM h GROUP BY base)
SELECT DISTINCT '{R}learning/corpus/solutions/' || doc_id AS s, url_encode(coalesce(h.path, b.path)) AS o FROM d LEFT JOIN (SELECT DISTINCT path FROM h) h ON h.path = d.want LEFT JOIN b ON b.base = regexp_extract(d.want, '[^/]*$', 0) WHERE coalesce(h.path, b.path) IS NOT NULL""",
)
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = lambda n: F.concat(F.lit("docs/solutions/"), "source", F.lit("/"), n % 100, F.lit(".md"))
    want = F.when(F.col("doc_id") % 2 == 0, path(F.col("doc_id") + 20)).otherwise(F.concat(F.col("doc_id") % 90, F.lit(".md")))
    rows = d.select(F.lit("corpus").alias("slug"), path(F.col("doc_id")).alias("path"), F.col("doc_id").cast("string").alias("lid"), F.create_map(F.lit("related_solutions"), F.array(want)).alias("meta"))
    node = Iris(CFG).learning(F.col("slug"), F.lit("solutions"), F.col("lid"))
    return Construct(CFG).related(rows, F.lit(CFG.spine), node).select("s", F.substring_index("o", "/", -1).alias("o")).distinct()


# --- aggregates -----------------------------------------------------------
@query("a1_graph_sizes", "x AS (SELECT g, count(*) AS n FROM quads GROUP BY g) SELECT * FROM x", ("docs", "events"))
def _(spark, sf_dir):
    return A.graph_sizes(table_graph(spark, sf_dir, "docs", "events"))


@query("a2_nodes_by_type", "x AS (SELECT regexp_extract(type, '[^#/]*$', 0) AS type, count(DISTINCT s) AS n FROM types GROUP BY type) SELECT * FROM x", ("docs", "events", "orders"))
def _(spark, sf_dir):
    return A.nodes_by_type(table_graph(spark, sf_dir, "docs", "events", "orders"))


@query("a3_by_team", f"x AS (SELECT o AS team, count(DISTINCT s) AS n FROM quads WHERE p = '{O}trackerTeam' GROUP BY o) SELECT * FROM x", ("orders",))
def _(spark, sf_dir):
    return A.issues_by_team(table_graph(spark, sf_dir, "orders"))


@query("a4_edge_counts_zero", f"w(predicate) AS (VALUES ('partOf'), ('dependsOn'), ('duplicateOf'), ('relatedTo'), ('inProject')) SELECT predicate, count(t.s) AS n FROM w LEFT JOIN triples t ON t.p = '{O}' || predicate GROUP BY predicate", ("orders",))
def _(spark, sf_dir):
    return A.edge_counts(table_graph(spark, sf_dir, "orders"))


@query("a5_learnings", f"x AS (SELECT title FROM titles JOIN types USING (s) WHERE type = '{O}Learning') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return A.learnings(table_graph(spark, sf_dir, "docs"))


@query("a6_topics", f"u AS (SELECT topic, count(DISTINCT tags.s) AS n FROM tags JOIN types ON types.s = tags.s AND type = '{O}Learning' GROUP BY topic) SELECT DISTINCT label, coalesce(n, 0) AS n FROM tags LEFT JOIN u USING (topic)", ("docs",))
def _(spark, sf_dir):
    return A.topics(table_graph(spark, sf_dir, "docs"))


@query(
    "a7_inventory",
    f"""v AS (SELECT s, min(o) FILTER (p = '{O}trackerKey') AS key, min(o) FILTER (p = '{O}trackerTeam') AS team, min(o) FILTER (p = '{O}status') AS status, string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (p = '{O}label') AS labels FROM quads GROUP BY s),
p AS (SELECT q.s, min(t.title) AS project FROM quads q JOIN titles t ON t.s = q.o WHERE q.p = '{O}inProject' GROUP BY q.s), r AS (SELECT q.s, min(k.o) AS parent FROM quads q JOIN quads k ON k.s = q.o AND k.p = '{O}trackerKey' WHERE q.p = '{O}partOf' GROUP BY q.s)
SELECT key, coalesce(team, '-') AS team, coalesce(status, '-') AS status, coalesce(project, '-') AS project, coalesce(labels, '-') AS labels, coalesce(parent, '-') AS parent, '-' AS learned FROM types JOIN v USING (s) LEFT JOIN p USING (s) LEFT JOIN r USING (s) WHERE type = '{O}Issue' AND key IS NOT NULL""",
    ("orders",),
)
def _(spark, sf_dir):
    return A.issue_inventory(table_graph(spark, sf_dir, "orders"))


@query("a8_quad_count", "x AS (SELECT (SELECT count(*) FROM quads) AS quads, (SELECT count(*) FROM triples) AS triples) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return A.quad_count(table_graph(spark, sf_dir, "docs"))


@query("a9_part_counts", """WITH f AS (SELECT 'part' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '.0' || (doc_id % 3) ELSE '' END || '.nt' AS name, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE source END AS line FROM documents)
SELECT regexp_replace(name, '^(.+)\\.\\d+\\.nt$', '\\1.nt') AS part, count(*) AS n FROM f WHERE trim(line) <> '' GROUP BY 1""")
def _(spark, sf_dir):
    name = F.concat(F.lit("part"), F.col("doc_id") % 7, F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(".0"), F.col("doc_id") % 3)).otherwise(""), F.lit(".nt"))
    return A.part_counts(read(spark, sf_dir, "documents").select(name.alias("name"), F.when(F.col("doc_id") % 11 == 0, "  ").otherwise(F.col("source")).alias("line")))


@query("a10_fold", "SELECT source AS iri, min(CASE WHEN doc_id % 5 <> 0 THEN lang || doc_id END) AS title, string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (lang <> 'en') AS tags, min(text) FILTER (text <> '') AS extra FROM documents GROUP BY source")
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("iri"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat("lang", "doc_id")).alias("title"), F.col("lang").alias("tag"), F.col("text").alias("extra"), F.lit("").alias("key"))
    return A.folded(rows, ("en",)).select("iri", "title", F.nullif(F.array_join("tags", ","), F.lit("")).alias("tags"), "extra")


OFFSET = "CASE event_id % 3 WHEN 0 THEN '+00:00' WHEN 1 THEN '+05:00' ELSE '-08:00' END"


@query("a11_first_last", f"""WITH c AS (SELECT replace(substr(CAST(ts AS VARCHAR), 1, 19), ' ', 'T') || {OFFSET} AS date, ts - to_hours(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 5 ELSE -8 END) AS t FROM events)
SELECT (SELECT date FROM c ORDER BY date_trunc('second', t), date LIMIT 1) AS first_commit, (SELECT date FROM c ORDER BY date_trunc('second', t) DESC, date DESC LIMIT 1) AS last_commit""")
def _(spark, sf_dir):
    return A.first_last(read(spark, sf_dir, "events").select(F.expr(f"replace(substr(cast(ts as string), 1, 19), ' ', 'T') || {OFFSET} as date")))


@query("a12_ingest_stats", f"x AS (SELECT g, regexp_extract(o, '[^#/]*$', 0) AS type, count(DISTINCT s) AS n FROM quads WHERE p = '{G.RDF_TYPE}' GROUP BY ALL) SELECT * FROM x", ("docs", "events"))
def _(spark, sf_dir):
    return A.ingest_stats(table_graph(spark, sf_dir, "docs", "events").quads, O)


@query("a13_topic_count", f"x AS (SELECT count(DISTINCT o) AS topics FROM quads WHERE p = '{O}tagged') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return A.topic_count(table_graph(spark, sf_dir, "docs").quads, O)


@query("a14_digest_lines", f"x AS (SELECT (SELECT count(DISTINCT g) FROM quads) + (SELECT count(DISTINCT type) FROM types) + 5 AS n) SELECT * FROM x", ("orders",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "orders")
    parts = [A.graph_sizes(g).select("n"), A.nodes_by_type(g).select("n"), A.edge_counts(g).select("n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(F.count("*").alias("n"))


# --- relational algebra ---------------------------------------------------
LEARNING = f"{O}Learning"


@query("q1_pattern_scan", f"x AS (SELECT s FROM quads WHERE p = '{O}tagged' AND o = '{HUB}') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").triples(p=O + "tagged", o=HUB).select("s")


@query("q2_star_join", f"x AS (SELECT t.s, title, g.label FROM types t JOIN titles USING (s) JOIN tags g ON g.s = t.s WHERE type = '{LEARNING}') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    tags = g.where(O + "tagged").select("s", F.col("o").alias("x")).join(g.values(G.PREF_LABEL, "label").withColumnRenamed("s", "x"), "x").select("s", "label")
    return g.instances("Learning").select("s").join(g.values(G.TITLE, "title"), "s").join(tags, "s")


@query("q3_optional", f"x AS (SELECT t.s, p.o AS priority FROM types t LEFT JOIN quads p ON p.s = t.s AND p.p = '{O}priority') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    return g.node_types.select(F.col("iri").alias("s")).join(g.values(O + "priority", "priority"), "s", "left")


@query("q4_nested_optional", f"x AS (SELECT t.s, d.o AS derived, p.o AS path FROM types t LEFT JOIN quads d ON d.s = t.s AND d.p = '{G.DERIVED}' LEFT JOIN quads p ON p.s = d.o AND p.p = '{O}path' WHERE type IN ('{LEARNING}', '{O}Decision')) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    inner = g.values(G.DERIVED, "derived").join(g.values(O + "path", "path").withColumnRenamed("s", "derived"), "derived", "left")
    return g.instances("Learning", "Decision").select("s").join(inner, "s", "left")


@query("q5_union", f"x AS (SELECT s, o FROM quads WHERE p = '{O}category' UNION ALL SELECT s, o FROM quads WHERE p = '{O}priority') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    return g.where(O + "category").unionByName(g.where(O + "priority")).select("s", "o")


@query("q6_values", f"x AS (SELECT s, type FROM types WHERE type IN ('{LEARNING}', '{O}Repo')) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").instances("Learning", "Repo")


@query("q7_filter", f"x AS (SELECT s, o FROM quads WHERE p = '{O}number' AND CAST(o AS BIGINT) >= 100 AND CAST(o AS BIGINT) <= 900 AND NOT o = '500') SELECT * FROM x", ("events",))
def _(spark, sf_dir):
    n = F.col("o").cast("long")
    return table_graph(spark, sf_dir, "events").where(O + "number").where((n >= 100) & (n <= 900) & ~(F.col("o") == "500")).select("s", "o")


@query("q8_bind_if", f"x AS (SELECT t.s, coalesce(p.o, 'none') AS priority, CASE WHEN p.o IS NOT NULL AND p.o < 'P2' THEN 'high' ELSE 'low' END AS band FROM types t LEFT JOIN quads p ON p.s = t.s AND p.p = '{O}priority' WHERE t.type = '{LEARNING}') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    out = g.instances("Learning").select("s").join(g.values(O + "priority", "p"), "s", "left")
    return out.select("s", F.coalesce("p", F.lit("none")).alias("priority"), F.when(F.col("p").isNotNull() & (F.col("p") < "P2"), "high").otherwise("low").alias("band"))


@query("q9_distinct", f"x AS (SELECT DISTINCT o FROM quads WHERE p = '{O}partOf') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").where(O + "partOf").select("o").distinct()


@query("q11_top_k", f"x AS (SELECT s, title FROM titles ORDER BY title DESC, s LIMIT 25) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").values(G.TITLE, "title").orderBy(F.desc("title"), "s").limit(25)


@query("q12_subselect", f"x AS (SELECT s FROM types WHERE type = '{LEARNING}' ORDER BY s LIMIT 20) SELECT x.s, title FROM x JOIN titles USING (s)", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    return g.instances("Learning").select("s").orderBy("s").limit(20).join(g.values(G.TITLE, "title"), "s")


@query("q13_groupby", "x AS (SELECT p, count(*) AS n, count(DISTINCT s) AS subjects FROM triples GROUP BY p) SELECT * FROM x", ("docs", "orders"))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs", "orders")
    return g.spread(g.union.select("p", "s"), "p", "s", times=4).groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"))


@query("q14_sum_max", f"x AS (SELECT w.o AS repo, CAST(sum(CAST(q.o AS BIGINT)) AS BIGINT) AS total, max(CAST(q.o AS BIGINT)) AS top FROM quads q JOIN quads w ON w.s = q.s AND w.p = '{O}partOf' WHERE q.p = '{O}number' GROUP BY w.o) SELECT * FROM x", ("events",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "events")
    n = g.where(O + "number").select("s", F.col("o").cast("long").alias("n"))
    return n.join(g.where(O + "partOf").select("s", F.col("o").alias("repo")), "s").groupBy("repo").agg(F.sum("n").alias("total"), F.max("n").alias("top"))


@query("q15_sample", "x AS (SELECT p, min(o) AS o FROM triples GROUP BY p) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").union.groupBy("p").agg(F.min("o").alias("o"))


@query("q16_group_concat", f"x AS (SELECT o AS repo, string_agg(DISTINCT regexp_extract(type, '[^#]*$', 0), ',' ORDER BY regexp_extract(type, '[^#]*$', 0)) AS classes FROM quads JOIN types USING (s) WHERE p = '{O}partOf' GROUP BY o) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    g = table_graph(spark, sf_dir, "docs")
    t = g.where(O + "partOf").select("s", F.col("o").alias("repo")).join(g.node_types.withColumnRenamed("iri", "s"), "s")
    return t.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_set(F.substring_index("type", "#", -1))), ",").alias("classes"))


@query("q17_rank", "x AS (SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON b.event_type = a.event_type AND floor(b.value) >= floor(a.value) GROUP BY a.event_id) SELECT event_id, n FROM x".join(["WITH ", ""]))
def _(spark, sf_dir):
    return aggregates_rank(read(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").alias("v"))).select("event_id", "n")


@query("q18_path_plus", f"e AS (SELECT DISTINCT s, o FROM quads WHERE p = '{O}partOf'), c(s, o) AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON e.s = c.o) SELECT s AS src, o AS dst FROM c", ("places",))
def _(spark, sf_dir):
    e = table_graph(spark, sf_dir, "places").edges
    return E.closure(e, O + "partOf", e.select("src"))


@query("q21_strings", f"x AS (SELECT s, lower(title) AS low, upper(substr(title, 1, 7)) AS up, contains(title, 'en') AS has, starts_with(title, 'DOC-1') AS begins, substr(title, 1, 7) AS head, regexp_matches(title, '^DOC-[0-9]+ ') AS fits FROM titles) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    t = F.col("title")
    return table_graph(spark, sf_dir, "docs").values(G.TITLE, "title").select("s", F.lower(t).alias("low"), F.upper(F.substring(t, 1, 7)).alias("up"), F.contains(t, F.lit("en")).alias("has"), t.startswith("DOC-1").alias("begins"), F.substring(t, 1, 7).alias("head"), t.rlike("^DOC-[0-9]+ ").alias("fits"))


@query("q22_is_iri", "x AS (SELECT o_kind = 'iri' AS is_iri, count(*) AS n FROM triples GROUP BY 1) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").union.groupBy((F.col("o_kind") == "iri").alias("is_iri")).agg(F.count("*").alias("n"))


@query("q27_set_value", f"x AS (SELECT s, o FROM triples WHERE p = '{G.TITLE}' AND s <> '{NODE}' UNION ALL SELECT '{NODE}', 'new') SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").replaced(NODE, G.TITLE, "new").where(G.TITLE).select("s", "o")


# --- text rules -----------------------------------------------------------
#: Comment bodies of every kind, made from conversations, in SQL that both engines read.
BODIES = """SELECT conv_id, turn, role, CASE conv_id % 9
  WHEN 0 THEN '# ai-implement-build-up-learnings' || chr(10) || text WHEN 1 THEN 'AI Planning: ' || text WHEN 2 THEN '## Summary' || chr(10) || text || chr(10) || '## Approach'
  WHEN 3 THEN chr(10) || '<!-- x -->' || chr(10) || '## Bare' || chr(10) || '### Two words' || chr(10) || text WHEN 4 THEN '## 🔥 Smoke-Jumper Report' || chr(10) || text
  WHEN 5 THEN '<!-- ai-implement post-push status=done -->' || chr(10) || 'severity: High [medium] P1 ' || text WHEN 6 THEN '<!-- claude-review-verdict -->' || chr(10) || '🟡 **bold** `code` ![alt](u) [link](u) ' || text
  WHEN 7 THEN CASE WHEN turn = 0 THEN 'LGTM!' ELSE '<!-- ai-implement post-push status=start -->' || text END ELSE text END AS body,
  CASE conv_id % 5 WHEN 0 THEN 'chatgpt-codex-connector[bot]' WHEN 1 THEN 'claude[bot]' WHEN 2 THEN 'github-actions[bot]' WHEN 3 THEN 'a-bot' ELSE 'ann' END AS login FROM {conversations}"""
BODY_SQL = "b AS (" + BODIES.format(conversations="conversations") + ")"


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BODIES, conversations=read(spark, sf_dir, "conversations"))


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def d_lines(x: str) -> str:
    return f"list_transform(regexp_split_to_array({x}, '\\r\\n|\\n'), lambda z: {d_strip('z')})"


def d_raw(x: str) -> str:
    return f"coalesce(list_filter({d_lines(x)}, lambda z: z <> '')[1], '')"


def d_head(x: str) -> str:
    return d_strip(f"regexp_replace({x}, '^#+', '')")


def d_first(x: str) -> str:
    words = f"list_filter(regexp_split_to_array({d_head('z')}, '\\s+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[\\p{{So}}\\p{{Sk}}\\p{{Sm}}\\p{{Mn}}\\x{{200D}}\\x{{FE0F}}\\x{{20E3}}]+'))"
    kept = f"list_filter({d_lines(x)}, lambda z: z <> '' AND NOT (starts_with(z, '<!--') AND ends_with(z, '-->')) AND (NOT starts_with(z, '#') OR len({words}) > 1))[1]"
    return f"coalesce(CASE WHEN starts_with({kept}, '#') THEN {d_head(kept)} ELSE {kept} END, '')"


def d_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def d_learning(x: str) -> str:
    return d_any(f"lower({d_head(d_raw(x))})", K.LEARNING_MARKERS)


def d_classify(x: str, bot: str) -> str:
    summary = f"(starts_with({d_strip(x)}, '## Summary') AND regexp_matches({x}, '(?m)^## (Approach|Test plan)'))"
    return f"""CASE WHEN {d_learning(x)} THEN 'learning' WHEN starts_with({d_raw(x)}, '{K.SMOKE_HEADING}') THEN 'verification' WHEN starts_with({d_raw(x)}, '{K.PLANNING_HEADING}') THEN 'planning_note'
      WHEN {bot} AND (contains({d_first(x)}, 'Implementation Summary') OR {summary}) THEN 'implementation_note' WHEN NOT {bot} AND length({d_strip(x)}) >= 400 THEN 'decision' END"""


def d_title(key: str, issue: str, x: str, kind: str) -> str:
    low = f"lower({d_head(d_raw(x))})"
    phase = f"CASE WHEN contains({low}, 'build-down') THEN 'build-down learnings' WHEN contains({low}, 'build-up') THEN 'build-up learnings' ELSE 'learnings' END"
    marked = f"(contains({x}, '{K.POST_PUSH_MARKER}') OR contains({x}, '{K.VERDICT_MARKER}'))"
    return f"""CASE WHEN {kind} = 'learning' AND {d_learning(x)} THEN {key} || ' ' || {phase} || CASE WHEN {issue} <> '' THEN ' — ' || {issue} ELSE '' END
      WHEN {kind} = 'verification' AND {marked} THEN {key} || ' review' || CASE WHEN {d_first(x)} <> '' THEN ': ' || {d_first(x)} ELSE '' END WHEN {kind} = 'implementation_note' THEN {key} || ' implementation summary'
      WHEN {d_first(x)} <> '' THEN {key} || ': ' || {d_first(x)} ELSE {key} || ' note' END"""


def d_kind(login: str, x: str) -> str:
    return f"""CASE WHEN lower({login}) = 'chatgpt-codex-connector[bot]' OR {d_any(x, K.CODEX_MARKERS)} THEN 'codex' WHEN lower({login}) = 'claude[bot]' OR (lower({login}) = 'github-actions[bot]' AND (contains({x}, '{K.VERDICT_MARKER}') OR contains(lower({x}), 'claude review'))) THEN 'claude'
      WHEN contains({x}, '{K.FINDING_MARKER}') OR contains({x}, '{K.NATIVE_REVIEW_MARKER}') THEN 'ai-implement' WHEN ends_with(lower({login}), '[bot]') OR ends_with(lower({login}), '-bot') OR contains(lower({login}), 'bot]') THEN 'other-bot' ELSE 'human' END"""


def d_severity(x: str, kind: str, state: str) -> str:
    some = lambda pattern, group: f"nullif(regexp_extract({x}, '{pattern}', {group}), '')"
    return f"""coalesce(CASE {kind} WHEN 'codex' THEN {some("\\b(P0|P1|P2)\\b", 1)} WHEN 'claude' THEN CASE WHEN contains({x}, '🔴') THEN 'blocking' WHEN contains({x}, '🟡') THEN 'warning' ELSE lower({some("(?i)severity[:\\s]+(\\w+)", 1)}) END
      WHEN 'ai-implement' THEN CASE WHEN contains(lower({x}), '[blocking]') THEN 'blocking' WHEN contains(lower({x}), '[medium]') THEN 'medium' WHEN contains(lower({x}), '[minor]') THEN 'minor' END WHEN 'human' THEN CASE WHEN {state} = 'CHANGES_REQUESTED' THEN 'changes_requested' END END, 'unknown')"""


def d_plain(x: str) -> str:
    for pattern, to in (("(?s)<!--.*?-->", ""), ("<[^>]+>", ""), ("```[\\s\\S]*?```", ""), ("`[^`]+`", ""), ("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("\\[([^\\]]+)\\]\\([^)]+\\)", "\\1"), ("\\*{1,3}|_{1,3}", "")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return d_strip(x)


@query("f1_first_line", f"WITH {BODY_SQL} SELECT conv_id, turn, {d_first('body')} AS line FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.first_line(F.col("body")).alias("line"))


@query("f2_classify", f"WITH {BODY_SQL} SELECT conv_id, turn, {d_classify('body', chr(40) + 'role = ' + chr(39) + 'system' + chr(39) + chr(41))} AS kind FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.classify(F.col("body"), (K.PLANNING_HEADING,), F.col("role") == "system").alias("kind"))


@query(
    "f3_classify_pr",
    f"""WITH {BODY_SQL} SELECT conv_id, turn, CASE WHEN {d_learning('body')} THEN 'learning' WHEN starts_with({d_raw('body')}, '{K.SMOKE_HEADING}') OR contains(body, '{K.VERDICT_MARKER}') THEN 'verification'
 WHEN contains(body, '{K.POST_PUSH_MARKER}') AND NOT contains(body, '{K.POST_PUSH_START}') THEN 'verification' WHEN NOT ends_with(login, '[bot]') AND length({d_strip('body')}) >= 400 THEN 'decision' END AS kind FROM b""",
)
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.classify_pull_comment(F.col("body"), F.col("login")).alias("kind"))


@query("f4_strip_markup", f"WITH {BODY_SQL} SELECT conv_id, turn, {d_plain('body')} AS plain FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.strip_markup(F.col("body")).alias("plain"))


@query("f5_reviewer_kind", f"WITH {BODY_SQL} SELECT conv_id, turn, {d_kind('login', 'body')} AS kind FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.reviewer_kind(F.col("login"), F.col("body")).alias("kind"))


STATE = "CASE WHEN conv_id % 2 = 0 THEN 'CHANGES_REQUESTED' ELSE 'COMMENTED' END"


@query("f6_severity", f"WITH {BODY_SQL}, k AS (SELECT *, {d_kind('login', 'body')} AS kind, {STATE} AS state FROM b) SELECT conv_id, turn, {d_severity('body', 'kind', 'state')} AS severity FROM k")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.severity(F.col("body"), X.reviewer_kind(F.col("login"), F.col("body")), F.expr(STATE)).alias("severity"))


@query(
    "f7_review_keep",
    f"""WITH {BODY_SQL}, k AS (SELECT *, {d_kind('login', 'body')} AS reviewer_kind, {STATE} AS state, {d_plain('body')} AS plain, {d_any('body', (*K.CODEX_MARKERS, K.FINDING_MARKER, K.NATIVE_REVIEW_MARKER, K.VERDICT_MARKER))} AS marker FROM b)
SELECT conv_id, turn, NOT contains(body, '{K.POST_PUSH_START}') AND NOT regexp_matches(plain, '{X.APPROVAL}') AND (length(plain) >= 20 OR marker OR (turn % 2 = 0 AND state = 'CHANGES_REQUESTED')) AS keep, reviewer_kind, {d_severity('body', 'reviewer_kind', 'state')} AS severity FROM k""",
)
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", *[c.alias(n) for n, c in X.keep_review(F.col("body"), F.col("login"), F.expr("turn % 2 = 0"), F.expr(STATE)).items()])


@query("f8_titles", f"WITH {BODY_SQL}, k AS (SELECT *, 'CNV-' || conv_id AS key, {d_classify('body', 'FALSE')} AS kind FROM b) SELECT conv_id, turn, {d_title('key', chr(39) + 'the issue' + chr(39), 'body', 'kind')} AS title FROM k WHERE kind IS NOT NULL")
def _(spark, sf_dir):
    k = bodies(spark, sf_dir).withColumn("kind", X.classify(F.col("body"), (K.PLANNING_HEADING,))).where("kind is not null")
    return k.select("conv_id", "turn", X.comment_title(F.concat(F.lit("CNV-"), "conv_id"), F.lit("the issue"), F.col("body"), F.col("kind")).alias("title"))


@query("f9_bots", f"WITH {BODY_SQL} SELECT DISTINCT login, ends_with(lower(login), '[bot]') OR contains(lower(login), 'bot]') OR ends_with(lower(login), '-bot') AS by_login, ends_with(lower(login), 'bot') OR lower(login) = 'ann' AS by_name FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("login", X.is_bot_login(F.col("login")).alias("by_login"), X.is_bot_name(F.col("login"), ("ann",)).alias("by_name")).distinct()


@query("f10_badges", f"WITH {BODY_SQL} SELECT conv_id, turn, {d_strip(chr(114) + 'egexp_replace(body, ' + chr(39) + '!' + chr(92) + '[([^' + chr(92) + ']]*)' + chr(92) + ']' + chr(92) + '([^)]*' + chr(92) + ')' + chr(39) + ', ' + chr(39) + chr(92) + '1' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')} AS body FROM b")
def _(spark, sf_dir):
    return bodies(spark, sf_dir).select("conv_id", "turn", X.strip_badges(F.col("body")).alias("body"))


RAW = "CASE p_size % 6 WHEN 0 THEN 'p1' WHEN 1 THEN ' High ' WHEN 2 THEN 'mixed (1 P 2, 4 P3)' WHEN 3 THEN 'critical' WHEN 4 THEN p_brand ELSE 'P9' END"


@query("f12_severity", f"WITH r AS (SELECT p_partkey, {RAW} AS x FROM part) SELECT p_partkey, 'P' || nullif(regexp_extract(x, '(?i)\\bP\\s?([0-3])\\b', 1), '') AS priority, CASE WHEN lower(trim(x)) IN {X.LEVELS} THEN lower(trim(x)) END AS level FROM r")
def _(spark, sf_dir):
    x = F.expr(RAW)
    return read(spark, sf_dir, "part").select("p_partkey", X.priority(x).alias("priority"), X.severity_level(x).alias("level"))


CATEGORY = "CASE p_size % 5 WHEN 0 THEN 'Feature Pattern' WHEN 1 THEN 'logic_error' WHEN 2 THEN 'feature' WHEN 3 THEN p_type ELSE 'Runtime-Error' END"


@query("f13_category", f"WITH r AS (SELECT p_partkey, translate(lower(trim({CATEGORY})), '_ ', '--') AS c FROM part) SELECT p_partkey, CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.CATEGORY_ALIASES.items()) + " ELSE c END AS category FROM r")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.category(F.expr(CATEGORY)).alias("category"))


STATUS = "CASE p_size % 7 WHEN 0 THEN 'Done' WHEN 1 THEN 'wip' WHEN 2 THEN 'Planned ' WHEN 3 THEN 'wont_fix' WHEN 4 THEN 'In Progress' WHEN 5 THEN 'retracted' ELSE p_type END"


@query("f14_status", f"WITH r AS (SELECT p_partkey, lower(trim({STATUS})) AS x FROM part) SELECT p_partkey, CASE WHEN x IN {X.DONE} THEN 'done' WHEN x IN {X.OPEN} THEN 'open' WHEN x IN {X.IN_PROGRESS} THEN 'in-progress' WHEN x = 'wont_fix' THEN 'wont-fix' ELSE x END AS status FROM r")
def _(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", X.status(F.expr(STATUS)).alias("status"))


NOTE = "'see #' || p_partkey || ' and #x, abc-' || p_size || ' not A-1, Zed9-07; ' || p_name"


@query("f15_keys", f"WITH r AS (SELECT p_partkey, {NOTE} AS x FROM part) SELECT p_partkey, array_to_string(regexp_extract_all(x, '#(\\d+)', 1), ',') AS refs, upper(array_to_string(regexp_extract_all(x, '(?i)\\b[A-Z][A-Z0-9]{{1,9}}-\\d+\\b'), ',')) AS keys, upper(array_to_string(regexp_extract_all(x, '(?i)\\b(?:ABC)-\\d+\\b'), ',')) AS own FROM r")
def _(spark, sf_dir):
    x = F.expr(NOTE)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.refs(x), ",").alias("refs"), F.array_join(X.tracker_keys(x), ",").alias("keys"), F.array_join(X.tracker_keys(x, ("ABC",)), ",").alias("own"))


@query("f16_tags", "WITH r AS (SELECT p_partkey, '[ ' || p_brand || ', ' || chr(39) || p_type || chr(39) || ',,' || chr(10) || ' x ]' AS x FROM part) SELECT p_partkey, array_to_string(list_transform(list_filter(regexp_split_to_array(regexp_replace(x, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), '[,\\n]'), lambda t: trim(t) <> ''), lambda t: lower(trim(trim(t), chr(39) || chr(34)))), ',') AS tags FROM r")
def _(spark, sf_dir):
    x = F.concat(F.lit("[ "), "p_brand", F.lit(", '"), "p_type", F.lit("',,\n x ]"))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(X.tags(x), ",").alias("tags"))


@query("f17_dates", "WITH r AS (SELECT p_partkey, 'on 20' || (10 + p_size % 20) || '-0' || (1 + p_size % 9) || '-' || (10 + p_size % 25) || ' or later' AS x FROM part) SELECT p_partkey, TRY_CAST(regexp_extract(x, '\\d{4}-\\d{2}-\\d{2}', 0) AS DATE) AS found FROM r")
def _(spark, sf_dir):
    x = F.expr("'on 20' || (10 + p_size % 20) || '-0' || (1 + p_size % 9) || '-' || (10 + p_size % 25) || ' or later'")
    return read(spark, sf_dir, "part").select("p_partkey", X.first_date(x).alias("found"))


@query("f19_anchor", "WITH r AS (SELECT doc_id, regexp_extract(text, '^[^' || chr(10) || ']*', 0) AS x FROM documents) SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(x), '[^\\p{L}\\p{M}\\p{N}_\\s-]', '', 'g')), '[\\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor FROM r")
def _(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", X.heading_anchor(F.substring_index("text", "\n", 1)).alias("anchor"))


@query("f23_hash", "SELECT page_id, sha256(html) AS bare, 'sha256:' || sha256(html) AS named FROM pages")
def _(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", page_hash(F.col("html")).alias("bare"), page_hash(F.col("html"), "sha256:").alias("named"))


@query("f24_iri", f"SELECT page_id, '{R}docpage/' || url_encode(url) AS iri, '{R}topic/' || url_encode('a b*~/' || page_id) AS topic, substr(sha256('0.1.0' || chr(10) || url), 1, 16) AS run FROM pages")
def _(spark, sf_dir):
    i = Iris(CFG)
    return read(spark, sf_dir, "pages").select("page_id", i.doc_page(F.col("url")).alias("iri"), i.topic(F.concat(F.lit("a b*~/"), "page_id")).alias("topic"), run_id(F.lit("0.1.0"), F.col("url")).alias("run"))


PART_SQL = f"CASE WHEN starts_with(s, '{R}') THEN coalesce(nullif(split_part(substr(s, {len(R) + 1}), '/', 1), ''), 'other') WHEN starts_with(s, '{O}') OR contains(s, '#') THEN 'onto' ELSE 'other' END"


@query("f25_bucket", f"x AS (SELECT {PART_SQL} AS part, count(*) AS n FROM triples GROUP BY 1) SELECT * FROM x", ("docs", "events", "orders", "places"))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs", "events", "orders", "places").union.groupBy(part_of(CFG, F.col("s")).alias("part")).agg(F.count("*").alias("n"))


@query("f27_local_name", "x AS (SELECT DISTINCT p, regexp_extract(p, '[^#/]*$', 0) AS name FROM triples) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return table_graph(spark, sf_dir, "docs").union.select("p", local_name(F.col("p")).alias("name")).distinct()


CARDS = f"""g AS (SELECT s, array_to_string(list_sort(list(DISTINCT label)), ', ') AS tags FROM tags GROUP BY s), v AS (SELECT s, min(o) FILTER (p = '{O}fix' AND o <> '') AS fix, min(o) FILTER (p = '{O}detail' AND o <> '') AS detail, min(o) FILTER (p = '{O}description') AS description, min(o) FILTER (p = '{O}trackerKey') AS key, string_agg(DISTINCT o, ', ' ORDER BY o) FILTER (p = '{O}label' AND lower(o) NOT IN {K.LIFECYCLE_LABELS}) AS labels FROM quads GROUP BY s),
c AS (SELECT t.s AS iri, regexp_extract(type, '[^#]*$', 0) AS type, CASE WHEN type = '{O}Issue' THEN v.key || ': ' ELSE '' END || title AS title, CASE regexp_extract(type, '[^#]*$', 0) WHEN 'Learning' THEN g.tags WHEN 'Issue' THEN v.labels END AS extras,
  coalesce(substr(CASE regexp_extract(type, '[^#]*$', 0) WHEN 'Learning' THEN fix WHEN 'Issue' THEN description ELSE detail END, 1, 400), '') AS snippet FROM types t JOIN titles USING (s) JOIN v USING (s) LEFT JOIN g USING (s) WHERE type IN ('{O}Learning', '{O}Decision', '{O}Doc', '{O}Issue'))
SELECT iri, type, title, snippet, concat_ws(chr(10), title, nullif(extras, ''), nullif(snippet, '')) AS card_text FROM c"""


@query("i1_cards", CARDS, ("docs", "orders"))
def _(spark, sf_dir):
    return build_cards(table_graph(spark, sf_dir, "docs", "orders"))


@query("i2_embed")
def _(spark, sf_dir):
    v = embed_cards(build_cards(table_graph(spark, sf_dir, "docs")), HashingEmbedder(64))
    return v.select("iri", F.size("embedding").alias("dim"), F.round(F.sqrt(search.dot(F.col("embedding"), F.col("embedding"))), 4).alias("norm"))


# --- construction ---------------------------------------------------------
COMMENT_SQL = f"""WITH {BODY_SQL}, f AS (SELECT conv_id, max(text) FILTER (turn = 0) AS t FROM conversations GROUP BY conv_id),
k AS (SELECT b.conv_id, b.turn, 'CNV-' || b.conv_id AS key, coalesce(f.t, '') AS issue, {d_strip('body')} AS body, b.role || CASE WHEN b.role = 'system' THEN ' bot' ELSE '' END AS author, b.role = 'system' AS bot FROM b LEFT JOIN f USING (conv_id)),
c AS (SELECT *, {d_classify('body', 'bot')} AS kind, '{R}comment/CNV-' || conv_id || '/' || turn AS node FROM k),
w AS (SELECT *, {d_title('key', 'issue', 'body', 'kind')} AS title FROM c WHERE kind IS NOT NULL)
SELECT DISTINCT s, p, o FROM (
  SELECT node AS s, '{G.RDF_TYPE}' AS p, '{O}' || CASE kind WHEN 'learning' THEN 'Learning' WHEN 'decision' THEN 'Decision' WHEN 'planning_note' THEN 'PlanningNote' WHEN 'verification' THEN 'Verification' ELSE 'ImplementationNote' END AS o FROM w
  UNION ALL SELECT node, '{G.TITLE}', substr(title, 1, 300) FROM w UNION ALL SELECT node, '{O}detail', substr(body, 1, 2000) FROM w UNION ALL SELECT node, '{O}fix', substr(body, 1, 400) FROM w WHERE kind <> 'decision'
  UNION ALL SELECT node, '{G.DERIVED}', '{R}issue/' || key FROM w UNION ALL SELECT node, '{G.GENERATED}', '{R}run/r1' FROM w UNION ALL SELECT node, '{G.ATTRIBUTED}', '{R}person/' || url_encode(author) FROM w
  UNION ALL SELECT '{R}person/' || url_encode(author), '{G.RDF_TYPE}', '{O}Person' FROM w UNION ALL SELECT '{R}person/' || url_encode(author), '{O}login', author FROM w
  UNION ALL SELECT node, '{O}tagged', '{R}topic/chat' FROM w UNION ALL SELECT '{R}topic/chat', '{G.RDF_TYPE}', '{O}Topic' FROM w UNION ALL SELECT '{R}topic/chat', '{G.PREF_LABEL}', 'chat' FROM w)"""


@query("c9_comment_quads", COMMENT_SQL)
def _(spark, sf_dir):
    first = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("t"))
    rows = bodies(spark, sf_dir).join(first, "conv_id", "left")
    author = F.concat("role", F.when(F.col("role") == "system", " bot").otherwise(""))
    df = rows.select(F.concat(F.lit("CNV-"), "conv_id").alias("identifier"), F.coalesce("t", F.lit("")).alias("title"), F.array(F.lit("chat")).alias("tags"), F.col("turn").alias("ordinal"), "body", author.alias("author"))
    return Construct(CFG).comments(df, "r1").select("s", "p", "o").distinct()


ISSUE_SQL = f"""WITH i AS (SELECT 'ORD-' || o_orderkey AS key, o_orderstatus AS st, o_orderpriority AS pr, 'ORD-' || (o_orderkey - o_orderkey % 5) AS parent, o_orderkey % 5 <> 0 AS sub, c_mktsegment AS seg FROM orders JOIN customer ON o_custkey = c_custkey), n AS (SELECT *, '{R}issue/' || key AS s FROM i)
SELECT DISTINCT s, p, o FROM (
  SELECT s, '{G.RDF_TYPE}' AS p, '{O}Issue' AS o FROM n UNION ALL SELECT s, '{O}trackerKey', key FROM n UNION ALL SELECT s, '{O}trackerTeam', 'ORD' FROM n UNION ALL SELECT s, '{O}sourceSystem', 'linear' FROM n UNION ALL SELECT s, '{G.TITLE}', key FROM n UNION ALL SELECT s, '{G.RDFS_LABEL}', key FROM n
  UNION ALL SELECT s, '{O}state', st FROM n UNION ALL SELECT s, '{O}status', lower(st) FROM n UNION ALL SELECT s, '{O}label', pr FROM n UNION ALL SELECT s, '{O}label', 'AI-Working' FROM n UNION ALL SELECT s, '{O}tagged', '{R}topic/' || url_encode(lower(pr)) FROM n
  UNION ALL SELECT '{R}topic/' || url_encode(lower(pr)), '{G.RDF_TYPE}', '{O}Topic' FROM n UNION ALL SELECT '{R}topic/' || url_encode(lower(pr)), '{G.PREF_LABEL}', lower(pr) FROM n
  UNION ALL SELECT s, '{O}inProject', '{R}project/' || url_encode(seg) FROM n UNION ALL SELECT '{R}project/' || url_encode(seg), '{G.RDF_TYPE}', '{O}Project' FROM n UNION ALL SELECT '{R}project/' || url_encode(seg), '{G.TITLE}', seg FROM n
  UNION ALL SELECT s, '{O}partOf', '{R}issue/' || parent FROM n WHERE sub UNION ALL SELECT '{R}issue/' || parent, '{G.RDF_TYPE}', '{O}Issue' FROM n WHERE sub)"""


@query("c8_issue_quads", ISSUE_SQL)
def _(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    key = lambda k: F.concat(F.lit("ORD-"), k)
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    name = lambda c: F.struct(c.alias("name"))
    df = rows.select(key(k).alias("identifier"), none.alias("title"), none.alias("description"), none.alias("branchName"), none.alias("team"), none.alias("sourceSystem"), name(F.col("o_orderstatus")).alias("state"), F.struct(F.array(name(F.col("o_orderpriority")), name(F.lit("AI-Working"))).alias("nodes")).alias("labels"), name(F.col("c_mktsegment")).alias("project"), F.when(k % 5 != 0, F.struct(key(k - k % 5).alias("identifier"))).alias("parent"), F.lit(None).cast("struct<nodes: array<struct<type: string, relatedIssue: struct<identifier: string>>>>").alias("relations"))
    return Construct(CFG).issues(df).select("s", "p", "o")  # distinct in one graph, and a predicate's terms are of one kind


def facts_sql(base: str, *facts: tuple[str, str, str]) -> str:
    """Distinct (s, p, o) of facts over the rows x of base; a null subject or object is no fact."""
    return f"WITH {base} SELECT DISTINCT s, p, o FROM (" + " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, CAST({o} AS VARCHAR) AS o FROM x" for s, p, o in facts) + ") WHERE s IS NOT NULL AND o IS NOT NULL"


def facts_of(df: DataFrame) -> DataFrame:
    return df.select("s", "p", "o").distinct()


def node(kind: str, *parts: str) -> str:
    return f"'{R}{kind}/' || " + " || '/' || ".join(f"url_encode({p})" for p in parts)


TYPE, T = G.RDF_TYPE, lambda name: f"'{O}{name}'"
REPO_BASE = "x AS (SELECT DISTINCT 'org/' || source AS slug, source <> 'src0' AS main FROM documents)"


@query("c1_repo_quads", facts_sql(REPO_BASE, *[(node("repo", "slug"), p, o) for p, o in ((TYPE, T("Repo")), (O + "sourceSystem", "'github'"), (O + "sourceId", "slug"), (G.TITLE, "slug"), (O + "docsUrl", "CASE WHEN main THEN 'https://' || slug END"), (O + "historyBranch", "'main'"), (O + "isDefaultBranch", "main"), (O + "snapshotRef", "CASE WHEN main THEN 'abc' END"))]))
def _(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select(F.concat(F.lit("org/"), "source").alias("slug"), (F.col("source") != "src0").alias("main")).distinct()
    return facts_of(Construct(CFG).repos(x.select("slug", F.lit("main").alias("history_branch"), F.col("main").alias("is_default_branch"), F.when(F.col("main"), "abc").otherwise("").alias("snapshot_ref"), F.when(F.col("main"), F.concat(F.lit("https://"), "slug")).alias("docs_url"))))


FILE_NODE = f"CASE WHEN doc THEN {node('doc', 'slug', 'path')} ELSE {node('file', 'slug', 'path')} END"


@query("c2_file_quads", facts_sql("x AS (SELECT 'org/' || source AS slug, 'a b/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path, doc_id % 3 <> 0 AS doc, 'Title ' || doc_id AS title, text FROM documents)", (FILE_NODE, TYPE, f"CASE WHEN doc THEN {T('Doc')} ELSE {T('File')} END"), (FILE_NODE, O + "path", "path"), (FILE_NODE, O + "partOf", node("repo", "slug")), (FILE_NODE, G.TITLE, "CASE WHEN doc THEN title END"), (FILE_NODE, O + "detail", "CASE WHEN doc THEN nullif(text, '') END")))
def _(spark, sf_dir):
    doc = F.col("doc_id") % 3 != 0
    x = read(spark, sf_dir, "documents").select(F.concat(F.lit("org/"), "source").alias("slug"), F.concat(F.lit("a b/"), "doc_id", F.when(doc, ".md").otherwise(".py")).alias("path"), doc.alias("is_doc"), F.concat(F.lit("Title "), "doc_id").alias("title"), F.col("text").alias("detail"))
    return facts_of(Construct(CFG).files(x))


COMMIT_BASE = "x AS (SELECT 'o/r' || (user_id % 3) AS slug, 's' || event_id AS sha, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'user ' || user_id END AS author, 'u' || user_id || '@x' AS email, CASE WHEN user_id % 4 = 0 THEN 'u' || user_id || '@x' ELSE 'user ' || user_id END AS login, replace(substr(CAST(ts AS VARCHAR), 1, 19), ' ', 'T') || '+02:00' AS date, event_type || ' AB-' || (event_id % 7) AS subject, 'AB-' || (event_id % 7) AS key FROM events)"
COMMIT = node("commit", "slug", "sha")


@query("c3_commit_quads", facts_sql(COMMIT_BASE, (COMMIT, TYPE, T("Commit")), (COMMIT, O + "sourceId", "sha"), (COMMIT, G.TITLE, "subject"), (COMMIT, G.CREATED, "date"), (COMMIT, O + "partOf", node("repo", "slug")), (COMMIT, G.ATTRIBUTED, node("person", "login")), (node("person", "login"), TYPE, T("Person")), (node("person", "login"), O + "login", "login"), (node("person", "login"), G.RDFS_LABEL, "login"), (COMMIT, O + "references", node("issue", "key")), (node("issue", "key"), O + "addressedBy", COMMIT), (node("issue", "key"), TYPE, T("Issue")), (node("issue", "key"), O + "trackerKey", "key")))
def _(spark, sf_dir):
    own = F.col("user_id") % 4 == 0
    date = F.concat(F.replace(F.substring(F.col("ts").cast("string"), 1, 19), F.lit(" "), F.lit("T")), F.lit("+02:00"))
    x = read(spark, sf_dir, "events").select(F.concat(F.lit("o/r"), F.col("user_id") % 3).alias("slug"), F.concat(F.lit("s"), "event_id").alias("sha"), F.when(own, "").otherwise(F.concat(F.lit("user "), "user_id")).alias("author"), F.concat(F.lit("u"), "user_id", F.lit("@x")).alias("email"), date.alias("date"), F.concat("event_type", F.lit(" AB-"), F.col("event_id") % 7).alias("subject"))
    return facts_of(Construct(CFG).commits(x))


PULL = node("pr", "slug", "n")
PULL_BASE = "x AS (SELECT 'o/r' AS slug, CAST(event_id AS VARCHAR) AS n, event_type AS title, CASE WHEN event_type = 'purchase' THEN '2024-01-02T00:00:00Z' END AS merged, CASE WHEN user_id % 5 = 0 THEN 'unknown' ELSE 'u' || user_id END AS login FROM events)"


@query("c4_pull_quads", facts_sql(PULL_BASE, (PULL, TYPE, T("PullRequest")), (PULL, O + "number", "n"), (PULL, G.TITLE, "title"), (PULL, O + "state", "CASE WHEN merged IS NULL THEN 'open' ELSE 'merged' END"), (PULL, O + "mergedAt", "merged"), (PULL, O + "baseRefName", "'main'"), (PULL, O + "partOf", node("repo", "slug")), (PULL, G.ATTRIBUTED, node("person", "login")), (node("person", "login"), TYPE, T("Person")), (node("person", "login"), O + "login", "login")))
def _(spark, sf_dir):
    x = read(spark, sf_dir, "events").select(F.lit("o/r").alias("slug"), F.col("event_id").alias("number"), F.col("event_type").alias("title"), F.lit(None).cast("string").alias("body"), F.lit("open").alias("state"), F.when(F.col("event_type") == "purchase", "2024-01-02T00:00:00Z").alias("merged_at"), F.lit("none").alias("merge_commit_sha"), F.struct(F.lit("main").alias("ref")).alias("base"), F.struct(F.when(F.col("user_id") % 5 == 0, "").otherwise(F.concat(F.lit("u"), "user_id")).alias("login")).alias("user"))
    return facts_of(Construct(CFG).pulls(x, x.selectExpr("slug", "'x' sha")))


ADR = node("decision", "slug", "'adr'", "n").replace("url_encode('adr')", "'adr'")


@query("c11_decision_quads", facts_sql("x AS (SELECT 'o/' || source AS slug, CAST(doc_id AS VARCHAR) AS n, 'docs/adr/' || doc_id || '.md' AS path, 'AB-' || (doc_id % 9) AS key, 'use ' || lang AS title FROM documents)", (ADR, TYPE, T("Decision")), (ADR, G.TITLE, "'ADR ' || n || ': ' || title"), (ADR, O + "status", "'accepted'"), (ADR, G.DERIVED, node("doc", "slug", "path")), (ADR, G.GENERATED, f"'{R}run/r1'"), (ADR, O + "filedAs", node("issue", "key")), (node("issue", "key"), TYPE, T("Issue")), (node("issue", "key"), O + "trackerKey", "key")))
def _(spark, sf_dir):
    text = F.concat(F.lit("intro\n# ADR 00"), "doc_id", F.lit(": use "), "lang", F.lit("\n\n**Status:** Accepted since then\n**References:** ab-"), F.col("doc_id") % 9, F.lit("\n"))
    x = read(spark, sf_dir, "documents").select(F.concat(F.lit("o/"), "source").alias("slug"), F.concat(F.lit("docs/adr/"), "doc_id", F.lit(".md")).alias("path"), F.col("doc_id").cast("string").alias("stem"), text.alias("text"))
    return facts_of(Construct(CFG).adrs(x, "r1"))


SITE, PAGE_NODE = f"{node('docsite', chr(39) + 'https://s' + chr(39))}", node("docpage", "url")


@query("c13_page_quads", facts_sql("x AS (SELECT url, html, 'Title ' || page_id AS title FROM pages)", (SITE, TYPE, T("DocSite")), (SITE, O + "rootUrl", "'https://s'"), (SITE, G.TITLE, "'Site'"), (SITE, G.MODIFIED, "'2024-01-01T00:00:00Z'"), (SITE, O + "documentsBranch", "'main'"), (PAGE_NODE, TYPE, T("DocPage")), (PAGE_NODE, O + "url", "url"), (PAGE_NODE, G.TITLE, "title"), (PAGE_NODE, O + "contentHash", "sha256(html)"), (PAGE_NODE, O + "detail", "'pre'"), (PAGE_NODE, O + "partOf", SITE), (PAGE_NODE, G.MODIFIED, "'2024-01-01T00:00:00Z'"), (PAGE_NODE + " || '#same-part-2'", TYPE, T("DocSection")), (PAGE_NODE + " || '#same-part-2'", O + "anchor", "'same-part-2'"), (PAGE_NODE + " || '#same-part-2'", O + "text", "'two'")))
def _(spark, sf_dir):
    section = lambda h, n, t: F.struct(F.lit(h).alias("heading"), F.lit(n).alias("level"), F.lit(t).alias("text"))
    x = read(spark, sf_dir, "pages").select("url", F.concat(F.lit("Title "), "page_id").alias("title"), F.sha2("html", 256).alias("content_hash"), F.array(section("", 0, "pre"), section("Same part", 2, "one"), section("Same, part!", 3, "two")).alias("sections"))
    q = Construct(CFG).pages(x, "https://s", "Site", "2024-01-01T00:00:00Z", "main")
    second = F.col("s").endswith("#same-part-2")
    return facts_of(q.where((~F.contains("s", F.lit("#"))) | (second & (F.col("p").isin(O + "anchor", O + "text", TYPE)))))


@query("c17_stamp", f"SELECT '{CFG.spine}' AS s, '2024-01-01T00:00:00Z' AS o, count(*) + 1 AS n FROM (SELECT DISTINCT source FROM documents)")
def _(spark, sf_dir):
    x = read(spark, sf_dir, "documents").select("source").distinct()
    stamp = Construct(CFG).stamp(spark, "2023-01-01T00:00:00Z")
    g = G.Graph(stamp.unionByName(x.select(F.lit(CFG.spine).alias("g"), F.concat(F.lit("x:"), "source").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))), CFG).replaced(CFG.spine, G.MODIFIED, "2024-01-01T00:00:00Z")
    return g.quads.agg(F.max(F.when(F.col("p") == G.MODIFIED, F.col("s"))).alias("s"), F.max(F.when(F.col("p") == G.MODIFIED, F.col("o"))).alias("o"), F.count("*").alias("n"))


@query("c15_incremental", "SELECT page_id, page_id % 3 <> 0 AS reused FROM pages")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "pages").withColumn("url", F.concat("url", F.lit("#"), "page_id")).withColumn("content_hash", F.sha2("html", 256))
    prior = p.select("url", F.when(F.col("page_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    same, changed = incremental.split_pages(p, prior)
    return same.select("page_id", F.lit(True).alias("reused")).unionByName(changed.select("page_id", F.lit(False).alias("reused")))


@query("c16_anchor_dedup", "WITH h AS (SELECT source AS url, doc_id AS pos, 'part-' || (doc_id % 13) AS a FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY url, a ORDER BY pos) AS k FROM h) SELECT url, pos, a || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS anchor FROM n")
def _(spark, sf_dir):
    heading = F.concat(F.lit("Part "), F.col("doc_id") % 13)
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("pos"), heading.alias("heading"), F.lit(2).alias("level"), F.lit("").alias("text"))
    return anchored_rows(rows).select("url", "pos", "anchor")


@query("c18_slug_dedup", "WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id, k > 1 AS skipped FROM n")
def _(spark, sf_dir):
    kept, skipped = incremental.first_by(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id")
    return kept.select("doc_id", F.lit(False).alias("skipped")).unionByName(skipped.select("doc_id", F.lit(True).alias("skipped")))


# --- snapshot, validation, guard -----------------------------------------
BYTE = "CAST('0x' || substr(sha256('<' || s || '>'), 1, 2) AS INT)"


@query("k3_pieces", f"x AS (SELECT {PART_SQL} AS part, {BYTE} % 8 AS piece, count(*) AS n FROM triples GROUP BY ALL) SELECT * FROM x", ("docs", "orders"))
def _(spark, sf_dir):
    lines = snapshot.part_lines(table_graph(spark, sf_dir, "docs", "orders"))
    return lines.groupBy("part", snapshot.piece(F.col("s"), 8).alias("piece")).agg(F.count("*").alias("n"))


LINE_SQL = """'<' || s || '> <' || p || '> ' || CASE o_kind WHEN 'iri' THEN '<' || o || '>' ELSE '"' || replace(replace(replace(replace(o, chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r') || '"' || coalesce('^^<' || o_dt || '>', '') END || ' .'"""


@query("k2_part_lines", f"x AS (SELECT {PART_SQL} AS part, s, {LINE_SQL} AS line FROM triples) SELECT * FROM x", ("docs",))
def _(spark, sf_dir):
    return snapshot.part_lines(table_graph(spark, sf_dir, "docs"))


@query(
    "k3_piece_counts",
    f"""l AS (SELECT {PART_SQL} AS part, {BYTE} AS b, octet_length(encode({LINE_SQL})) + 1 AS n FROM triples), k AS (SELECT CAST(2 ** i AS INT) AS k FROM range(9) t(i)),
m AS (SELECT part, k, max(n) AS n FROM (SELECT part, k, b % k AS i, sum(n) AS n FROM l, k GROUP BY ALL) GROUP BY ALL) SELECT part, coalesce(min(k) FILTER (n <= 100000), 256) AS k FROM m GROUP BY part""",
    ("docs", "orders"),
)
def _(spark, sf_dir):
    return snapshot.piece_counts(snapshot.part_lines(table_graph(spark, sf_dir, "docs", "orders")), 100_000)


TYPES_SQL = "sub(a, b) AS (VALUES " + ", ".join(f"('{k}', '{b}')" for k in sorted({*validate.SUBCLASS, *validate.SUBCLASS.values(), *validate.DOMAIN.values(), "Learning", "Issue", "Repo", "Commit", "PullRequest", "ExtractionRun", "Topic", "Project"}) for b in validate.ancestors(k)) + f"""),
dom(p, c) AS (VALUES {", ".join(f"('{O}{k}', '{v}')" for k, v in validate.DOMAIN.items())}),
raw AS (SELECT s, substr(type, {len(O) + 1}) AS t FROM types WHERE starts_with(type, '{O}') UNION SELECT q.s, c FROM quads q JOIN dom ON dom.p = q.p UNION SELECT o, 'Commit' FROM quads WHERE p = '{O}mergeCommit'),
inf AS (SELECT DISTINCT s AS iri, b AS type FROM raw JOIN sub ON sub.a = raw.t)"""


@query("v2_rdfs_types", TYPES_SQL + " SELECT * FROM inf", ("docs", "events"))
def _(spark, sf_dir):
    return validate.inferred_types(table_graph(spark, sf_dir, "docs", "events"))


@query(
    "v1_violations",
    TYPES_SQL + f""", sem AS (SELECT DISTINCT iri FROM inf WHERE type IN ('Learning', 'Decision')), c AS (SELECT s, count(*) FILTER (p = '{G.GENERATED}') AS gen, count(*) FILTER (p = '{G.DERIVED}') AS der, count(*) FILTER (p = '{O}promptHash') AS hash, count(*) FILTER (p = '{O}priority' AND o NOT IN ('P0', 'P1', 'P2', 'P3')) AS bad FROM triples GROUP BY s)
SELECT iri AS focus, '{G.GENERATED}' AS path, 'MinCount' AS component, 'semantic node must name exactly one kg:ExtractionRun (prov:wasGeneratedBy)' AS message FROM sem JOIN c ON c.s = iri WHERE gen < 1
UNION ALL SELECT iri, '{G.DERIVED}', 'MinCount', 'semantic node must anchor to >=1 spine node (prov:wasDerivedFrom)' FROM sem JOIN c ON c.s = iri WHERE der < 1
UNION ALL SELECT iri, '{O}promptHash', 'MinCount', '' FROM inf JOIN c ON c.s = iri WHERE type = 'ExtractionRun' AND hash < 1
UNION ALL SELECT iri, '{O}priority', 'In', 'priority, if present, must be one of P0..P3' FROM inf JOIN c ON c.s = iri WHERE type = 'Learning' AND bad > 0""",
    ("docs",),
)
def _(spark, sf_dir):
    return validate.violations(table_graph(spark, sf_dir, "docs"))


GUARD = """SELECT source || '.nt' AS part, count(*) FILTER (doc_id % 2 = 0) AS prev, count(*) FILTER (doc_id % 3 = 0 AND source <> 'src3') AS new FROM documents GROUP BY source UNION ALL SELECT 'issue.nt', 100, 99 UNION ALL SELECT 'half.nt', 10, 5 UNION ALL SELECT 'fresh.nt', 0, 7"""


@query("v3_guard", f"WITH g AS ({GUARD}) SELECT part, prev, new, CASE WHEN prev > 0 THEN new::DOUBLE / prev END AS ratio, CASE WHEN prev = 0 THEN 'new' WHEN part IN ('issue.nt', 'comment.nt') AND new < prev THEN 'refuse' WHEN part NOT IN ('issue.nt', 'comment.nt') AND new < prev * 0.5 THEN 'refuse' ELSE 'pass' END AS status FROM g")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").withColumn("part", F.concat("source", F.lit(".nt")))
    extra = lambda rows: spark.createDataFrame(rows, "part string, n long")
    old = d.groupBy("part").agg(F.count_if(F.col("doc_id") % 2 == 0).alias("n")).unionByName(extra([("issue.nt", 100), ("half.nt", 10)]))
    new = d.groupBy("part").agg(F.count_if((F.col("doc_id") % 3 == 0) & (F.col("source") != "src3")).alias("n")).where("n > 0").unionByName(extra([("issue.nt", 99), ("half.nt", 5), ("fresh.nt", 7)]))
    return guard.evaluate(old, new, issue_count=5)


# --- sources --------------------------------------------------------------
PATHS = "source || '/' || lang || '/' || CASE doc_id % 4 WHEN 0 THEN 'a.md' WHEN 1 THEN 'b.PY' WHEN 2 THEN 'Notes.TXT' ELSE 'Makefile' END || CASE WHEN doc_id % 40 = 0 THEN '.bak' ELSE '' END"


@query("s8_file_listing", f"WITH f AS (SELECT {PATHS} AS path FROM documents), d AS (SELECT path, regexp_matches(lower(path), '\\.(md|mdx|rst|txt)$') AS is_doc FROM f) SELECT * FROM d WHERE NOT (is_doc AND path LIKE 'src1%/de/%')")
def _(spark, sf_dir):
    return git.listed_files(read(spark, sf_dir, "documents").select(F.expr(PATHS).alias("value")), "corpus", ("src1*/de/*",)).select("path", "is_doc")


@query("s9_git_log", "SELECT CAST(event_id AS VARCHAR) AS sha, 'u' || user_id AS author, event_type AS subject FROM events WHERE event_id % 4 <> 0")
def _(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 4 == 0, F.concat_ws(git.SEPARATOR, F.col("event_id").cast("string"), F.lit("broken"))).otherwise(F.concat_ws(git.SEPARATOR, F.col("event_id").cast("string"), F.concat(F.lit("u"), "user_id"), F.lit("m@x"), F.lit("2024-01-01T00:00:00Z"), F.col("event_type")))
    return git.logged_commits(e.select(line.alias("value")), "corpus").select("sha", "author", "subject")


@query("s16_missing_fields", "WITH r AS (SELECT count(*) AS n, count(*) FILTER (p_size % 2 = 0) AS t FROM part) SELECT f AS field, CASE f WHEN 'identifier' THEN 0 WHEN 'title' THEN n - t WHEN 'description' THEN 0 ELSE n END AS n FROM r, (SELECT unnest(['identifier', 'title', 'description', 'branchName', 'state', 'labels', 'project', 'parent', 'comments', 'relations']) AS f)")
def _(spark, sf_dir):
    json = F.concat(F.lit('{"identifier": "PRT-'), "p_partkey", F.lit('", "description": null'), F.when(F.col("p_size") % 2 == 0, ', "title": "x"').otherwise(""), F.lit("}"))
    return tracker.missing_fields(read(spark, sf_dir, "part").select(json.alias("value")))


@query("s24_text_resources", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 2")
def _(spark, sf_dir):
    mime = F.when(F.col("doc_id") % 3 == 0, "text/markdown").when(F.col("doc_id") % 3 == 2, "image/png")
    return site.text_resources(read(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ordinal"), mime.alias("mime"), "text")).select("doc_id")


@query("s12_comment_cap", "WITH n AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) SELECT doc_id FROM n WHERE k <= 20")
def _(spark, sf_dir):
    return incremental.capped(read(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", 20).select("doc_id")


@query("s13_thread_states", "SELECT user_id AS id, CASE min(CASE WHEN event_type = 'error' THEN 0 WHEN event_type = 'signup' THEN 1 ELSE 2 END) WHEN 0 THEN 'resolved' WHEN 1 THEN 'outdated' ELSE 'open' END AS thread_state FROM events GROUP BY user_id")
def _(spark, sf_dir):
    from .sources.github import thread_states

    e = read(spark, sf_dir, "events")
    return thread_states(e.select(F.col("user_id").alias("comment_id"), (F.col("event_type") == "error").alias("resolved"), (F.col("event_type") == "signup").alias("outdated")))


@query("f20_sections")
def _(spark, sf_dir):
    p = html_pages(read(spark, sf_dir, "pages"))
    return p.select("url", "title", "content_hash", F.size("sections").alias("n_sections"), F.sha2(F.to_json("sections"), 256).alias("sections_sha256"))


@query("f22_markdown", """WITH x AS (SELECT 'doc://' || source || '/' || doc_id AS url, 'T ' || doc_id AS title, lang, regexp_replace(text, chr(13) || chr(10) || '|[' || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(133) || chr(8232) || chr(8233) || ']', chr(10), 'g') AS text FROM documents)
SELECT url, title, 2 AS n_sections, sha256('[{"heading":"","level":0,"text":"intro"},{"heading":"' || lang || '","level":2,"text":' || CAST(to_json(regexp_replace(regexp_replace(text, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '')) AS VARCHAR) || '}]') AS sections_sha256 FROM x""")
def _(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("doc://"), "source", F.lit("/"), "doc_id").alias("uri"), F.concat(F.lit("# T "), "doc_id", F.lit("\nintro\n## "), "lang", F.lit("\n"), "text").alias("text"))
    p = markdown_pages(d)
    return p.select("url", "title", F.size("sections").alias("n_sections"), F.sha2(F.to_json("sections"), 256).alias("sections_sha256"))


@query("s20_crawl")
def _(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    root = p.groupBy(host.alias("h")).count().orderBy(F.desc("count"), "h").first()
    cfg = site.CrawlConfig(root["h"] if root else "https://example.org", max_depth=None, max_pages=None)
    return site.crawl(p, cfg, seeds=p.select("url"))
