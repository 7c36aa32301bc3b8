"""Keyword, vector and hybrid search, each one lazy plan."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.iri import local_name
from ..plans import graph as G
from ..plans.graph import Graph

#: Fixed values.
RRF_K, BOOST, TITLE_MATCH = 60, 1.0, "(title match)"
EXACT_ID = re.compile(r"\b[A-Z]{2,}-\d+\b|\b[A-Z0-9]+_[A-Z0-9_]+\b")
SEMANTIC = ("Learning", "Decision", "ImplementationNote", "PlanningNote")
BY_TITLE = ("PullRequest", "Repo")


def term_of(text: str) -> str:
    """A search term: lower case, line ends as blanks."""
    return text.lower().replace("\n", " ").replace("\r", " ")


def matches(graph: Graph, term: Column | str, pages: DataFrame | None = None) -> DataFrame:
    """(iri, type, title, matched): a row for each node and topic label or title that holds the term.

    Filters run before the joins: titles and labels are tested where they are read.
    """
    t = F.lit(term_of(term)) if isinstance(term, str) else term
    titles = graph.values(G.TITLE, "title")
    nodes = graph.instances(*SEMANTIC).join(titles, "s")
    tags = graph.where(graph.onto("tagged")).select("s", F.col("o").alias("topic")).join(graph.values(G.PREF_LABEL, "label").withColumnRenamed("s", "topic"), "topic").select("s", "label")
    rows = nodes.join(tags, "s", "left")
    found = F.when(F.contains(F.lower("label"), t), F.col("label")).when(F.contains(F.lower("title"), t), TITLE_MATCH)
    tagged = rows.withColumn("matched", found).where("matched is not null").select("s", "type", "title", "matched")
    titled = graph.instances(*BY_TITLE).join(titles, "s").where(F.contains(F.lower("title"), t)).select("s", "type", "title", F.lit(TITLE_MATCH).alias("matched"))
    return tagged.unionByName(titled).withColumnRenamed("s", "iri").distinct()


def lexical(graph: Graph, term: str, limit: int | None = 10, row_cap: bool = True) -> DataFrame:
    """(iri, type, title, category, priority, fix, matched_topics), the first `limit` by iri, or all (None).

    row_cap: rows are cut at six times the limit before they are folded to nodes, as the tool always
    had it (a node with many matching labels can push others out); without it every match counts.
    """
    rows = matches(graph, term)
    for p in ("category", "priority", "fix"):
        rows = rows.join(graph.values(graph.onto(p), p).withColumnRenamed("s", "iri"), "iri", "left")
    rows = rows.distinct()
    if row_cap and limit is not None:
        rows = rows.orderBy("iri", "type", "title", "category", "priority", "fix", "matched").limit(limit * 6)
    first = F.min(F.struct("type", "title", "category", "priority", "fix")).alias("x")
    out = rows.groupBy("iri").agg(first, F.array_sort(F.collect_set("matched")).alias("matched_topics"))
    fix = F.when(F.col("x.fix") != "", F.substring("x.fix", 1, 400))
    out = out.select("iri", local_name(F.col("x.type")).alias("type"), "x.title", "x.category", "x.priority", fix.alias("fix"), "matched_topics")
    return out if limit is None else out.orderBy("iri").limit(limit)


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles, within generated code."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Sequence[float]) -> list[float]:
    n = sum(float(x) * float(x) for x in v) ** 0.5 + 1e-12
    return [float(x) / n for x in v]


#: Cards as a table, or as a function that makes those of the nodes (iri) it is given.
Cards = DataFrame | Callable[[DataFrame], DataFrame]


def cards_of(cards: Cards, nodes: DataFrame) -> DataFrame:
    return cards(nodes.select("iri")) if callable(cards) else cards


def vector_topk(vectors: DataFrame, query: Sequence[float], limit: int = 10, cards: Cards | None = None) -> DataFrame:
    """(iri, score) of the nearest vectors by cosine, equal scores by iri; with cards also type, title and snippet."""
    q = F.array(*[F.lit(x) for x in normalised(query)])
    top = vectors.select("iri", dot(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), "iri").limit(limit)
    if cards is None:
        return top
    return top.join(cards_of(cards, top).select("iri", "type", "title", "snippet"), "iri", "left").orderBy(F.desc("score"), "iri")


def vector_grouped(vectors: DataFrame, cards: Cards, query: Sequence[float], limit: int = 10) -> DataFrame:
    """The same where a node may have several vectors: its best score, equal scores by iri."""
    q = F.array(*[F.lit(x) for x in normalised(query)])
    best = vectors.groupBy("iri").agg(F.max(dot(F.col("embedding"), q)).alias("score")).orderBy(F.desc("score"), "iri").limit(limit)
    fields = cards_of(cards, best).groupBy("iri").agg(F.min("type").alias("type"), F.min("title").alias("title"), F.min("snippet").alias("snippet"))
    return best.join(fields, "iri", "left").orderBy(F.desc("score"), "iri")


def exact_ids(query: str) -> list[str]:
    return EXACT_ID.findall(query)


def boost(query: str, text: Column) -> Column:
    """BOOST once if an id that the query names occurs in the text as a whole token."""
    ids = [re.escape(t.upper()) for t in exact_ids(query)]
    return F.when(F.upper(text).rlike(r"\b(?:" + "|".join(ids) + r")\b"), F.lit(BOOST)).otherwise(F.lit(0.0)) if ids else F.lit(0.0)


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """rank0: places from 0. df is a limited leg, so that one task orders a few rows."""
    return df.withColumn("rank0", F.row_number().over(W.orderBy(*order)) - 1)


def fused(lex: DataFrame, sem: DataFrame | None, query: str, limit: int = 10) -> DataFrame:
    """Reciprocal rank fusion of legs (iri, type, title, snippet, rank0); the semantic leg's fields win."""
    legs = lex.select("iri", "type", "title", "snippet", "rank0", F.lit("lexical").alias("leg"), F.lit(1).alias("pri"))
    if sem is not None:
        legs = legs.unionByName(sem.select("iri", "type", "title", "snippet", "rank0", F.lit("semantic").alias("leg"), F.lit(0).alias("pri")))
    pick = lambda c: F.min_by(c, F.when(F.col(c) != "", F.col("pri")))  # noqa: E731  the first leg's value that isn't empty
    out = legs.groupBy("iri").agg(pick("type").alias("type"), F.coalesce(pick("title"), F.lit("")).alias("title"), F.coalesce(pick("snippet"), F.lit("")).alias("snippet"), F.sum(F.lit(1.0) / (F.lit(RRF_K + 1) + F.col("rank0"))).alias("rrf"), F.array_sort(F.collect_set("leg")).alias("matched_by"))
    out = out.withColumn("score", F.col("rrf") + boost(query, F.concat("iri", F.lit(" "), "title"))).drop("rrf")
    return out.withColumn("degraded", F.lit(sem is None)).orderBy(F.desc("score"), "iri").limit(limit)


def hybrid(graph: Graph, query: str, limit: int = 10, vectors: DataFrame | None = None, cards: Cards | None = None, embedding: Sequence[float] | None = None, row_cap: bool = True) -> DataFrame:
    """Both legs, `limit` each, and their fusion as one plan. Without an index the result is degraded, not an error."""
    lex = ranked(lexical(graph, query, limit, row_cap).withColumnRenamed("fix", "snippet"), "iri")
    sem = None
    if vectors is not None and embedding is not None:
        top = vector_topk(vectors, embedding, limit, cards) if cards is not None else vector_topk(vectors, embedding, limit).selectExpr("iri", "score", "string(null) type", "'' title", "'' snippet")
        sem = ranked(top, F.desc("score"), "iri")
    return fused(lex, sem, query, limit)


def hybrid_tied(lex: DataFrame, sem: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The fusion in which equal scores share the larger rank. lex (iri, title), sem (iri, title, score).

    The self-join that counts rows at least as good is a running count over a peer range.
    """
    s = sem.select("iri", "title", F.count("*").over(W.orderBy(F.desc("score"))).alias("n"), F.lit("semantic").alias("leg"))
    x = lex.select("iri", "title", F.count("*").over(W.orderBy("iri")).alias("n"), F.lit("lexical").alias("leg"))
    out = s.unionByName(x).groupBy("iri").agg(F.sum(F.lit(1.0) / (F.lit(RRF_K) + F.col("n"))).alias("rrf"), F.min("title").alias("title"), F.array_join(F.array_sort(F.collect_set("leg")), ",").alias("matched"))
    return out.select("iri", "title", "matched", (F.col("rrf") + boost(query, F.concat("iri", F.lit(" "), "title"))).alias("score")).orderBy(F.desc("score"), "iri").limit(limit)


def preflight(graph: Graph, terms: Sequence[str], per_term: int = 5, limit: int = 5) -> DataFrame:
    """(iri, title, type, priority, n_terms): keyword hits of several terms, by terms hit, then priority, then iri."""
    each = [lexical(graph, t, per_term).select("iri", "title", "type", "priority", F.lit(t).alias("term")) for t in terms]
    rows = reduce(DataFrame.unionByName, each)
    out = rows.groupBy("iri").agg(F.min("title").alias("title"), F.min("type").alias("type"), F.min("priority").alias("priority"), F.count_distinct("term").alias("n_terms"))
    return out.orderBy(F.desc("n_terms"), F.coalesce("priority", F.lit("P9")), "iri").limit(limit)


def preflight_markdown(rows: DataFrame) -> str:
    """A short report of preflight rows (their limit is the caller's)."""
    found = [f"- **{r['title']}** ({r['type']}{', ' + r['priority'] if r['priority'] else ''}) — {r['iri']}" for r in rows.toLocalIterator()]
    return "\n".join(["## Related knowledge", *(found or ["Nothing found."])]) + "\n"
