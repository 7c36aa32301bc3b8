"""Neighbours, provenance, paths, closures and history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.iri import local_name
from ..plans import graph as G
from ..plans.graph import Graph
from ..storage import shared_dir


def checked_iri(s: str) -> str:
    if not s.startswith(("http://", "https://")):
        raise ValueError(f"expected an absolute IRI, got: {s!r}")
    return s


def neighbors(graph: Graph, node: str, limit: int = 30) -> DataFrame:
    """(direction, predicate, predicate_iri, neighbor, label): edges in and out, literals included, card fields hidden."""
    checked_iri(node)
    t = graph.triples(s=node).select(F.lit("out").alias("direction"), "p", F.col("o").alias("neighbor")).unionByName(graph.triples(o=node).where("o_kind = 'iri'").select(F.lit("in").alias("direction"), "p", F.col("s").alias("neighbor")))
    t = t.where(~F.col("p").startswith(graph.onto("card")))
    names = graph.quads.where(F.col("p").isin(G.TITLE, G.PREF_LABEL, graph.onto("path"))).select("s", "p", "o").distinct()
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    label = names.join(t.select(F.col("neighbor").alias("s")).distinct(), "s", "left_semi").groupBy("s").agg(F.coalesce(one(G.TITLE), one(G.PREF_LABEL), one(graph.onto("path"))).alias("label"))
    out = t.join(label.withColumnRenamed("s", "neighbor"), "neighbor", "left")
    return out.select("direction", local_name(F.col("p")).alias("predicate"), F.col("p").alias("predicate_iri"), "neighbor", "label").orderBy("direction", "predicate_iri", "neighbor").limit(limit)


def provenance(graph: Graph, nodes: DataFrame) -> DataFrame:
    """(iri, title, types, derived_from, run, pipeline_ver, model, prompt_hash) for nodes (iri).

    Each part is an aggregate of its own, so independent parts don't multiply; what is missing is null or empty.
    """
    base = nodes.select("iri").distinct()
    at = lambda p, name: graph.values(p, name).withColumnRenamed("s", "iri").join(base, "iri", "left_semi")
    types = at(G.RDF_TYPE, "t").where(F.col("t").startswith(graph.cfg.namespace)).groupBy("iri").agg(F.array_sort(F.collect_set(F.substring_index("t", "#", -1))).alias("types"))
    title = at(G.TITLE, "t").groupBy("iri").agg(F.max("t").alias("title"))
    paths = graph.values(graph.onto("path"), "path").withColumnRenamed("s", "d")
    derived = at(G.DERIVED, "d").join(paths, "d", "left").groupBy("iri").agg(F.array_sort(F.collect_set(F.struct(F.col("d").alias("iri"), "path"))).alias("derived_from"))
    run = at(G.GENERATED, "run").groupBy("iri").agg(F.max("run").alias("run"))
    for p, name in (("pipelineVer", "pipeline_ver"), ("model", "model"), ("promptHash", "prompt_hash")):
        run = run.join(graph.values(graph.onto(p), name).withColumnRenamed("s", "run").groupBy("run").agg(F.max(name).alias(name)), "run", "left")
    out = base
    for part in (title, types, derived, run):
        out = out.join(part, "iri", "left")
    empty = lambda c, t: F.coalesce(F.col(c), F.array().cast(t)).alias(c)
    return out.select("iri", "title", empty("types", "array<string>"), empty("derived_from", "array<struct<iri: string, path: string>>"), "run", "pipeline_ver", "model", "prompt_hash")


def two_way(edges: DataFrame) -> DataFrame:
    """(node, predicate, direction, next): edges both ways, between absolute IRIs."""
    e = edges.where(F.col("src").startswith("http") & F.col("dst").startswith("http"))
    out = e.select(F.col("src").alias("node"), F.col("pred").alias("predicate"), F.lit("out").alias("direction"), F.col("dst").alias("next"))
    return out.unionByName(e.select(F.col("dst").alias("node"), F.col("pred").alias("predicate"), F.lit("in").alias("direction"), F.col("src").alias("next")))


def _cut(df: DataFrame) -> DataFrame:
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def reached(edges: DataFrame, start: str, max_len: int = 4, goal: str | None = None, degree_cap: int | None = None) -> DataFrame:
    """(node, hops, parent, predicate, direction): nodes within max_len hops, each with its first parent.

    A hop is one join of the whole frontier. Of several parents the least (direction, predicate, node) is
    kept, by an aggregate. A hop's result is checkpointed, so lineage and recovery don't grow with hops.
    degree_cap: expand only the first edges of a node, as the one-node-at-a-time tool does.
    """
    spark = edges.sparkSession
    both = two_way(edges)
    if degree_cap is not None:
        from pyspark.sql import Window as W

        both = both.withColumn("_n", F.row_number().over(W.partitionBy("node").orderBy("direction", "predicate", "next"))).where(F.col("_n") <= degree_cap).drop("_n")
    seen = spark.createDataFrame([(start, 0, None, None, None)], "node string, hops int, parent string, predicate string, direction string")
    frontier = seen
    for hop in range(1, max_len + 1):
        step = both.join(frontier.select("node"), "node").where(F.col("next") != F.col("node"))
        step = step.groupBy("next").agg(F.min(F.struct("direction", "predicate", "node")).alias("x")).withColumnRenamed("next", "_to")
        new = step.join(seen.select(F.col("node").alias("_to")), "_to", "left_anti").select(F.col("_to").alias("node"), F.lit(hop).alias("hops"), F.col("x.node").alias("parent"), F.col("x.predicate").alias("predicate"), F.col("x.direction").alias("direction"))
        frontier = _cut(new)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if goal is not None and not frontier.where(F.col("node") == goal).isEmpty():
            break
    return seen


def path(graph: Graph, start: str, goal: str, max_len: int = 4, degree_cap: int | None = None) -> DataFrame:
    """(step, predicate, direction, node) of a shortest path, or no rows; a node isn't reachable from itself."""
    checked_iri(start), checked_iri(goal)
    spark = graph.quads.sparkSession
    schema = "step int, predicate string, direction string, node string"
    if start == goal:
        return spark.createDataFrame([], schema)
    seen = reached(graph.edges, start, max_len, goal, degree_cap)
    steps, at = [], goal
    while at != start and len(steps) <= max_len:  # max_len lookups of one row
        row = seen.where(F.col("node") == at).first()
        if row is None:
            return spark.createDataFrame([], schema)
        steps.append((row["hops"], row["predicate"], row["direction"], at))
        at = row["parent"]
    return spark.createDataFrame(steps[::-1], schema).withColumn("predicate", local_name(F.col("predicate")))


def closure(edges: DataFrame, pred: str, starts: DataFrame) -> DataFrame:
    """(src, dst): all pairs connected by one or more steps of a predicate, from starts (src).

    Semi-naive: a round joins only the pairs that the last one found, and writes only those that it finds itself. It
    ends when a round finds none, as one must: there are finitely many pairs, and each round's are new.
    """
    e = _cut(edges.where(F.col("pred") == pred).select("src", "dst").distinct())
    new = _cut(e.join(starts.select("src").distinct(), "src", "left_semi"))
    found = new
    while True:
        step = new.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = _cut(step.join(found, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return found
        found = found.unionByName(new)


def derived_from_docs(graph: Graph) -> int:
    """Distinct learnings that reach a document by derivation."""
    c = closure(graph.edges, G.DERIVED, graph.instances("Learning").select(F.col("s").alias("src")))
    return c.join(graph.instances("Doc").select(F.col("s").alias("dst")), "dst", "left_semi").select("src").distinct().count()


def as_datetime(s: str) -> str:
    return s if "T" in s else s + "T00:00:00Z"


def history(graph: Graph, repo: str, branch: str | None = None, since: str | None = None, until: str | None = None, pr: int | None = None, kind: str | None = None, limit: int = 100, by_instant: bool = False) -> DataFrame:
    """(type, iri, title, sha, number, state, base_ref, date): commits and pull requests of a repository.

    Commits need a date; pulls of any state, those without a merge date only if no bound is given. Merged by the
    date's text, latest first, as the tool always had it; by_instant: by the instant, whatever its offset.
    """
    at = lambda p, name: graph.values(p, name)
    per = lambda p, name: graph.spread(at(p, name), "s")
    repos = at(graph.onto("sourceId"), "slug").where(F.col("slug") == repo).select(F.col("s").alias("repo"))
    own = graph.where(graph.onto("partOf")).select("s", F.col("o").alias("repo")).join(repos, "repo").transform(graph.spread, "s")
    at_least = F.to_timestamp(F.lit(as_datetime(since))) if since is not None else None
    at_most = F.to_timestamp(F.lit(as_datetime(until))) if until is not None else None

    def within(df: DataFrame) -> DataFrame:
        df = df if at_least is None else df.where(F.to_timestamp("date") >= at_least)
        return df if at_most is None else df.where(F.to_timestamp("date") <= at_most)

    cols = "type string, iri string, title string, sha string, number long, state string, base_ref string, date string"
    legs = []
    if kind in (None, "commit"):
        c = graph.spread(graph.instances("Commit").select("s"), "s").join(own, "s").join(per(G.CREATED, "date"), "s")
        if branch:
            c = c.join(at(graph.onto("historyBranch"), "b").where(F.col("b") == branch).select(F.col("s").alias("repo")), "repo")
        c = within(c).join(per(G.TITLE, "title"), "s", "left").join(per(graph.onto("sourceId"), "sha"), "s", "left")
        legs.append(c.selectExpr("'Commit' type", "s iri", "coalesce(title, '') title", "sha", "cast(null as long) number", "cast(null as string) state", "cast(null as string) base_ref", "date").orderBy(F.desc(F.to_timestamp("date")), "iri").limit(limit))
    if kind in (None, "pr"):
        p = graph.spread(graph.instances("PullRequest").select("s"), "s").join(own, "s")
        for name, col in ((G.TITLE, "title"), (graph.onto("number"), "number"), (graph.onto("state"), "state"), (graph.onto("mergedAt"), "date"), (graph.onto("baseRefName"), "base_ref")):
            p = p.join(per(name, col), "s", "left")
        p = p.withColumn("number", F.col("number").cast("long"))
        if pr is not None:
            p = p.where(F.col("number") == pr)
        if branch:
            p = p.where(F.col("base_ref") == branch)
        p = within(p)
        legs.append(p.selectExpr("'PullRequest' type", "s iri", "coalesce(title, '') title", "cast(null as string) sha", "number", "state", "base_ref", "date").orderBy(F.desc("number"), "iri").limit(limit))
    if not legs:
        return graph.quads.sparkSession.createDataFrame([], cols)
    out = legs[0] if len(legs) == 1 else legs[0].unionByName(legs[1])
    key = F.to_timestamp("date") if by_instant else F.col("date")
    return out.orderBy(key.desc_nulls_last(), "iri").limit(limit)


__all__ = ["checked_iri", "closure", "derived_from_docs", "history", "neighbors", "path", "provenance", "reached"]
