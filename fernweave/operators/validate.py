"""Shape checks over the graph with its class and property inference, as joins over a table of constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import graph as G
from ..plans.construct import DATETIME, INTEGER, STRING
from ..plans.graph import Graph

#: Fixed values of the vocabulary: subclass edges, and what a property says of its subject or object.
SUBCLASS = {
    "Doc": "File",
    "BotAgent": "Person",
    "Technology": "Topic",
    "Pattern": "Topic",
    "FailureClass": "Topic",
    "Learning": "SemanticNode",
    "Decision": "SemanticNode",
    "Constraint": "SemanticNode",
    "FailureMode": "SemanticNode",
    "Observation": "SemanticNode",
    "Verification": "SemanticNode",
    "PlanningNote": "SemanticNode",
    "ImplementationNote": "SemanticNode",
}
DOMAIN = {
    "pipelineVer": "ExtractionRun",
    "promptHash": "ExtractionRun",
    "model": "ExtractionRun",
    "notes": "ExtractionRun",
    "historyBranch": "Repo",
    "isDefaultBranch": "Repo",
    "snapshotRef": "Repo",
    "baseRefName": "PullRequest",
    "mergedAt": "PullRequest",
    "mergeCommit": "PullRequest",
    "ofNode": "Chunk",
    "ordinal": "Chunk",
    "reviewerLogin": "Verification",
    "reviewerKind": "Verification",
    "severity": "Verification",
    "reviewFilePath": "Verification",
    "reviewLine": "Verification",
    "commitId": "Verification",
    "originalCommitId": "Verification",
    "threadState": "Verification",
    "reviewState": "Verification",
}
RANGE = {"mergeCommit": "Commit"}

#: Fixed values of the shapes: (classes, or the predicate that makes a target; path; least; most; kind of node, datatype, class, values; message).
SHAPES = (
    ("Learning Decision Constraint FailureMode Observation Verification PlanningNote ImplementationNote", G.DERIVED, 1, None, "iri", None, None, None, "semantic node must anchor to >=1 spine node (prov:wasDerivedFrom)"),
    ("Learning Decision Constraint FailureMode Observation Verification PlanningNote ImplementationNote", G.GENERATED, 1, 1, None, None, "ExtractionRun", None, "semantic node must name exactly one kg:ExtractionRun (prov:wasGeneratedBy)"),
    ("Learning", G.TITLE, 1, None, None, STRING, None, None, "learning must have a dcterms:title"),
    ("Learning", "priority", None, 1, None, None, None, ("P0", "P1", "P2", "P3"), "priority, if present, must be one of P0..P3"),
    ("ExtractionRun", "pipelineVer", 1, None, None, STRING, None, None, ""),
    ("ExtractionRun", "model", 1, None, None, STRING, None, None, ""),
    ("ExtractionRun", "promptHash", 1, None, None, STRING, None, None, ""),
    ("Chunk", "ofNode", 1, 1, "iri", None, None, None, ""),
    ("Chunk", "text", 1, None, None, STRING, None, None, ""),
    ("DocSite", "rootUrl", 1, None, None, STRING, None, None, ""),
    ("DocSite", G.TITLE, 1, None, None, STRING, None, None, ""),
    ("DocSite", G.MODIFIED, 1, None, None, DATETIME, None, None, ""),
    ("DocSite", "documentsBranch", None, 1, None, STRING, None, None, ""),
    ("DocPage", "url", 1, None, None, STRING, None, None, ""),
    ("DocPage", G.TITLE, 1, None, None, STRING, None, None, ""),
    ("DocPage", "contentHash", 1, None, None, STRING, None, None, ""),
    ("DocPage", "partOf", 1, None, "iri", None, None, None, ""),
    ("DocPage", G.MODIFIED, 1, None, None, DATETIME, None, None, ""),
    ("DocSection", "heading", 1, None, None, STRING, None, None, ""),
    ("DocSection", "level", 1, None, None, INTEGER, None, None, ""),
    ("DocSection", "anchor", 1, None, None, STRING, None, None, ""),
    ("DocSection", "text", 1, None, None, STRING, None, None, ""),
    ("DocSection", "partOf", 1, None, "iri", None, None, None, ""),
    (">about", G.TITLE, 1, None, None, None, None, None, "PR comment node must have dcterms:title"),
    (">about", "about", 1, None, "iri", None, None, None, "PR comment node must link to its PullRequest via kg:about"),
    (">about", G.CREATED, 1, None, None, None, None, None, "PR comment node must have dcterms:created"),
    ("PlanningNote", G.TITLE, 1, None, None, STRING, None, None, "planning note must have a dcterms:title"),
    ("ImplementationNote", G.TITLE, 1, None, None, STRING, None, None, "implementation note must have a dcterms:title"),
    ("McpSource", "mcpServer", 1, None, None, STRING, None, None, ""),
    ("McpSource", G.TITLE, 1, None, None, STRING, None, None, ""),
    ("McpSource", G.MODIFIED, 1, None, None, DATETIME, None, None, ""),
)


def ancestors(name: str) -> list[str]:
    out = [name]
    while out[-1] in SUBCLASS:
        out.append(SUBCLASS[out[-1]])
    return out


def inferred_types(graph: Graph) -> DataFrame:
    """(iri, type): stated types, those that properties imply, and all their superclasses, by local name.

    The vocabulary is a few dozen constants: they are a map in the plan, not a join.
    """
    name = lambda c: F.when(F.col(c).startswith(graph.cfg.onto), F.substr(F.col(c), F.lit(len(graph.cfg.onto) + 1)))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    stated = graph.quads.where(F.col("p") == G.RDF_TYPE).select(F.col("s").alias("iri"), name("o").alias("type"))
    own = graph.quads.where(F.col("p").isin([graph.onto(x) for x in DOMAIN]))
    by_domain = own.select(F.col("s").alias("iri"), table(DOMAIN)[name("p")].alias("type"))
    by_range = graph.quads.where(F.col("p").isin([graph.onto(x) for x in RANGE])).select(F.col("o").alias("iri"), table(RANGE)[name("p")].alias("type"))
    up = F.create_map(*[x for k in SUBCLASS for x in (F.lit(k), F.array(*[F.lit(a) for a in ancestors(k)]))])
    t = stated.unionByName(by_domain).unionByName(by_range).where("type is not null")
    return t.select("iri", F.explode(F.coalesce(up[F.col("type")], F.array("type"))).alias("type")).distinct()


def violations(graph: Graph) -> DataFrame:
    """(focus, path, component, message): a row for each constraint that a node breaks.

    All constraints are one pass: targets are exploded to their constraints (a map in the plan), joined once
    with the values of those properties, and grouped by node and constraint.
    """
    spark = graph.quads.sparkSession
    full = lambda p: p if p.startswith("http") else graph.onto(p)
    rules = [(i, targets, full(p), low, high, kind, dt, cls, list(vals) if vals else None, msg) for i, (targets, p, low, high, kind, dt, cls, vals, msg) in enumerate(SHAPES)]
    types = inferred_types(graph)
    by_class: dict[str, list[int]] = {}
    for i, targets, *_ in rules:
        for t in targets.split():
            by_class.setdefault(t, []).append(i)
    of_class = F.create_map(*[x for k, v in by_class.items() if k[0] != ">" for x in (F.lit(k), F.array(*map(F.lit, v)))])
    targets = types.select("iri", F.explode(of_class[F.col("type")]).alias("rule"))
    for k, v in by_class.items():
        if k[0] == ">":
            subjects = graph.quads.where(F.col("p") == full(k[1:])).select(F.col("s").alias("iri")).distinct()
            targets = targets.unionByName(subjects.select("iri", F.explode(F.array(*map(F.lit, v))).alias("rule")))
    targets = targets.distinct()
    table = spark.createDataFrame([(i, p, low, high, kind, dt, cls, vals, msg) for i, _, p, low, high, kind, dt, cls, vals, msg in rules], "rule int, p string, low int, high int, kind string, dt string, cls string, vals array<string>, message string")
    want = targets.join(F.broadcast(table), "rule")  # a constant number of rows
    have = graph.quads.where(F.col("p").isin(sorted({r[2] for r in rules}))).select(F.col("s").alias("iri"), "p", "o", "o_kind", "o_dt").distinct()
    runs = types.where("type = 'ExtractionRun'").select(F.col("iri").alias("o"), F.lit(True).alias("is_run"))
    have = have.join(runs, "o", "left")
    rows = want.join(have, ["iri", "p"], "left")
    there = F.col("o").isNotNull()
    dt = F.coalesce("o_dt", F.lit(STRING))  # a plain literal is a string
    bad = lambda test, cond: F.count_if(there & cond & ~F.coalesce(test, F.lit(False)))
    n = rows.groupBy("iri", "rule", "p", "low", "high", "message").agg(
        F.count_if(there).alias("n"),
        bad(F.col("o_kind") == F.col("kind"), F.col("kind").isNotNull()).alias("NodeKind"),
        bad((F.col("o_kind") == "literal") & (dt == F.col("dt")), F.col("dt").isNotNull()).alias("Datatype"),
        bad(F.col("is_run"), F.col("cls").isNotNull()).alias("Class"),
        bad((dt == STRING) & F.array_contains("vals", F.col("o")), F.col("vals").isNotNull()).alias("In"),
    )
    tests = [("MinCount", F.col("n") < F.col("low")), ("MaxCount", F.col("n") > F.col("high")), *[(c, F.col(c) > 0) for c in ("NodeKind", "Datatype", "Class", "In")]]
    found = F.filter(F.array(*[F.when(t, F.lit(c)) for c, t in tests]), lambda x: x.isNotNull())
    return n.select(F.col("iri").alias("focus"), F.col("p").alias("path"), F.explode(found).alias("component"), "message")


def conforms(graph: Graph) -> bool:
    return violations(graph).isEmpty()
