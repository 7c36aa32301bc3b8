"""Commands over a stored graph: `python -m fernweave search ...`, `build ...`, `guard ...`."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import server
from .build import Build, counts_at, publish, write_results
from .config import configured, paths
from .operators import explore, guard, search, snapshot
from .operators.cards import build_cards
from .operators.embed import HashingEmbedder, embed_query, read_index, write_index
from .plans.graph import Graph
from .sources import manifest, ntriples

COMMANDS = ("search", "path", "history", "build", "refresh", "digest", "parts", "materialise", "embed", "guard", "check", "preflight", "serve")


def session(name: str = "fernweave") -> SparkSession:
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()


def shown(rows: DataFrame, as_json: bool) -> str:
    """Limited rows as JSON lines or a short list; null fields are left out."""
    out = []
    for r in rows.toLocalIterator():
        d = {k: v for k, v in r.asDict(recursive=True).items() if v is not None}
        out.append(json.dumps(d, ensure_ascii=False, default=str) if as_json else " | ".join(f"{v}" for v in d.values()))
    return "\n".join(out)


def find(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    g = ntriples.open_graph(spark, a.graph, a.format)
    if a.neighbors:
        return explore.neighbors(g, a.term, a.limit)
    if a.provenance:
        return explore.provenance(g, spark.createDataFrame([(explore.checked_iri(a.term),)], "iri string"))
    index = read_index(spark, a.vectors) if a.semantic or a.hybrid else None
    e = HashingEmbedder(index[2]["dim"]) if index else None
    if a.semantic:
        if index is None:
            return spark.createDataFrame([(f"no index in {a.vectors}",)], "error string")
        return search.vector_topk(index[0], embed_query(a.term, e), a.limit, index[1])
    if a.hybrid:
        more = {"vectors": index[0], "cards": index[1], "embedding": embed_query(a.term, e)} if index else {}
        return search.hybrid(g, a.term, a.limit, **more).withColumn("score", F.round("score", 4))
    return search.lexical(g, a.term, a.limit)


def build(spark: SparkSession, a: argparse.Namespace) -> tuple[Build, Graph]:
    """A graph of a manifest's sources, or of those that are named; written, with each source's result beside it."""
    m = manifest.load(a.manifest) if a.manifest else {}
    if found := manifest.problems(m):
        raise SystemExit("\n".join(found))
    b = Build(spark, m, a.landed, ntriples.prior_graph(spark, a.graph, configured(m)))
    try:
        g = b.all(a.repo, a.slug, a.tracker, a.repos_root, a.max_commits)
        ntriples.write_quads(g, a.graph + ".new")  # the graph before may be read by the plan
        b.prior = None
        ntriples.write_quads(ntriples.read_quads(spark, a.graph + ".new", b.cfg), a.graph)
    except Exception as e:
        b.results.append({"source": "all", "kind": "build", "status": "failed", "reason": str(e)[:300], "counts": {}})
        raise
    finally:
        write_results(a.results or a.graph.rstrip("/") + ".sources.json", b.results)
    return b, ntriples.read_quads(spark, a.graph, b.cfg)


def refresh(spark: SparkSession, a: argparse.Namespace) -> int:
    """A build, its checks and the guard against what was published before; one line of figures."""
    began = time.time()
    b, g = build(spark, a)
    failed = sum(r["status"] == "failed" and r["kind"] == "pulls" for r in b.results)
    complete = guard.comments_complete(failed, sum(r["kind"] == "pulls" for r in b.results), any("rate limit" in r.get("reason", "").lower() for r in b.results))
    out = publish(spark, g, a.parts, a.vectors, a.previous, a.issue_count, began=began)
    print(json.dumps(out | {"sources": b.results, "complete": complete}))
    if out["guard"] and out["guard"]["verdict"] == "refuse":
        return guard.REFUSE
    return int(b.failed() or not complete or out["violations"] > 0)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fernweave")
    sub = p.add_subparsers(dest="command", required=True)
    where = paths()

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--graph", default=where.graph)
        c.add_argument("--format", default="parquet")
        c.add_argument("--vectors", default=where.vectors)
        c.add_argument("--json", action="store_true")
        c.add_argument("--limit", type=int, default=10)
        return c

    s = command("search")
    s.add_argument("term")
    for x in ("semantic", "hybrid", "neighbors", "provenance"):
        s.add_argument(f"--{x}", action="store_true")
    x = command("path")
    x.add_argument("start")
    x.add_argument("goal")
    x.add_argument("--max-len", type=int, default=4)
    h = command("history")
    h.add_argument("repo")
    for o in ("branch", "since", "until", "kind"):
        h.add_argument(f"--{o}")
    h.add_argument("--pr", type=int)
    for name in ("build", "refresh"):
        b = command(name)
        for o in ("manifest", "repo", "slug", "tracker", "landed", "repos-root", "results"):
            b.add_argument(f"--{o}")
        b.add_argument("--max-commits", type=int, help="newest ones only; all by default")
    b.add_argument("--parts", default=os.path.join(os.path.dirname(where.graph) or ".", "parts"))
    b.add_argument("--previous", help="parts before: a folder, or <ref>:<path>")
    b.add_argument("--issue-count", type=int, default=0)
    command("digest")
    command("embed")
    command("parts").add_argument("folder")
    command("materialise").add_argument("folder")
    command("check").add_argument("manifest")
    command("preflight").add_argument("terms", nargs="+")
    command("serve").add_argument("--port", type=int, help="HTTP; without it requests are lines on stdin")
    g = command("guard")
    g.add_argument("previous")
    g.add_argument("new")
    g.add_argument("--issue-count", type=int, default=0)
    g.add_argument("--threshold", type=float, default=guard.THRESHOLD)
    return p


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if argv and argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv = ["search", *argv]  # a bare term is searched for
    a = parser().parse_args(argv)
    if a.command == "check":
        found = manifest.problems(manifest.load(a.manifest))
        print("\n".join(found) or "ok")
        return int(bool(found))
    spark = session()
    if a.command == "search":
        print(shown(find(spark, a), a.json))
    elif a.command == "build":
        b, g = build(spark, a)
        print(json.dumps({"quads": g.quads.count(), "sources": b.results}))
        return int(b.failed())
    elif a.command == "refresh":
        return refresh(spark, a)
    elif a.command == "serve":
        own = server.loaded(spark, a.graph, a.vectors, a.format)
        server.http_server(own, a.port).serve_forever() if a.port else server.serve_lines(own)
    elif a.command == "materialise":
        print(ntriples.materialise(spark, a.folder, a.graph))
    elif a.command == "guard":
        v = guard.verdict(guard.evaluate(counts_at(spark, a.previous), counts_at(spark, a.new), a.issue_count, a.threshold), a.issue_count, a.threshold)
        print(guard.render(v, a.json))
        return guard.exit_code(v)
    else:
        g = ntriples.open_graph(spark, a.graph, a.format)
        if a.command == "path":
            print(shown(explore.path(g, a.start, a.goal, a.max_len), a.json))
        elif a.command == "history":
            print(shown(explore.history(g, a.repo, a.branch, a.since, a.until, a.pr, a.kind, a.limit), a.json))
        elif a.command == "digest":
            print(snapshot.digest(g))
        elif a.command == "parts":
            print(json.dumps(snapshot.export_parts(g, a.folder)))
        elif a.command == "preflight":
            print(search.preflight_markdown(search.preflight(g, a.terms)))
        elif a.command == "embed":
            print(json.dumps({"written": write_index(build_cards(g), a.vectors, HashingEmbedder(), ntriples.stamp_of(g) or "")}))
    return 0
