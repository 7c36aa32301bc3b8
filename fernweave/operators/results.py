"""The seven tools as dictionaries: thin forms of the plans, with null fields left out where they may be absent."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.graph import Graph
from . import explore, search
from .embed import Embedder, embed_query

BACKEND = "spark"


def records(df: DataFrame) -> list[dict]:
    """The rows of a limited result."""
    return [r.asDict(recursive=True) for r in df.collect()]


def kg_search(graph: Graph, term: str, limit: int = 10) -> dict:
    rows = records(search.lexical(graph, term, limit))
    return {"term": term, "backend": BACKEND, "count": len(rows), "results": rows}


def kg_semantic_search(index: tuple[DataFrame, DataFrame, dict] | None, embedder: Embedder | None, query: str, limit: int = 10) -> dict:
    if index is None or embedder is None:
        return {"query": query, "error": "no vector index", "count": 0, "results": []}
    rows = [r | {"score": round(r["score"], 4)} for r in records(search.vector_topk(index[0], embed_query(query, embedder), limit, index[1]))]
    return {"query": query, "model": index[2].get("model"), "count": len(rows), "results": rows}


def kg_hybrid_search(graph: Graph, index: tuple[DataFrame, DataFrame, dict] | None, embedder: Embedder | None, query: str, limit: int = 10) -> dict:
    more = {"vectors": index[0], "cards": index[1], "embedding": embed_query(query, embedder)} if index is not None and embedder is not None else {}
    rows = [{k: v for k, v in r.items() if k != "degraded"} | {"score": round(r["score"], 4)} for r in records(search.hybrid(graph, query, limit, **more))]
    return {"query": query, "count": len(rows), "degraded": not more, "results": rows}


def kg_neighbors(graph: Graph, iri: str, limit: int = 30) -> dict:
    rows = records(explore.neighbors(graph, iri, limit))
    return {"node": iri, "backend": BACKEND, "count": len(rows), "edges": rows}


def kg_provenance(graph: Graph, iri: str) -> dict:
    df = graph.quads.sparkSession.createDataFrame([(explore.checked_iri(iri),)], "iri string")
    r = records(explore.provenance(graph, df))[0]
    run = {k: r[k] for k in ("run", "pipeline_ver", "model", "prompt_hash")} if r["run"] else None
    return {"node": iri, "backend": BACKEND, "title": r["title"], "types": r["types"], "derived_from": r["derived_from"], "generated_by": run}


def kg_path(graph: Graph, start: str, goal: str, max_len: int = 4) -> dict:
    steps = [{k: s[k] for k in ("predicate", "direction", "node")} for s in records(explore.path(graph, start, goal, max_len).orderBy("step"))]
    return {"from": start, "to": goal, "backend": BACKEND, "reachable": bool(steps), "length": len(steps) or None, "path": steps}


def kg_repo_history(graph: Graph, repo: str, limit: int = 100, **filters) -> dict:
    rows = [{k: v for k, v in r.items() if v is not None} for r in records(explore.history(graph, repo, limit=limit, **filters))]
    return {"repo": repo, "backend": BACKEND, "count": len(rows), "results": rows}


def tools(graph: Graph, index: tuple[DataFrame, DataFrame, dict] | None = None, embedder: Embedder | None = None) -> dict:
    """The tools by name, over one graph and index."""
    return {
        "kg_search": lambda **a: kg_search(graph, **a),
        "kg_semantic_search": lambda **a: kg_semantic_search(index, embedder, **a),
        "kg_hybrid_search": lambda **a: kg_hybrid_search(graph, index, embedder, **a),
        "kg_neighbors": lambda **a: kg_neighbors(graph, **a),
        "kg_provenance": lambda **a: kg_provenance(graph, **a),
        "kg_path": lambda **a: kg_path(graph, **a),
        "kg_repo_history": lambda **a: kg_repo_history(graph, **a),
    }


__all__ = ["tools"]
