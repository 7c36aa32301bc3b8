"""Search, exploration, cards, checks and snapshots on a small graph."""

import os

import pytest
from pyspark.sql import functions as F

from fernweave.config import GraphConfig
from fernweave.model import QUAD
from fernweave.operators import aggregates, explore, guard, search, snapshot, validate
from fernweave.operators.cards import build_cards
from fernweave.operators.embed import HashingEmbedder, embed_cards, embed_query, read_index, same_stamp, write_index
from fernweave.plans import graph as G
from fernweave.plans.construct import DATETIME, INTEGER, STRING
from fernweave.plans.graph import Graph
from fernweave.sources import ntriples

C = GraphConfig()
R, O = C.resource, C.onto  # noqa: E741
L1, L2, D1, N1, P1, REPO, DOC, RUN, T1, T2 = (R + x for x in ("learning/1", "learning/2", "decision/1", "note/1", "pr/1", "repo/x", "doc/1", "run/r", "topic/retry", "topic/cache"))


@pytest.fixture(scope="module")
def graph(spark):
    i, lit = lambda s, p, o: (s, p, o, "iri", None), lambda s, p, o, dt=None: (s, p, o, "literal", dt)
    t = lambda s, n: i(s, G.RDF_TYPE, O + n)
    rows = [t(L1, "Learning"), lit(L1, G.TITLE, "PROJ-12 retries help", STRING), lit(L1, O + "fix", "f" * 500), i(L1, O + "tagged", T1), i(L1, O + "tagged", T2), lit(L1, O + "priority", "P1"), i(L1, G.DERIVED, DOC), i(L1, G.GENERATED, RUN)]
    rows += [t(L2, "Learning"), lit(L2, G.TITLE, "PROJ-120 caching", STRING), i(L2, O + "tagged", T2), i(L2, G.DERIVED, L1)]
    rows += [t(D1, "Decision"), lit(D1, G.TITLE, "Use a RETRY queue", STRING), lit(D1, O + "detail", "why"), t(N1, "PlanningNote"), lit(N1, G.TITLE, "plan", STRING)]
    rows += [t(P1, "PullRequest"), lit(P1, G.TITLE, "Fix retry"), lit(P1, O + "number", "7", INTEGER), i(P1, O + "partOf", REPO), lit(P1, O + "mergedAt", "2024-01-02T03:00:00+05:00", DATETIME), t(REPO, "Repo"), lit(REPO, G.TITLE, "x"), lit(REPO, O + "sourceId", "o/x")]
    rows += [t(DOC, "Doc"), lit(DOC, O + "path", "docs/1.md"), lit(DOC, G.TITLE, "Doc one"), lit(RUN, O + "pipelineVer", "1"), lit(RUN, O + "model", "m"), lit(RUN, O + "promptHash", "h")]
    rows += [t(T1, "Topic"), lit(T1, G.PREF_LABEL, "retry"), t(T2, "Topic"), lit(T2, G.PREF_LABEL, "cache"), lit(L1, O + "cardTitle", "hidden")]
    return Graph(spark.createDataFrame([(C.spine, *r, None) for r in rows] + [(R + "graph/run/r", *rows[0], None)], QUAD), C)


def test_union_is_a_set(graph):
    assert graph.quads.count() == graph.union.count() + 1


def test_lexical(graph):
    got = {r.iri: r for r in search.lexical(graph, "Retr").collect()}
    assert set(got) == {L1, D1, P1}
    assert got[L1].matched_topics == ["(title match)", "retry"] and len(got[L1].fix) == 400 and got[L1].type == "Learning"
    assert [r.iri for r in search.lexical(graph, "retr", 2).collect()] == sorted(got)[:2]
    assert search.lexical(graph, "zzz").count() == 0


def test_hybrid(graph):
    cards, e = build_cards(graph), HashingEmbedder(64)
    v = embed_cards(cards, e)
    out = search.hybrid(graph, "PROJ-12", 10, v, cards, embed_query("PROJ-12", e)).collect()
    boosted = [r.iri for r in out if r.score > 1]
    assert boosted == [L1] and out[0].iri == L1 and "lexical" in out[0].matched_by and not out[0].degraded
    alone = search.hybrid(graph, "retry").collect()
    assert all(r.degraded and r.matched_by == ["lexical"] and r.type for r in alone)
    assert search.exact_ids("see PROJ-12 or GITHUB_KEY, TTL") == ["PROJ-12", "GITHUB_KEY"]


def test_preflight(graph):
    out = search.preflight(graph, ["retry", "cache"])
    assert [(r.iri, r.n_terms) for r in out.collect()][0] == (L1, 2)
    assert "PROJ-12" in search.preflight_markdown(out)


def test_neighbors_and_provenance(graph, spark):
    n = explore.neighbors(graph, L1).collect()
    assert n[0].direction == "in" and n[0].neighbor == L2 and not any(x.predicate == "cardTitle" for x in n)
    assert {x.label for x in n if x.predicate == "tagged"} == {"retry", "cache"}
    p = explore.provenance(graph, spark.createDataFrame([(L1,), (R + "none",)], "iri string")).orderBy("iri").collect()
    assert p[0].types == ["Learning"] and p[0].derived_from[0].path == "docs/1.md" and p[0].prompt_hash == "h"
    assert p[1].title is None and p[1].types == [] and p[1].run is None
    with pytest.raises(ValueError, match="absolute"):
        explore.neighbors(graph, "x")


def test_paths(graph):
    steps = explore.path(graph, L2, RUN).collect()
    assert [(s.step, s.direction, s.node) for s in steps] == [(1, "out", L1), (2, "out", RUN)]
    assert explore.path(graph, L1, L1).count() == 0
    assert explore.path(graph, L2, REPO).count() == 0
    assert explore.path(graph, L2, RUN, max_len=1).count() == 0
    assert explore.derived_from_docs(graph) == 2


def test_history(graph):
    h = lambda **k: [r.number for r in explore.history(graph, "o/x", **k).collect()]
    assert h() == [7] and h(kind="commit") == [] and h(pr=8) == [] and h(kind="odd") == []
    assert h(since="2024-01-01T22:00:00Z") == [7] and h(since="2024-01-02") == [] and h(until="2024-01-02") == [7]


def test_aggregates(graph):
    assert {r.predicate: r.n for r in aggregates.edge_counts(graph).collect()} == {"partOf": 1, "dependsOn": 0, "duplicateOf": 0, "relatedTo": 0, "inProject": 0}
    assert [(r.label, r.n) for r in aggregates.topics(graph).collect()] == [("cache", 2), ("retry", 1)]
    assert "## Topics" in snapshot.digest(graph)


def test_cards(graph):
    c = {r.iri: r for r in build_cards(graph).collect()}
    assert c[L1].card_text.split("\n")[1] == "cache, retry" and len(c[L1].snippet) == 400
    assert c[N1].card_text == "plan" and c[D1].card_text == "Use a RETRY queue\nwhy"
    few = build_cards(graph, graph.quads.sparkSession.createDataFrame([(L1,), ("https://example.org/none",)], "iri string")).collect()
    assert few == [c[L1]]


def test_index(graph, spark, tmp_path):
    e, path = HashingEmbedder(32), f"file://{tmp_path}/index"
    assert read_index(spark, path) is None
    assert write_index(build_cards(graph), path, e, "t1") and same_stamp(spark, path, "t1") and not same_stamp(spark, path, "t2")
    vectors, cards, meta = read_index(spark, path)
    assert vectors.count() == cards.count() and meta["dim"] == 32
    assert [r.iri for r in cards.collect()] == sorted(r.iri for r in cards.collect())
    assert not write_index(cards.limit(0), path, e)


def test_validation(graph):
    v = {(r.focus, r.path.split("#")[-1].split("/")[-1], r.component) for r in validate.violations(graph).collect()}
    assert (L2, "wasGeneratedBy", "MinCount") in v and not any(f == L1 for f, *_ in v)
    assert (D1, "wasDerivedFrom", "MinCount") in v and not validate.conforms(graph)
    types = {r.type for r in validate.inferred_types(graph).where(F.col("iri") == RUN).collect()}
    assert types == {"ExtractionRun"}
    assert {r.type for r in validate.inferred_types(graph).where(F.col("iri") == DOC).collect()} == {"Doc", "File"}


def test_shapes(spark):
    row = lambda s, p, o, kind="literal", dt=None: (C.spine, s, p, o, kind, dt, None)
    n = R + "verification/1"
    g = Graph(spark.createDataFrame([row(n, O + "reviewerLogin", "ann"), row(n, O + "about", "not a node"), row(n, G.GENERATED, R + "x", "iri"), row(n, G.GENERATED, R + "y", "iri"), row(R + "p", G.RDF_TYPE, O + "DocPage", "iri"), row(R + "p", G.MODIFIED, "z", dt=STRING), row(R + "p", O + "url", "u")], QUAD), C)
    v = {(r.focus.split("/")[-1], r.path.split("#")[-1].split("/")[-1], r.component) for r in validate.violations(g).collect()}
    assert {("1", "wasGeneratedBy", "MaxCount"), ("1", "wasGeneratedBy", "Class"), ("1", "about", "NodeKind"), ("1", "created", "MinCount"), ("1", "wasDerivedFrom", "MinCount"), ("p", "modified", "Datatype"), ("p", "title", "MinCount")} <= v
    assert ("p", "url", "Datatype") not in v


def test_guard(spark):
    df = lambda d: spark.createDataFrame(list(d.items()), "part string, n long")
    old, new = df({"a.nt": 10, "b.nt": 10, "issue.nt": 10, "gone.nt": 3}), df({"a.nt": 5, "b.nt": 4, "issue.nt": 9, "new.nt": 1})
    v = guard.verdict(guard.evaluate(old, new, 5), 5)
    assert {r["part"]: r["status"] for r in v["rows"]} == {"a.nt": "pass", "b.nt": "refuse", "gone.nt": "refuse", "issue.nt": "refuse", "new.nt": "new"}
    assert v["refusal"].startswith("b.nt: shrank from 10 to 4 lines (40.0%") and guard.exit_code(v) == 3
    assert {r["part"]: r["status"] for r in guard.verdict(guard.evaluate(old, new))["rows"]}["issue.nt"] == "pass"
    assert "verdict: refuse" in guard.render(v) and guard.comments_complete(1, 10, False) and not guard.comments_complete(2, 10, False) and not guard.comments_complete(0, 10, True)


def test_parts_round_trip(graph, spark, tmp_path, rows):
    g = graph.added(spark.createDataFrame([(C.spine, L1, O + "detail", 'a "q" \\ back\nline\té😀\\u0041', "literal", None, None), (C.spine, L1, O + "x", "hi", "literal", None, "en")], QUAD))
    counts = snapshot.export_parts(g, f"{tmp_path}/parts")
    assert sum(counts.values()) == g.union.count()
    again = snapshot.export_parts(g, f"{tmp_path}/again")
    assert again == counts and all((tmp_path / "parts" / f).read_bytes() == (tmp_path / "again" / f).read_bytes() for f in os.listdir(tmp_path / "parts"))
    back = ntriples.read_lines(spark, f"{tmp_path}/parts")
    assert rows(back.union) == rows(g.union)
    assert snapshot.copy_parts(f"{tmp_path}/parts", f"{tmp_path}/copy") == len(os.listdir(tmp_path / "parts"))
    assert ntriples.materialise(spark, f"{tmp_path}/parts", f"{tmp_path}/stored") == g.union.count()
    assert rows(ntriples.open_graph(spark, f"{tmp_path}/stored").union) == rows(g.union)
    assert ntriples.prior_graph(spark, f"{tmp_path}/nowhere").quads.count() == 0


def test_pieces(graph, tmp_path):
    files = {r.file: r.n for r in snapshot.write_parts(graph, f"file://{tmp_path}/p", cap=700).collect()}
    assert sum(files.values()) == graph.union.count()
    split = [f for f in files if f.startswith("learning.")]
    assert len(split) > 1 and all(f.split(".")[1].isdigit() for f in split)


def test_escapes(spark):
    lines = ['<s> <p> "a\\u00e9\\U0001F600\\n\\\\u0041" .', "<s> <p> <o> <g> .", '_:b <p> "x"@en .', "# no", '<s> <p> "5"^^<int> .']
    out = ntriples.parsed(spark.createDataFrame([(x,) for x in lines], "value string"), "G").collect()
    assert [(r.g, r.s, r.o, r.o_dt, r.o_lang) for r in out] == [("G", "s", "aé😀\n\\u0041", None, None), ("g", "s", "o", None, None), ("G", "_:b", "x", None, "en"), ("G", "s", "5", "int", None)]
