"""A build of every source, end to end, and the refresh rail."""

import json
import subprocess

import pytest

from fernweave import cli
from fernweave.build import Build, counts_at
from fernweave.config import GraphConfig
from fernweave.operators import embed, explore
from fernweave.sources import ntriples

C = GraphConfig()
NOW = "2024-05-01T00:00:00+00:00"


def git(repo, *args):
    return subprocess.run(["git", "-C", str(repo), "-c", "user.name=ann", "-c", "user.email=a@x", *args], check=True, capture_output=True, text=True).stdout


def lines(path, *rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(map(json.dumps, rows)))


@pytest.fixture(scope="module")
def sources(tmp_path_factory, spark):
    from fernweave.sources import github

    at = tmp_path_factory.mktemp("sources")
    repo, landed = at / "main", at / "landed"
    for path, text in {
        "docs/solutions/cache/a.md": "---\ntitle: Cache it\ntags: [cache]\nlearning_id: L-1\n---\nbody",
        "docs/adr/0003-x.md": "# ADR 0003: Use parts\n\n**Status:** Accepted\n**References:** AB-1\n",
        "docs/plans/2024-p.md": "---\ntitle: The plan\nstatus: Done\ntype: feature\ndate: 2024-02-03\n---\nfor AB-2",
        "docs/superpowers/plans/bad.md": "---\ntitle: a: b: c\n---\nsee AB-3",
        "README.md": "# Main\nwhat it does",
        "src/x.py": "x = 1",
    }.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    git(at, "init", "-q", "-b", "trunk", str(repo))
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "AB-1 first")
    sha = git(repo, "rev-parse", "HEAD").strip()
    other = at / "other"
    other.mkdir()
    git(at, "init", "-q", str(other))
    (other / "a.txt").write_text("a")
    git(other, "add", "-A")
    git(other, "commit", "-qm", "second repo")
    github.land(spark, json.dumps([{"number": 7, "title": "AB-1 merge", "state": "closed", "merged_at": "2024-01-02T00:00:00Z", "merge_commit_sha": sha, "base": {"ref": "trunk"}, "user": {"login": "ann"}}]), f"file://{landed}/pulls")
    lines(landed / "pull_comments" / "c.json", {"number": 7, "title": "AB-1 merge", "ordinal": 0, "id": 1, "body": "z" * 500, "login": "bob", "created_at": NOW})
    lines(landed / "review_comments" / "r.json", {"number": 7, "ordinal": 0, "id": 5, "body": "a remark of some length here", "user": {"login": "bob"}, "path": "src/x.py", "line": 3})
    lines(landed / "reviews" / "r.json", {"number": 7, "ordinal": 0, "id": 6, "body": "please change all of this", "state": "CHANGES_REQUESTED", "user": {"login": "bob"}})
    lines(landed / "threads" / "t.json", {"comment_id": 5, "resolved": True, "outdated": False})
    lines(landed / "sites" / "d.x" / "p.json", {"url": "https://d.x", "html": "<title>Docs</title><article><p>pre</p><h2>One</h2><p>text</p></article><a href='/b'>"}, {"url": "https://d.x/b", "html": "<title>B</title><article><h2>Two</h2><p>more</p></article>"}, {"url": "https://d.x/far", "html": "<p>not linked</p>"})
    lines(landed / "resources" / "srv" / "r.json", {"ordinal": 0, "uri": "r://a/t.md", "mime": "text/markdown", "text": "# T\nintro\n## S\nx"}, {"ordinal": 1, "uri": "r://a/b.bin", "mime": "image/png", "text": "?"})
    (landed / "issues").write_text(json.dumps([{"identifier": "AB-1", "title": "One", "labels": {"nodes": [{"name": "Perf"}]}, "comments": [{"body": "# build-up-learnings\nuse it", "user": {"name": "ann"}}]}]))
    m = {"code_repo": {"slug": "o/main", "docs_url": "https://d.x"}, "secondary_repos": [{"slug": "o/other"}, {"slug": "o/other"}, {"slug": "o/gone"}], "trackers": [{"team": "AB", "kind": "linear"}], "docs_sites": [{"root_url": "https://d.x", "branch": "trunk"}]}
    (at / "m.yml").write_text(json.dumps(m))
    return at, m, sha


@pytest.fixture(scope="module")
def built(spark, sources):
    at, m, _ = sources
    b = Build(spark, m, str(at / "landed"), now=NOW)
    g = b.all(str(at / "main"), repos_root=str(at))
    path = f"{at}/g"
    ntriples.write_quads(g, path)
    return b, ntriples.read_quads(spark, path)


def facts(g):
    short = lambda x: x.removeprefix(C.resource).removeprefix(C.onto)
    return {(short(r.s), r.p.split("#")[-1].split("/")[-1], short(r.o)) for r in g.quads.collect()}


def test_every_source_is_built(built, sources):
    b, g = built
    at, _, sha = sources
    assert {r["source"]: r["status"] for r in b.results if r["status"] != "ok"} == {"o/gone": "failed", "o/other": "skipped"}
    q, pull, run = facts(g), "pr/o%2Fmain/7", f"run/{b.run}"
    for want in (
        ("repo/o%2Fmain", "sourceId", "o/main"), ("repo/o%2Fmain", "historyBranch", "trunk"), ("repo/o%2Fmain", "snapshotRef", sha), ("repo/o%2Fmain", "docsUrl", "https://d.x"), ("repo/o%2Fother", "type", "Repo"),
        (f"commit/o%2Fmain/{sha}", "references", "issue/AB-1"), ("doc/o%2Fmain/README.md", "title", "Main"), ("file/o%2Fmain/src%2Fx.py", "type", "File"),
        ("learning/o%2Fmain/solutions/L-1", "wasDerivedFrom", "doc/o%2Fmain/docs%2Fsolutions%2Fcache%2Fa.md"), ("doc/o%2Fmain/docs%2Fsolutions%2Fcache%2Fa.md", "type", "Doc"),
        ("decision/o%2Fmain/adr/3", "filedAs", "issue/AB-1"), ("decision/o%2Fmain/plan/2024-p", "status", "done"), ("decision/o%2Fmain/plan/2024-p", "category", "feature"), ("decision/o%2Fmain/plan/2024-p", "foundDate", "2024-02-03"), ("decision/o%2Fmain/plan/2024-p", "filedAs", "issue/AB-2"),
        ("decision/o%2Fmain/plan/bad", "title", "bad"), ("decision/o%2Fmain/plan/bad", "filedAs", "issue/AB-3"),
        (pull, "mergeCommit", f"commit/o%2Fmain/{sha}"), (f"{pull}/comment/1", "type", "Decision"), (f"{pull}/review-comment/5", "threadState", "resolved"), (f"{pull}/review-body/6", "reviewState", "CHANGES_REQUESTED"),
        ("docpage/https%3A%2F%2Fd.x%2Fb", "title", "B"), ("mcpsource/srv", "type", "McpSource"), ("issue/AB-1", "title", "One"), (run, "type", "ExtractionRun"), ("graph/spine", "modified", NOW),
    ):
        assert want in q, want
    assert not any("far" in s or "b.bin" in s for s, *_ in q)
    assert [r.number for r in explore.history(g, "o/main", kind="pr").collect()] == [7]
    assert [r.sha for r in explore.history(g, "o/main", branch="trunk", kind="commit").collect()] == [sha]
    assert b.results[[r["source"] for r in b.results].index("tracker: issues")]["counts"]["without description"] == 1


def test_unchanged_pages_are_copied(spark, sources, built, monkeypatch):
    """The second build reads the pages with the same hash from the graph before, and gives the same quads."""
    at, m, _ = sources
    b = Build(spark, m, str(at / "landed"), prior=built[1], now=NOW)
    b.run = built[0].run
    b.sites()
    pages = lambda q: {x for x in q if x[0].startswith(("docpage", "docsite"))}
    from fernweave.plans.graph import Graph

    assert b.results[0]["status"] == "ok" and pages(facts(Graph(b.made[0]))) == pages(facts(built[1]))


def test_refresh_and_guard(spark, sources, capsys, monkeypatch):
    at, _, _ = sources
    out, repo = at / "out", at / "main"
    args = ["refresh", "--manifest", str(at / "m.yml"), "--repo", str(repo), "--landed", str(at / "landed"), "--repos-root", str(at), "--graph", str(out / "graph"), "--vectors", str(out / "vectors"), "--parts", str(repo / "parts")]
    assert cli.main(args) == 1  # one secondary repository isn't there
    line = json.loads(capsys.readouterr().out.splitlines()[-1])
    s = line["stats"]
    assert line["published"] and s["quads"] == sum(s["parts"].values()) > 50 and s["docPages"] > 0 and s["vectors"] > 3 and s["embeddingsBytes"] > 0 and s["largestSnapshotBytes"] > 0
    assert "Graph digest" in (repo / "digest.md").read_text()
    assert any(r["status"] == "failed" for r in json.loads((out / "graph.sources.json").read_text()))
    # parts of a commit: the same counts, and a guard against them
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "parts")
    monkeypatch.chdir(repo)
    own = {r.part: r.n for r in counts_at(spark, "HEAD:parts").collect()}
    assert own == {r.part: r.n for r in counts_at(spark, f"file://{repo}/parts").collect()} == s["parts"]
    assert cli.main(["guard", "HEAD:parts", f"file://{repo}/parts"]) == 0
    (repo / "parts" / "issue.nt").write_text("")
    assert cli.main(["guard", "HEAD:parts", f"file://{repo}/parts"]) == 3
    capsys.readouterr()
    # a refresh that lost most of its sources isn't published
    before = (repo / "parts" / "doc.nt").read_text()
    assert cli.main(["refresh", "--tracker", f"file://{at}/landed/issues", "--graph", str(out / "graph"), "--vectors", str(out / "vectors"), "--parts", str(repo / "parts"), "--previous", "HEAD:parts"]) == 3
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["published"] is False and (repo / "parts" / "doc.nt").read_text() == before


def test_vectors_are_copied_by_age(spark, built, tmp_path):
    from fernweave.operators.cards import build_cards

    src, dst = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    assert embed.write_index(build_cards(built[1]), src, embed.HashingEmbedder(16), NOW)
    assert not embed.copy_index(spark, src, dst, "another") and embed.read_index(spark, dst) is None
    assert embed.copy_index(spark, src, dst, ntriples.stamp_of(built[1])) and embed.same_stamp(spark, dst, NOW)
