"""Sources and construction on hand-made inputs."""

import html
import json
import random
import re

from pyspark.sql import functions as F

from fernweave.config import GraphConfig
from fernweave.functions.markup import doc_meta, html_pages, links_of, markdown_sections, page_of
from fernweave.operators import incremental
from fernweave.plans import graph as G
from fernweave.plans.construct import Construct, anchored, issue_comments
from fernweave.sources import docs, git, github, manifest, site, tracker
from fernweave.streaming import landing

from .conftest import SMALL

C = GraphConfig()
R, O = C.resource, C.onto  # noqa: E741


def facts(df, s=None):
    return {(r.s.removeprefix(R), r.p.split("#")[-1].split("/")[-1], r.o.removeprefix(R).removeprefix(O)) for r in df.collect() if s is None or r.s == R + s}


ISSUES = [
    {"identifier": "TST-1", "title": "One", "description": "d" * 5000, "branchName": "b", "team": None, "state": {"name": "Done", "type": "x"}, "labels": {"nodes": [{"name": "Perf"}, {"name": "AI-Working"}]}, "project": {"name": "P q"}, "parent": {"identifier": "TST-9"}, "relations": {"nodes": [{"type": "blocks", "relatedIssue": {"identifier": "TST-2"}}, {"type": "duplicate", "relatedIssue": {"identifier": "TST-3"}}, {"type": "odd", "relatedIssue": {"identifier": "TST-4"}}]}, "comments": {"nodes": [{"body": "short"}, {"body": "# build-up-learnings\nuse it", "user": {"name": "ann"}}]}},
    {"identifier": "LONE", "comments": [{"body": "## Summary\nx\n## Approach\ny", "user": {"name": "cibot"}}, {"body": "z" * 500, "user": {"name": "bob"}}]},
]


def test_tracker(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps(ISSUES))
    rec = tracker.raw_records(spark, f"file://{tmp_path}/t.json")
    assert {r.field: r.n for r in tracker.missing_fields(rec).collect()} == {"identifier": 0, "title": 1, "description": 1, "branchName": 1, "state": 1, "labels": 1, "project": 1, "parent": 1, "comments": 0, "relations": 1}
    rows = tracker.issues(rec)
    f = facts(Construct().issues(rows))
    assert {("issue/TST-1", "status", "done"), ("issue/TST-1", "label", "AI-Working"), ("issue/TST-1", "tagged", "topic/perf"), ("issue/TST-1", "inProject", "project/P%20q"), ("issue/TST-1", "partOf", "issue/TST-9"), ("issue/TST-2", "dependsOn", "issue/TST-1"), ("issue/TST-1", "duplicateOf", "issue/TST-3"), ("issue/TST-1", "relatedTo", "issue/TST-4"), ("issue/TST-1", "trackerTeam", "TST"), ("issue/LONE", "trackerTeam", "UNKNOWN"), ("issue/LONE", "title", "LONE"), ("issue/TST-4", "type", "Issue")} <= f
    assert ("issue/TST-1", "tagged", "topic/ai-working") not in f
    assert [len(o) for s, p, o in f if p == "description"] == [4000]
    c = facts(Construct().comments(issue_comments(rows), "r"))
    assert {("comment/TST-1/1", "type", "Learning"), ("comment/TST-1/1", "title", "TST-1 build-up learnings — One"), ("comment/TST-1/1", "tagged", "topic/perf"), ("comment/TST-1/1", "wasDerivedFrom", "issue/TST-1"), ("comment/LONE/0", "type", "ImplementationNote"), ("comment/LONE/1", "type", "Decision"), ("person/bob", "login", "bob")} <= c
    assert not any(s == "comment/TST-1/0" for s, *_ in c) and ("comment/LONE/1", "fix") not in {(s, p) for s, p, _ in c}


def test_git(spark):
    f = git.listed_files(spark.createDataFrame([("a/b.md",), ("src/x.py",), (" ",), ("skip/n.rst",), ("skip/n.py",), (".txt",)], "value string"), "o/n", ("skip/*",))
    assert {(r.path, r.is_doc) for r in f.collect()} == {("a/b.md", True), ("src/x.py", False), ("skip/n.py", False), (".txt", True)}
    heads = git.doc_heads(f, spark.createDataFrame([("a/b.md", "---\ntitle: 'T'\n---\n# H\nbody one\n")], "path string, text string"))
    q = facts(Construct().files(heads))
    assert {("doc/o%2Fn/a%2Fb.md", "title", "T"), ("doc/o%2Fn/a%2Fb.md", "detail", "body one"), ("doc/o%2Fn/.txt", "title", ".txt"), ("file/o%2Fn/src%2Fx.py", "type", "File")} <= q
    log = git.logged_commits(spark.createDataFrame([("s1\x1fAnn\x1fa@x\x1f2024-01-01T00:00:00+02:00\x1ffix ABC-7",), ("broken",), ("s2\x1f\x1fx[bot]\x1f2024-01-02T00:00:00Z\x1fy",)], "value string"), "o/n")
    q = facts(Construct().commits(log))
    assert {("commit/o%2Fn/s1", "references", "issue/ABC-7"), ("issue/ABC-7", "addressedBy", "commit/o%2Fn/s1"), ("person/x%5Bbot%5D", "type", "BotAgent"), ("person/Ann", "type", "Person")} <= q
    repo = spark.createDataFrame([("o/n", "main", True, "", None)], "slug string, history_branch string, is_default_branch boolean, snapshot_ref string, docs_url string")
    q = facts(Construct().repos(repo))
    assert ("repo/o%2Fn", "isDefaultBranch", "true") in q and not any(p in ("snapshotRef", "docsUrl") for _, p, _ in q)


def test_pulls(spark, tmp_path):
    text = json.dumps([{"number": 1, "title": "Fix AB1-2", "body": None, "state": "closed", "merged_at": "2024-01-01T00:00:00Z", "merge_commit_sha": "s1", "base": {"ref": "main"}, "user": {"login": "ann"}}]) + json.dumps([{"number": 2, "title": "x", "state": "open", "merge_commit_sha": "s1", "user": None}]) + '[{"number": 3'
    assert github.land(spark, text, f"file://{tmp_path}/p") == 2
    p = github.pulls(spark, f"file://{tmp_path}/p", "o/n")
    commits = spark.createDataFrame([("o/n", "s1")], "slug string, sha string")
    q = facts(Construct().pulls(p, commits))
    assert {("pr/o%2Fn/1", "state", "merged"), ("pr/o%2Fn/1", "mergeCommit", "commit/o%2Fn/s1"), ("pr/o%2Fn/1", "references", "issue/AB1-2"), ("pr/o%2Fn/2", "state", "open"), ("pr/o%2Fn/2", "wasAttributedTo", "person/unknown")} <= q
    assert ("pr/o%2Fn/2", "mergeCommit", "commit/o%2Fn/s1") not in q
    assert not any(p == "mergeCommit" for _, p, _ in facts(Construct().pulls(p, commits.limit(0))))


def test_reviews(spark, tmp_path):
    items = [{"id": 5, "body": "![P1 badge](u) a remark of some length", "user": {"login": "chatgpt-codex-connector[bot]"}, "path": "a.py", "line": None, "original_line": 9, "commit_id": "c", "created_at": "2024-01-01T00:00:00Z"}, {"id": 6, "body": "lgtm", "user": {"login": "ann"}}]
    github.land(spark, json.dumps(items), f"file://{tmp_path}/r")
    rows = github.reviews(spark, f"file://{tmp_path}/r", "o/n", 3)
    states = github.thread_states(spark.createDataFrame([(5, False, True), (5, True, False)], "comment_id long, resolved boolean, outdated boolean"))
    q = facts(Construct().reviews(rows, "r", False, states))
    node = "pr/o%2Fn/3/review-comment/5"
    assert {(node, "type", "Verification"), (node, "reviewLine", "9"), (node, "threadState", "resolved"), (node, "reviewerKind", "codex"), (node, "severity", "P1"), (node, "about", "pr/o%2Fn/3"), (node, "title", "PR #3 review: P1 badge a remark of some length")} <= q
    assert not any(s.endswith("/6") for s, *_ in q)
    assert (node, "threadState", "unknown") in facts(Construct().reviews(rows, "r", False))


def test_front_matter(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.md").write_text("---\nTitle: A\ntags: [X, y]\nkeywords: 'z, X'\nseverity: High\npriority: mixed P2\ndate: '2024-13-01'\ndate_found: 2024-02-03\nlearning_id: ['L-1']\nrelated_issues: ['#4 and AB-7', '#2']\nsymptoms: [one, two]\nstatus: Fixed\nrelated: [b.md]\nodd: 1\n---\nbody")
    (tmp_path / "b.md").write_text("---\ntitle: B\n---\n")
    (tmp_path / "bad.md").write_text("---\n: [\n---\n")
    (tmp_path / "none.md").write_text("# plain")
    d = docs.folded(docs.front_matter(docs.markdown_files(spark, f"file://{tmp_path}", "o/n")))
    meta = {r.stem: r.meta for r in d.collect()}
    assert set(meta) == {"a b", "b"}
    assert meta["a b"] == {"title": ["A"], "tags": ["x", "y", "z"], "priority": ["P2"], "found_date": ["2024-02-03"], "learning_id": ["L-1"], "issues": ["2", "4"], "tracker": ["AB-7"], "symptom": ["one; two"], "status": ["done"], "related_solutions": ["b.md"], "severity_level": ["high"]}
    q = facts(Construct().solutions(d, "r"))
    n = "learning/o%2Fn/solutions/L-1"
    assert {(n, "type", "Learning"), (n, "filedAs", "issue/AB-7"), (n, "filedAs", "issue/o%2Fn/4"), (n, "tagged", "topic/z"), (n, "foundDate", "2024-02-03"), (n, "relatedSolution", "doc/o%2Fn/b.md"), (n, "wasDerivedFrom", "doc/o%2Fn/sub%2Fa%20b.md")} <= q


def test_decision_records(spark):
    df = spark.createDataFrame([("o/n", "docs/adr/0007-x.md", "0007-x", "# ADR 0007: Use it\n\n**Status:** Accepted now\n**References:** AB-1, CD-22\n"), ("o/n", "docs/adr/plain.md", "plain", "no heading")], "slug string, path string, stem string, text string")
    q = facts(Construct().adrs(df, "r"))
    n = "decision/o%2Fn/adr/7"
    assert {(n, "title", "ADR 7: Use it"), (n, "status", "accepted"), (n, "filedAs", "issue/CD-22"), ("decision/o%2Fn/adr/plain", "title", "ADR plain: plain")} <= q


def test_html():
    title, s = page_of("<html><head><title>​ T </title></head><body><nav><p>no</p></nav><article><p>pre <b>x</b><h1>Head<a class='headerlink'>¶</a></h1><ul><li>one<li>two</ul><h2>Sub</h2><pre>code</pre><div>loose<script>no</script></div></article><p>out</p></body></html>", "http://x/y")
    assert title == "T" and s == [("", 0, "pre x"), ("Head", 1, "one two"), ("Sub", 2, "code loose")]
    assert page_of("<body><header>h</header><p>only</p></body>", "http://x/last/") == ("last", [("", 0, "only")])
    assert page_of("<main><h5>five</h5></main><article><p>a</p></article>", "u")[1] == [("", 0, "a")]
    assert page_of("", "http://x") == ("http://x", [])
    assert links_of('<a href="/b#c">x</a><a href="mailto:q">y</a><a href="http://z/">', "http://x/a") == ["http://x/b", "http://z/"]


def markdown(spark, *rows):
    df = spark.createDataFrame(list(rows), "text string, uri string")
    title, sections = markdown_sections(F.col("text"), F.col("uri"))
    return [(r[0], [tuple(x) for x in r[1]]) for r in df.select(title, sections).collect()]


def test_markdown(spark):
    assert markdown(spark, ("pre\n# T\nunder\n## S\nx\n##### five\n", "u"), ("just text", "mcp://a/b.md"), ("", "a/b"), ("# \n#\t\na\r\n# T\nb\n# U\n", "///"), ("## only\n", "x/y/"), ("#no\n####\n", "/")) == [
        ("T", [("", 0, "pre"), ("", 0, "under"), ("S", 2, "x\n##### five")]), ("b.md", [("b.md", 1, "just text")]), ("b", []),
        ("T", [("", 0, "a"), ("", 0, "b"), ("U", 1, "")]), ("y", [("only", 2, "")]), ("/", [("/", 1, "#no\n####")]),
    ]


def test_markdown_by_brute_force(spark):
    """Random lines: headings are found line by line, and each part's text is what stands up to the next one."""
    rng = random.Random(8)
    parts = ["# One", "## Two ", "#", "####\tfour", "##### no", "text", "", " # no", "#x", "  ", "a #"]
    made = [("\n".join(rng.choice(parts) for _ in range(rng.randint(0, 9))), "d/e.md") for _ in range(300)]
    for (text, _), (title, sections) in zip(made, markdown(spark, *made), strict=True):
        ls = text.split("\n")
        heads = [(i, len(m[1]), m[2].strip()) for i, x in enumerate(ls) if (m := re.match(r"(#{1,4})[ \t]+(.*)$", x))]
        named = [h for h in heads if h[1] == 1 and h[2]]
        want = []
        for (i, n, h), (end, *_) in zip([(-1, 0, ""), *heads], [*heads, (len(ls),)], strict=True):
            body = "\n".join(ls[i + 1 : end]).strip()
            top = n == 1 and (not named or i <= named[0][0])
            if body or (h and not top):
                want.append(("", 0, body) if not n or top else (h, n, body))
        if not named and not any(n for _, n, _ in want):
            want = [("e.md", 1, text.strip())] if text.strip() else []
        assert (title, sections) == (named[0][2] if named else "e.md", want), text


def test_head_of_documents(spark):
    long = "w" * 300
    rows = [("# One\ntext\n## Two\nmore", "One", "text more"), ("---\nTITLE: 'A b'\ntitle: c\n---\n# H\nx", "A b", "x"), ("---\ntitle:\nk: v\n---\ny\n# H", "H", "y"), ("---\ntitle: open\nz", "open", "--- title: open z"), ("", "f", ""), (f"{long}\n{long}\n# late", "f", (long + " " + long)[:400]), ("a\u2028#b\r\n\u3000c ", "f", "a c")]
    title, snippet = doc_meta(F.col("text"), F.lit("f"))
    assert [tuple(r) for r in spark.createDataFrame([(r[0],) for r in rows], "text string").select("text", title, snippet).collect()] == rows


def test_pages_by_brute_force(spark):
    """The test pages, whose articles hold headings and paragraphs only, read by patterns."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.url: (r.title, [tuple(x) for x in r.sections]) for r in html_pages(pages).collect()}
    plain = lambda x: [html.unescape(t).strip() for t in re.split(r"<[^>]*>", re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "", x)) if html.unescape(t).strip()]
    for r in pages.collect():
        body = re.search(r"(?is)<article[^>]*>(.*?)</article>", r.html)[1]
        assert " ".join(t for s in got[r.url][1] for t in (s[0], s[2]) if t).split() == " ".join(plain(body)).split()
        assert [s[0] for s in got[r.url][1] if s[1]] == ["".join(plain(h)) for h in re.findall(r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>", body)]
        assert got[r.url][0] == "".join(plain(re.search(r"(?is)<title[^>]*>(.*?)</title>", r.html)[1]))


def test_pages(spark):
    from fernweave.functions.markup import markdown_pages

    df = markdown_pages(spark.createDataFrame([("r://a", "# T\nintro\n## Same\nx\n## Same\ny\n## !\nz")], "uri string, text string"))
    assert [(r.anchor, r.text) for r in anchored(df).orderBy("pos").collect()] == [("same", "x"), ("same-2", "y")]
    q = facts(Construct().pages(df, "r://", "Src", "2024-01-01T00:00:00Z", server="s"))
    assert {("mcpsource/s", "type", "McpSource"), ("mcppage/s/r%3A%2F%2Fa", "detail", "intro"), ("mcppage/s/r%3A%2F%2Fa#same-2", "heading", "Same")} <= q
    old = df.withColumn("content_hash", df.content_hash)
    same, changed = incremental.split_pages(df, old)
    assert same.count() == 1 and changed.count() == 0


def test_crawl(spark):
    page = lambda *links: "".join(f'<a href="{x}">' for x in links)
    rows = [("http://s.x/docs", page("/docs/a", "/other", "/docs/skip/z", "http://t.y/docs/q")), ("http://s.x/docs/a", page("b#top", "/docs")), ("http://s.x/docs/b", page("/docs/c")), ("http://s.x/docs/c", ""), ("http://s.x/docs/skip/z", ""), ("http://s.x/docs/seed", ""), ("http://s.x/other", "")]
    pages = spark.createDataFrame(rows, "url string, html string")
    cfg = site.CrawlConfig("http://s.x/docs", exclude=("/docs/skip/*",), max_depth=2)
    got = {(r.url.rsplit("/", 1)[1], r.depth) for r in site.crawl(pages, cfg).collect()}
    assert got == {("docs", 0), ("a", 1), ("b", 2)}
    seeds = spark.createDataFrame([("http://s.x/docs/seed",), ("http://s.x/docs/c",)], "url string")
    got = {r.url.rsplit("/", 1)[1] for r in site.crawl(pages, cfg, seeds, site.robots("User-agent: *\nDisallow: /docs/b")).collect()}
    assert got == {"docs", "a", "seed", "c"}
    assert site.crawl(pages, site.CrawlConfig("http://s.x/docs", max_pages=1)).count() == 1
    xml = spark.createDataFrame([('<?xml version="1.0"?><urlset xmlns="http://n"><url><loc> http://a </loc></url></urlset>',), ("<sitemapindex><sitemap><loc>http://i</loc></sitemap></sitemapindex>",), ("<urlset><url>",)], "text string")
    assert {(r.loc, r.is_index) for r in site.sitemap_urls(spark, xml).collect()} == {("http://a", False), ("http://i", True)}
    tries = []

    def broken(*a, **k):
        tries.append(1)
        raise OSError

    assert site.fetch("http://x", cfg, broken, lambda s: None) is None and len(tries) == 3


def test_manifest(tmp_path):
    good = {"code_repo": {"slug": "o/n"}, "secondary_repos": [{"slug": "o/m"}, {"slug": "o/m"}, {"slug": "o/n"}], "trackers": [{"team": "AB", "kind": "linear"}, {"team": "CD", "kind": "jira", "tier": "secondary"}]}
    assert manifest.problems(good) == [] and manifest.problems({}) == [] and manifest.problems({"code_repo": "o/n", "trackers": None}) == []
    assert [[t["team"] for t in manifest.trackers(good, tier)] for tier in (None, "primary", "secondary")] == [["AB", "CD"], ["AB"], ["CD"]]
    assert manifest.secondary(good, "o/n") == ([{"slug": "o/m"}], ["o/m", "o/n"])
    for bad, says in (
        ([], "mapping"), ({"code_repo": "n"}, "owner/name"), ({"code_repo": "/n"}, "owner/name"), ({"code_repo": 3}, "code_repo"), ({"code_repo": {}}, "slug"), ({"code_repo": {"slug": "a/b/c"}}, "owner/name"),
        ({"trackers": {}}, "list"), ({"trackers": ["x"]}, "trackers[0]"), ({"trackers": [{"kind": "linear"}]}, "team"), ({"trackers": [{"team": "A", "kind": "odd"}]}, "kind"), ({"trackers": [{"team": "A", "kind": "jira", "tier": "x"}]}, "tier"),
        ({"trackers": [{"team": "A", "kind": "jira"}] * 3}, "twice"), ({"secondary_repos": "x"}, "list"), ({"secondary_repos": [{"path": "p"}]}, "slug"), ({"secondary_repos": [{"slug": "x"}]}, "owner/name"), ({"docs_sites": [{"root_url": "x", "max_pages": 1}]}, "root_url"), ({"mcp_sources": [{}]}, "name"),
    ):
        found = manifest.problems(bad)
        assert len(found) == 1 and says in found[0], (bad, found)
    (tmp_path / "n").mkdir()
    assert manifest.repo_path({"slug": "o/n"}, str(tmp_path)) == str(tmp_path / "n") and manifest.repo_path({"slug": "o/x"}, str(tmp_path)) is None


def test_landing_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, ck = f"file://{tmp_path}/quads", f"file://{tmp_path}/ck"
    line = lambda k: json.dumps({"identifier": k, "title": k, "comments": "[]"})
    build = lambda df: Construct().issues(df)
    for i, keys in enumerate((["A-1"], ["A-1", "A-2"])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(line, keys)))
        landing.append_quads(landing.issue_stream(spark, f"file://{tmp_path}/in"), build, path, ck).awaitTermination(120)
    q = spark.read.parquet(path)
    assert q.count() == q.dropDuplicates().count() and q.where(f"p = '{G.TITLE}'").count() == 2


def test_related_solutions_of_one_path(spark):
    """Documents that share a path are joined once with those that want it."""
    rows = spark.createDataFrame([("s", "d/a.md", str(i), {"related_solutions": ["d/a.md"]}) for i in range(20)], "slug string, path string, lid string, meta map<string, array<string>>")
    c = Construct(GraphConfig())
    assert c.related(rows, F.lit("g"), F.col("lid")).count() == 20


def test_issues_are_distinct_without_a_shuffle_of_facts(spark):
    """Repeated and changed issues, labels that differ in case, parents and relations that are issues themselves."""
    schema = "identifier string, title string, description string, branchName string, team string, sourceSystem string, state struct<name: string>, labels struct<nodes: array<struct<name: string>>>, project struct<name: string>, parent struct<identifier: string>, relations struct<nodes: array<struct<type: string, relatedIssue: struct<identifier: string>>>>"
    issue = lambda key, title="t", labels=("Bug", "bug", "Bug", "", None), parent="A-1", other="A-2": (key, title, None, None, None, None, ("Done",), ([(x,) for x in labels],), ("P",), (parent,), ([("blocks", (other,))],))
    rows = [issue("A-1"), issue("A-2"), issue("A-2"), issue("A-2", "u", ("x",), "A-3"), issue("A-4", labels=()), (*issue("A-5")[:7], None, None, None, None), (*issue(None)[:10], None)]
    out = Construct(GraphConfig()).issues(spark.createDataFrame(rows, schema))
    got = [tuple(r) for r in out.select("s", "p", "o").collect()]
    assert len(got) == len(set(got)) and out._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
    short = {(s.rsplit("/", 1)[-1], p.split("#")[-1].split("/")[-1], o.rsplit("/", 1)[-1].split("#")[-1]) for s, p, o in got}
    assert {o for s, p, o in short if (s, p) == ("A-2", "label")} == {"A-2", "Bug", "bug", "x"} and {o for s, p, o in short if (s, p) == ("A-2", "title")} == {"t", "u"}
    assert {o for s, p, o in short if (s, p) == ("A-2", "tagged")} == {"bug", "x"} and {o for s, p, o in short if (s, p) == ("A-2", "partOf")} == {"A-1", "A-3"}
    assert {s for s, p, o in short if o == "Issue"} == {"A-1", "A-2", "A-3", "A-4", "A-5"} and {o for s, p, o in short if (s, p) == ("A-2", "dependsOn")} == {"A-1", "A-2", "A-4"}
    assert {s for s, p, o in short if o == "Topic"} == {"bug", "x"} and ("P", "title", "P") in short
