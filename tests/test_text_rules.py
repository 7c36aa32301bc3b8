"""Rules of text, on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from fernweave import config as K
from fernweave.config import GraphConfig, configured, paths
from fernweave.functions import text as X
from fernweave.functions.iri import Iris, part_of, run_id_of, seg


@pytest.fixture
def each(spark):
    """Applies an expression over columns a, b, c to rows of text."""

    def run(expr, *rows):
        df = spark.createDataFrame([(i, *(list(r) + [None] * (3 - len(r)))) for i, r in enumerate(rows)], "i int, a string, b string, c string")
        return [r.x for r in df.select("i", expr.alias("x")).orderBy("i").collect()]

    return run




@pytest.fixture(autouse=True)
def _columns(spark):
    globals().update(A=F.col("a"), B=F.col("b"), C=F.col("c"))


def test_first_line(each):
    rows = [("\n\n<!-- m -->\n# Summary\nbody text",), ("## Two words\nx",), ("# 🔥 Report\nnext",), ("# ",), ("  plain  ",), ("",), ("#\n<!-- a\nb",)]
    assert each(X.first_line(A), *rows) == ["body text", "Two words", "next", "", "plain", "", "<!-- a"]


def test_classify(each):
    long = "x" * 400
    rows = [("# ai-implement-build-up-learnings\nz",), ("text\nai-implement-build-up-learnings",), (K.SMOKE_HEADING + " z",), ("AI Planning: do",), (long,), ("x" * 399,), (" " * 300 + "x" * 200,)]
    assert each(X.classify(A, (K.PLANNING_HEADING,)), *rows) == ["learning", None, "verification", "planning_note", "decision", None, None]
    bot = F.lit(True)
    rows = [("## Summary\n\nx\n## Approach\ny",), ("# Implementation Summary of it",), (long,), ("## Summary\nonly",)]
    assert each(X.classify(A, (), bot), *rows) == ["implementation_note", "implementation_note", None, None]


def test_classify_pull_comment(each):
    long = "y" * 400
    rows = [("<!-- claude-review-verdict x -->", "ann"), ("<!-- ai-implement post-push status=start -->", "ann"), ("<!-- ai-implement post-push -->", "z[bot]"), (long, "ann"), (long, "z[bot]"), (long, "ai-implement-orchestrator-bot"), ("# build-down-learnings", "z[bot]")]
    assert each(X.classify_pull_comment(A, B), *rows) == ["verification", None, "verification", "decision", None, None, "learning"]


def test_review_items(each):
    keep = X.keep_review(A, B, C == "body", F.lit("CHANGES_REQUESTED"))
    rows = [("LGTM!", "ann", "body"), ("ok", "ann", "body"), ("ok", "ann", None), ("<!-- ai-implement native-review -->", "ann", None), ("a remark that is long enough", "ann", None), ("<!-- ai-implement post-push status=start --> and a long text", "ann", "body"), ("**[x](http://y)** <b>`gone`</b>", "ann", None)]
    assert each(F.coalesce(keep["keep"], F.lit(False)), *rows) == [False, True, False, True, True, False, False]
    rows = [("x codex-code-review-finding:v1", "ann"), ("x", "Claude[bot]"), ("a Claude Review", "github-actions[bot]"), ("x", "github-actions[bot]"), ("<!-- ai-implement review-finding:v1 -->", "a-bot"), ("x", "ann")]
    assert each(X.reviewer_kind(B, A), *rows) == ["codex", "claude", "claude", "other-bot", "ai-implement", "human"]
    rows = [("a P1 b P0", "codex", ""), ("P9", "codex", ""), ("🔴 🟡", "claude", ""), ("Severity: High", "claude", ""), ("[Minor] x", "ai-implement", ""), ("x", "human", "CHANGES_REQUESTED"), ("x", "human", "COMMENTED"), ("x", "other-bot", "CHANGES_REQUESTED")]
    assert each(X.severity(A, B, C), *rows) == ["P1", "unknown", "blocking", "high", "minor", "changes_requested", "unknown", "unknown"]


def test_titles(each):
    title = X.comment_title(F.lit("K-1"), F.coalesce(C, F.lit("")), A, B)
    rows = [("# build-down-learnings\nz", "learning", "The issue"), ("# build-up-learnings", "learning", None), ("<!-- claude-review-verdict -->\nall good", "verification", None), ("<!-- claude-review-verdict -->", "verification", None), ("x", "implementation_note", None), ("hello\nyou", "decision", None), ("", "decision", None)]
    assert each(title, *rows) == ["K-1 build-down learnings — The issue", "K-1 build-up learnings", "K-1 review: all good", "K-1 review", "K-1 implementation summary", "K-1: hello", "K-1 note"]


def test_bots(each):
    assert each(X.is_bot_login(A), ("x[bot]",), ("y-bot",), ("robot",), ("[bot]x",)) == [True, True, False, True]
    assert each(X.is_bot_name(A, ("ci",)), ("CI",), ("robot",), ("ann",), ("",), (None,)) == [True, True, False, False, False]


def test_enumerations(each):
    assert each(X.priority(A), ("P1",), ("mixed (1 p 2, 4 P3)",), ("XP1",), (None,)) == ["P1", "P2", None, None]
    assert each(X.severity_level(A), (" High ",), ("P1",)) == ["high", None]
    assert each(X.category(A), ("Logic_Error",), ("feature",), ("a b",)) == ["logic-errors", "feature-patterns", "a-b"]
    assert each(X.status(A), ("Fixed",), ("planned",), ("wip",), ("in progress",), ("wont_fix",), ("Odd",)) == ["done", "open", "in-progress", "in progress", "wont-fix", "odd"]


def test_references(each):
    assert each(X.refs(A), ("#12, #x and #3",)) == [["12", "3"]]
    assert each(X.tracker_keys(A), ("abc-1 A-2 x9-03",)) == [["ABC-1", "X9-03"]]
    assert each(X.tracker_keys(A, ("ABC",)), ("abc-1 x9-03",)) == [["ABC-1"]]
    assert each(X.tags(A), ("[a, 'B', ,c]",)) == [["a", "b", "c"]]
    assert [str(d) for d in each(X.first_date(A), ("on 2024-02-29!",), ("2024-02-30",), ("none",))] == ["2024-02-29", "None", "None"]
    assert each(X.heading_anchor(A), ("Héllo, the World_x  -- 2!",)) == ["héllo-the-world-x-2"]


def test_globs(each):
    rx = lambda g: A.rlike(X.glob_regex(g))
    assert each(rx("sub/**"), ("sub/a/b.md",), ("x/sub/a",)) == [True, False]
    assert each(rx("*.md[xy]"), ("a/b.mdx",), ("b.mdz",)) == [True, False]
    assert each(rx("a?[!b]"), ("axc",), ("axb",)) == [True, False]


def test_identifiers(each, spark):
    assert each(seg(A), ("a b*~/é+%",)) == ["a%20b%2A~%2F%C3%A9%2B%25"]
    i = Iris(GraphConfig("https://k.example/x"))
    assert each(i.pull_comment(A, F.lit(7), "review-comment", B), ("o/n", "9")) == ["https://k.example/x/resource/pr/o%2Fn/7/review-comment/9"]
    assert each(i.doc_section(A, F.coalesce(B, F.lit(""))), ("u", "top"), ("u", None)) == ["https://k.example/x/resource/docpage/u#top", None]
    assert run_id_of("0.1.0", "x") == spark.range(1).select(F.substring(F.sha2(F.lit("0.1.0\nx"), 256), 1, 16)).first()[0]
    cfg = GraphConfig()
    assert each(part_of(cfg, A), (cfg.resource + "commit/x/1",), (cfg.onto + "Repo",), ("urn:x#y",), ("urn:x",), (cfg.resource,)) == ["commit", "onto", "onto", "other", "other"]


def test_settings():
    m = {"namespace": "https://a.example/k", "trackers": [{"team": "AB", "comment_headings": ["Plan:"], "bot_users": ["CI"]}]}
    c = configured(m, {})
    assert (c.onto, c.teams, c.comment_headings, c.bot_users) == ("https://a.example/k/onto#", ("AB",), ("Plan:",), ("ci",))
    assert configured(m, {"KG_NAMESPACE": "https://b.example/"}).namespace == "https://b.example/"
    assert configured({}, {}).namespace == K.DEFAULT_NAMESPACE
    assert paths({"KG_DATA_DIR": "/d"}).graph == "/d/graph" and paths({"KG_DATA_DIR": "/d", "KG_TRIG": "/t"}).graph == "/t" and paths({}).vectors == "out/vectors"
