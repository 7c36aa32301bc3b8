"""Text rules as column expressions: first lines, classification, titles, severities, enumerations, references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as K

#: Line ends as Python's splitlines has them.
LINES = r"\r\n|[\n\r\x0B\f\x1C-\x1E\u0085  ]"
#: Symbols that don't count as words of a heading.
EMOJI = r"^[\p{So}\p{Sk}\p{Sm}\p{Mn}\x{200D}\x{FE0F}\x{20E3}]+$"


def stripped(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(body: Column) -> Column:
    return F.transform(F.split(body, LINES), stripped)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def holds_any(c: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(c, F.lit(w)) for w in words])


def raw_first(body: Column) -> Column:
    """The first line that isn't blank, or the empty string."""
    return F.coalesce(F.get(F.filter(lines(body), lambda s: s != ""), 0), F.lit(""))


def heading_text(s: Column) -> Column:
    return stripped(F.regexp_replace(s, "^#+", ""))


def first_line(body: Column) -> Column:
    """The first line with substance: no blank, no whole-line comment, no heading of one word (symbols aren't words)."""
    words = lambda s: F.filter(F.split(heading_text(s), r"(?U)\s+"), lambda w: (w != "") & ~w.rlike(EMOJI))
    kept = F.filter(lines(body), lambda s: (s != "") & ~(s.startswith("<!--") & s.endswith("-->")) & (~s.startswith("#") | (F.size(words(s)) > 1)))
    first = F.get(kept, 0)
    return F.coalesce(F.when(first.startswith("#"), heading_text(first)).otherwise(first), F.lit(""))


def has_learning_marker(body: Column) -> Column:
    return holds_any(F.lower(heading_text(raw_first(body))), K.LEARNING_MARKERS)


def classify(body: Column, headings: tuple[str, ...] = (), is_bot: Column | None = None) -> Column:
    """The kind of a tracker comment, or null: learning, verification, planning_note, implementation_note, decision."""
    bot = F.lit(False) if is_bot is None else is_bot
    first = raw_first(body)
    summary = stripped(body).startswith("## Summary") & body.rlike(r"(?m)^## (Approach|Test plan)")
    out = F.when(has_learning_marker(body), "learning").when(first.startswith(K.SMOKE_HEADING), "verification")
    out = out.when(any_of([first.startswith(h) for h in headings]), "planning_note")
    out = out.when(bot & (F.contains(first_line(body), F.lit("Implementation Summary")) | summary), "implementation_note")
    return out.when(~bot & (F.length(stripped(body)) >= K.DECISION_MIN_CHARS), "decision")


def classify_pull_comment(body: Column, login: Column) -> Column:
    """The kind of a conversation comment, or null: learning, verification, decision."""
    low = F.lower(login)
    bot = low.endswith("[bot]") | (low == "ai-implement-orchestrator-bot")
    has = lambda m: F.contains(body, F.lit(m))
    out = F.when(has_learning_marker(body), "learning").when(raw_first(body).startswith(K.SMOKE_HEADING) | has(K.VERDICT_MARKER), "verification")
    out = out.when(has(K.POST_PUSH_MARKER) & ~has(K.POST_PUSH_START), "verification")
    return out.when(~bot & (F.length(stripped(body)) >= K.DECISION_MIN_CHARS), "decision")


def strip_markup(c: Column) -> Column:
    """Plain text, roughly: comments, tags, code, images, links and emphasis in this order."""
    for pattern, to in ((r"(?s)<!--.*?-->", ""), (r"<[^>]+>", ""), (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\*{1,3}|_{1,3}", "")):
        c = F.regexp_replace(c, pattern, to)
    return stripped(c)


def strip_badges(c: Column) -> Column:
    """Images as their alternative text."""
    return stripped(F.regexp_replace(c, r"!\[([^\]]*)\]\([^)]*\)", "$1"))


def reviewer_kind(login: Column, body: Column) -> Column:
    low = F.lower(login)
    has = lambda m: F.contains(body, F.lit(m))
    claude = (low == "github-actions[bot]") & (has(K.VERDICT_MARKER) | F.contains(F.lower(body), F.lit("claude review")))
    out = F.when((low == "chatgpt-codex-connector[bot]") | holds_any(body, K.CODEX_MARKERS), "codex").when((low == "claude[bot]") | claude, "claude")
    out = out.when(has(K.FINDING_MARKER) | has(K.NATIVE_REVIEW_MARKER), "ai-implement")
    return out.when(low.endswith("[bot]") | low.endswith("-bot") | F.contains(low, F.lit("bot]")), "other-bot").otherwise("human")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def severity(body: Column, kind: Column, state: Column) -> Column:
    low = F.lower(body)
    has = lambda m: F.contains(body, F.lit(m))
    claude = F.when(has("\U0001f534"), "blocking").when(has("\U0001f7e1"), "warning").otherwise(F.lower(first_match(body, r"(?iU)severity[:\s]+(\w+)")))
    own = F.when(F.contains(low, F.lit("[blocking]")), "blocking").when(F.contains(low, F.lit("[medium]")), "medium").when(F.contains(low, F.lit("[minor]")), "minor")
    out = F.when(kind == "codex", first_match(body, r"\b(P0|P1|P2)\b")).when(kind == "claude", claude).when(kind == "ai-implement", own)
    return F.coalesce(out.when((kind == "human") & (state == "CHANGES_REQUESTED"), "changes_requested"), F.lit("unknown"))


#: Texts that only approve.
APPROVAL = r"(?i)^(lgtm|👍|looks good to me|thanks?!?|thank you!?|:thumbsup:|✅|shipit|:ship:|:\+1:)[\s!.,]*$"


def keep_review(body: Column, login: Column, is_review_body: Column, state: Column) -> dict[str, Column]:
    """keep, reviewer_kind and severity of a review item."""
    kind = reviewer_kind(login, body)
    plain = strip_markup(body)
    has = lambda m: F.contains(body, F.lit(m))
    marker = holds_any(body, K.CODEX_MARKERS) | has(K.FINDING_MARKER) | has(K.NATIVE_REVIEW_MARKER) | has(K.VERDICT_MARKER)
    enough = (F.length(plain) >= 20) | marker | (is_review_body & F.coalesce(state == "CHANGES_REQUESTED", F.lit(False)))
    return {"keep": ~has(K.POST_PUSH_START) & ~plain.rlike(APPROVAL) & enough, "reviewer_kind": kind, "severity": severity(body, kind, state)}


def comment_title(key: Column, issue_title: Column, body: Column, kind: Column) -> Column:
    low = F.lower(heading_text(raw_first(body)))
    phase = F.when(F.contains(low, F.lit("build-down")), "build-down learnings").when(F.contains(low, F.lit("build-up")), "build-up learnings").otherwise("learnings")
    tail = F.when(issue_title != "", F.concat(F.lit(" — "), issue_title)).otherwise("")
    line = first_line(body)
    marked = F.contains(body, F.lit(K.POST_PUSH_MARKER)) | F.contains(body, F.lit(K.VERDICT_MARKER))
    out = F.when((kind == "learning") & has_learning_marker(body), F.concat(key, F.lit(" "), phase, tail))
    out = out.when((kind == "verification") & marked, F.when(line != "", F.concat(key, F.lit(" review: "), line)).otherwise(F.concat(key, F.lit(" review"))))
    out = out.when(kind == "implementation_note", F.concat(key, F.lit(" implementation summary")))
    return out.otherwise(F.when(line != "", F.concat(key, F.lit(": "), line)).otherwise(F.concat(key, F.lit(" note"))))


# three rules for bots, each for its own data
def is_bot_login(login: Column) -> Column:
    """Of a commit or pull request author."""
    low = F.lower(login)
    return low.endswith("[bot]") | F.contains(low, F.lit("bot]")) | low.endswith("-bot")


def is_bot_name(name: Column, bot_users: tuple[str, ...] = ()) -> Column:
    """Of a tracker user; a null or empty name is none."""
    low = F.lower(name)
    return F.coalesce((name != "") & (low.isin(*bot_users) | low.endswith("bot") if bot_users else low.endswith("bot")), F.lit(False))


def priority(raw: Column) -> Column:
    return F.concat(F.lit("P"), first_match(raw, r"(?i)\bP\s?([0-3])\b"))


#: Fixed values.
LEVELS = ("critical", "high", "medium", "low", "info", "improvement", "enhancement", "major", "minor")
CATEGORY_ALIASES = {
    "feature-pattern": "feature-patterns",
    "architecture-pattern": "architecture-patterns",
    "logic-error": "logic-errors",
    "database-issue": "database-issues",
    "integration-issue": "integration-issues",
    "runtime-error": "runtime-errors",
    "feature-implementation": "feature-patterns",
    "feature": "feature-patterns",
}
DONE = ("complete", "completed", "resolved", "done", "fixed", "closed", "verified", "confirmed")
OPEN = ("pending", "open", "found", "planned")
IN_PROGRESS = ("in-progress", "in_progress", "wip")


def severity_level(raw: Column) -> Column:
    low = F.lower(stripped(raw))
    return F.when(low.isin(*LEVELS), low)


def category(raw: Column) -> Column:
    c = F.translate(F.lower(stripped(raw)), "_ ", "--")
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), list(CATEGORY_ALIASES.items())[1:], F.when(c == next(iter(CATEGORY_ALIASES)), next(iter(CATEGORY_ALIASES.values())))).otherwise(c)


def status(raw: Column) -> Column:
    s = F.lower(stripped(raw))
    return F.when(s.isin(*DONE), "done").when(s.isin(*OPEN), "open").when(s.isin(*IN_PROGRESS), "in-progress").when(s == "wont_fix", "wont-fix").otherwise(s)


def refs(c: Column) -> Column:
    """Numbers after #, in order."""
    return F.regexp_extract_all(c, F.lit(r"#(\d+)"), F.lit(1))


def tracker_keys(c: Column, teams: tuple[str, ...] = ()) -> Column:
    """Keys like ABC-123 of the configured teams, or of any, upper-cased, in order."""
    team = "|".join("\\Q" + t + "\\E" for t in teams) if teams else "[A-Z][A-Z0-9]{1,9}"
    return F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)\b(?:{team})-\d+\b"), F.lit(0)), F.upper)


def tags(c: Column) -> Column:
    """Comma or line separated tags, with or without brackets; lower case, quotes off."""
    parts = F.split(F.regexp_replace(c, r"^[\[\]]+|[\[\]]+$", ""), "[,\n]")
    return F.transform(F.filter(parts, lambda t: stripped(t) != ""), lambda t: F.lower(F.regexp_replace(stripped(t), "^['\"]+|['\"]+$", "")))


def first_date(c: Column) -> Column:
    """The first ISO date; one that isn't in the calendar gives null."""
    return F.try_to_date(first_match(c, r"(\d{4}-\d{2}-\d{2})"), "yyyy-MM-dd")


def heading_anchor(c: Column) -> Column:
    s = F.regexp_replace(F.lower(c), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(stripped(s), r"(?U)[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(s, "-+", "-"), "^-+|-+$", "")


def first_of(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def card_text(title: Column, extras: list[Column], snippet: Column) -> Column:
    """Title, extras and snippet by line, empty ones left out."""
    return F.concat_ws("\n", title, *(F.when(e != "", e) for e in [*extras, snippet]))


def url_no_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def same_site(url: Column, root: str) -> Column:
    base = root.rstrip("/")
    return (url == base) | url.startswith(base + "/")


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for whole paths; * crosses /."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and ord(c) < 128 else c
        i += 1
    return f"(?s)^{out}$"
