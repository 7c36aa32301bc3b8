"""Deployment settings, passed to what needs them; never module state."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: The review and tracker conventions that the data follows.
LEARNING_MARKERS = ("ai-implement-build-up-learnings", "ai-implement-build-down-learnings", "build-down-learnings", "build-up-learnings", "ai-implement-kg-refresh-learnings")
LIFECYCLE_LABELS = ("ai-implement", "ai-planning", "ai-working", "plan-complete", "ready for review")
SMOKE_HEADING = "## \U0001f525 Smoke-Jumper Report"
PLANNING_HEADING = "AI Planning:"
CODEX_MARKERS = ("codex-code-review-finding:v1", "codex-review-receipt:v1", "codex-review-state:v1")
FINDING_MARKER = "<!-- ai-implement review-finding:v1 -->"
NATIVE_REVIEW_MARKER = "<!-- ai-implement native-review -->"
VERDICT_MARKER = "<!-- claude-review-verdict"
POST_PUSH_MARKER = "<!-- ai-implement post-push"
POST_PUSH_START = "<!-- ai-implement post-push status=start"
DECISION_MIN_CHARS = 400
DEFAULT_NAMESPACE = "https://example.org/kg/"


@dataclass(frozen=True)
class GraphConfig:
    namespace: str = DEFAULT_NAMESPACE
    teams: tuple[str, ...] = ()
    comment_headings: tuple[str, ...] = ()
    bot_users: tuple[str, ...] = ()
    doc_exclude: tuple[str, ...] = ()
    pipeline_ver: str = "0.1.0"
    title_chars: int = 300
    issue_title_chars: int = 400
    fix_chars: int = 400
    detail_chars: int = 2000
    description_chars: int = 4000
    snippet_chars: int = 400
    section_snippet_chars: int = 1200

    def __post_init__(self):
        if not self.namespace.endswith("/"):
            object.__setattr__(self, "namespace", self.namespace + "/")

    @property
    def onto(self) -> str:
        return self.namespace + "onto#"

    @property
    def resource(self) -> str:
        return self.namespace + "resource/"

    @property
    def spine(self) -> str:
        return self.resource + "graph/spine"


def configured(manifest: dict | None = None, env: dict | None = None) -> GraphConfig:
    """The settings of a manifest; the variable KG_NAMESPACE beats its namespace, which beats the default."""
    m, env = manifest or {}, os.environ if env is None else env
    teams = tuple(t["team"] for t in m.get("trackers") or [] if t.get("team"))
    both = [m, *(m.get("trackers") or [])]  # for all trackers, or for one
    headings = tuple(h for t in both for h in t.get("comment_headings") or [])
    bots = tuple(b.lower() for t in both for b in t.get("bot_users") or [])
    ns = (env.get("KG_NAMESPACE") or "").strip() or str(m.get("namespace") or DEFAULT_NAMESPACE)
    return GraphConfig(namespace=ns, teams=teams, comment_headings=headings, bot_users=bots, doc_exclude=tuple(m.get("doc_exclude") or ()))


@dataclass(frozen=True)
class Paths:
    """Where a stored graph and its vectors are: own setting, then the data folder, then the default."""

    graph: str
    vectors: str
    env: dict = field(default_factory=dict, repr=False, compare=False)


def paths(env: dict | None = None, default: str = "out") -> Paths:
    env = dict(os.environ) if env is None else env
    data = env.get("KG_DATA_DIR")
    pick = lambda own, name: env.get(own) or str(Path(data or default) / name)
    return Paths(pick("KG_TRIG", "graph"), pick("KG_NPZ", "vectors"), env)
