"""The manifest of sources: loading, checks, tiers and paths."""

from __future__ import annotations

import os
from pathlib import Path


def load(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}


#: Fixed values.
KINDS, TIERS = ("linear", "jira"), ("primary", "secondary")


def slug_problem(value: object) -> bool:
    """Whether a value isn't of the form owner/name."""
    halves = str(value).split("/")
    return len(halves) != 2 or not all(halves)


def rows_of(m: dict, key: str, out: list[str]) -> list[tuple[str, dict]]:
    """(name, entry) of a list of mappings; what isn't one goes to out."""
    own = m.get(key)
    if own is None:
        return []
    if not isinstance(own, list):
        out.append(f"{key} must be a list, not {type(own).__name__}")
        return []
    out += [f"{key}[{i}] must be a mapping" for i, x in enumerate(own) if not isinstance(x, dict)]
    return [(f"{key}[{i}]", x) for i, x in enumerate(own) if isinstance(x, dict)]


def repo_problems(name: str, entry: dict) -> list[str]:
    if entry.get("slug") is None:
        return [f"{name} needs a slug"]
    return [f"{name}.slug must be owner/name, not {entry['slug']!r}"] if slug_problem(entry["slug"]) else []


def tracker_problems(name: str, t: dict) -> list[str]:
    tests = (
        (isinstance(t.get("team"), str) and t["team"] != "", "needs a team, a text that isn't empty"),
        (t.get("kind") in KINDS, f"kind must be one of {', '.join(KINDS)}, not {t.get('kind')!r}"),
        (t.get("tier") is None or t["tier"] in TIERS, f"tier must be one of {', '.join(TIERS)}, not {t.get('tier')!r}"),
        (t.get("comment_headings") is None or isinstance(t["comment_headings"], list), "comment_headings must be a list"),
    )
    return [f"{name}: {says}" for ok, says in tests if not ok]


def problems(m: object) -> list[str]:
    """Messages about what is wrong; none if the manifest can be used."""
    if not isinstance(m, dict):
        return ["the manifest isn't a mapping"]
    out: list[str] = []
    code = m.get("code_repo")
    if isinstance(code, dict):
        out += repo_problems("code_repo", code)
    elif code is not None and not isinstance(code, str):
        out.append(f"code_repo must be a text or a mapping, not {type(code).__name__}")
    elif code is not None and slug_problem(code):
        out.append(f"code_repo must be owner/name, not {code!r}")
    for name, entry in rows_of(m, "secondary_repos", out):
        out += repo_problems(name, entry)
    found = rows_of(m, "trackers", out)
    for name, t in found:
        out += tracker_problems(name, t)
    teams = [t["team"] for _, t in found if isinstance(t.get("team"), str) and t["team"]]
    out += [f"trackers: team {x!r} is listed twice" for x in dict.fromkeys(teams) if teams.count(x) > 1]
    for name, s in rows_of(m, "docs_sites", out):
        if not str(s.get("root_url", "")).startswith(("http://", "https://")):
            out.append(f"{name} needs an absolute root_url")
        out += [f"{name}: {k} must be a number of 0 or more" for k in ("max_depth", "max_pages") if s.get(k) is not None and (not isinstance(s[k], int) or s[k] < 0)]
    out += [f"{name} needs a name" for name, s in rows_of(m, "mcp_sources", out) if not s.get("name")]
    return out


def secondary(m: dict, main: str | None = None) -> tuple[list[dict], list[str]]:
    """(the secondary repositories, the slugs that were listed before): the first of each slug counts, the main one's not at all."""
    first: dict[str, dict] = {}
    repeated = []
    for x in m.get("secondary_repos") or []:
        if x["slug"] == main or x["slug"] in first:
            repeated.append(x["slug"])
        else:
            first[x["slug"]] = x
    return list(first.values()), repeated


def trackers(m: dict, tier: str | None = None) -> list[dict]:
    """The trackers, of one tier or of all; an entry without tier is primary."""
    return [t for t in m.get("trackers") or [] if tier is None or (t.get("tier") or "primary") == tier]


def repo_path(entry: dict, base: str) -> str | None:
    """Where a repository is checked out: its own path, or a folder of its name beside the base."""
    own = entry.get("path") or str(entry.get("slug", "")).split("/")[-1]
    own = own if os.path.isabs(own) else os.path.join(base, own)
    return own if os.path.isdir(own) else None
