"""The guard before a snapshot is published: no part may shrink too much."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
ZERO_SHRINK, THRESHOLD, PASS, REFUSE = ("issue.nt", "comment.nt"), 0.5, 0, 3


def evaluate(previous: DataFrame, new: DataFrame, issue_count: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """(part, prev, new, ratio, status) from counts (part, n); a part that is missing counts 0, one without a past is new."""
    rows = previous.select("part", F.col("n").alias("prev")).join(new.select("part", F.col("n").alias("new")), "part", "full").fillna(0, ["prev", "new"])
    exact = F.col("part").isin(*ZERO_SHRINK) & F.lit(issue_count > 0)
    shrunk = F.when(exact, F.col("new") < F.col("prev")).otherwise(F.col("new") < F.col("prev") * F.lit(float(threshold)))
    status = F.when(F.col("prev") == 0, "new").when(shrunk, "refuse").otherwise("pass")
    return rows.select("part", "prev", "new", F.when(F.col("prev") > 0, F.col("new") / F.col("prev")).alias("ratio"), status.alias("status")).orderBy("part")


def verdict(rows: DataFrame, issue_count: int = 0, threshold: float = THRESHOLD) -> dict:
    """The verdict, the rows and the first refusal in the order of parts."""
    got = [r.asDict() for r in rows.orderBy("part").toLocalIterator()]
    bad = next((r for r in got if r["status"] == "refuse"), None)
    why = None
    if bad:
        head = f"{bad['part']}: shrank from {bad['prev']} to {bad['new']} lines"
        exact = bad["part"] in ZERO_SHRINK and issue_count > 0
        why = f"{head} (zero-shrink rule; issue_count={issue_count})" if exact else f"{head} ({bad['ratio'] * 100:.1f}% of previous, below {threshold * 100:.0f}% threshold)"
    return {"verdict": "refuse" if bad else "pass", "rows": got, "refusal": why}


def render(v: dict, as_json: bool = False) -> str:
    if as_json:
        return json.dumps(v)
    out = [f"{'part':<24}{'prev':>10}{'new':>10}{'ratio':>8}  status"]
    out += [f"{r['part']:<24}{r['prev']:>10}{r['new']:>10}{'-' if r['ratio'] is None else format(r['ratio'], '.2f'):>8}  {r['status']}" for r in v["rows"]]
    return "\n".join([*out, f"verdict: {v['verdict']}", *([v["refusal"]] if v["refusal"] else [])])


def exit_code(v: dict) -> int:
    return REFUSE if v["verdict"] == "refuse" else PASS


def comments_complete(errors: int, pulls: int, rate_limited: bool) -> bool:
    """Whether enough pull requests gave their comments: no rate limit, and errors on a tenth at most."""
    return not rate_limited and not (errors and errors / max(pulls, 1) > 0.1)
