"""Markdown documents with front matter: solutions, decision records, plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

#: Raw keys of front matter by the field that they are folded to.
FIELDS = {
    "component": ("component", "components", "module", "modules", "modules_affected", "affected_components", "affected_files", "related_components", "files_changed", "files_modified", "files_affected", "key_function"),
    "symptom": ("symptom", "symptoms"),
    "root_cause": ("root_cause", "root_causes", "root_cause_summary"),
    "problem_type": ("problem_type",),
    "fix": ("fix", "solution", "resolution", "solution_summary", "resolution_summary"),
    "resolution_type": ("resolution_type",),
    "impact": ("impact", "financial_impact"),
    "found_date": ("date", "date_solved", "date_resolved", "date_discovered", "date_found", "incident_date", "found_date", "resolution_date"),
    "learning_id": ("learning_id", "learning_ids"),
    "status": ("status",),
    "category": ("category",),
    "severity": ("severity", "priority"),
    "title": ("title",),
    "tags": ("tags", "keywords"),
    "issues": ("issue", "issues", "github_issue", "github_issues", "related_issues", "related_github_issues", "issues_fixed", "review_issues", "followup_issues"),
    "prs": ("pr", "prs", "related_pr", "related_prs", "pull_requests", "pr_number", "parent_pr", "case_study_pr"),
    "regressing_pr": ("regressing_pr", "regressing"),
    "fix_commit": ("fix_commit",),
    "regressing_commit": ("regressing_commit",),
    "related_solutions": ("related_solutions", "related_docs", "related"),
    "related_learnings": ("related_learnings", "related_findings"),
    "supersedes": ("supersedes",),
    "recurrence_of": ("recurrence_of", "recurs"),
    "follow_up_to": ("follow_up_to",),
}
LISTS = ("issues", "prs", "tags", "tracker", "related_solutions", "related_learnings")


def markdown_files(spark: SparkSession, folder: str, slug: str, recursive: bool = True, base: str | None = None) -> DataFrame:
    """(slug, path, stem, text) of the folder's .md files; path is relative to base, the folder itself by default."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    path = F.regexp_replace(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"^file:/+", "/")
    base = (base or folder).removeprefix("file://").rstrip("/") + "/"
    rel = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    return files.select(F.lit(slug).alias("slug"), rel.alias("path"), F.regexp_replace(F.substring_index(rel, "/", -1), r"\.md$", "").alias("stem"), F.decode("content", "UTF-8").alias("text"))


def front_matter(df: DataFrame) -> DataFrame:
    """df (slug, path, stem, text) with raw: key to values as text, in the order written; null where there is none or it is malformed."""

    def one(text: str | None) -> list[tuple[str, list[str], bool]] | None:
        import yaml

        lines = (text or "").splitlines()
        if not lines or lines[0].strip() != "---":
            return None
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), None)
        try:
            got = yaml.safe_load("\n".join(lines[1:end])) if end else None
        except (yaml.YAMLError, ValueError):
            return None
        if not isinstance(got, dict) or not got:
            return None
        return [(str(k).strip().lower(), [str(x) for x in v] if isinstance(v, list) else [] if v is None else [str(v)], isinstance(v, list)) for k, v in got.items()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["raw"] = [None if (m := one(t)) is None else [{"key": k, "vals": v, "many": many} for k, v, many in m] for t in b["text"]]
            yield b

    return df.select("slug", "path", "stem", "text").mapInPandas(run, "slug string, path string, stem string, text string, raw array<struct<key: string, vals: array<string>, many: boolean>>")


def folded(docs: DataFrame, teams: tuple[str, ...] = ()) -> DataFrame:
    """docs with meta: the raw keys folded to FIELDS, values normalised; documents without front matter are left out.

    The synonyms are a map in the plan. A field's later key beats an earlier one, but for dates, of which the first
    that is valid stays; lists are put together, sorted and distinct; other lists become one text.
    """
    names = F.create_map(*[F.lit(x) for field, keys in FIELDS.items() for k in keys for x in (k, field)])
    rows = docs.where("raw is not null").select("slug", "path", "stem", F.posexplode("raw").alias("pos", "r")).select("slug", "path", "stem", "pos", names[F.col("r.key")].alias("field"), F.col("r.vals").alias("vals"), F.col("r.many").alias("many"))
    rows = rows.where("field is not null")
    one, text = F.get("vals", 0), F.array_join(F.filter(F.transform("vals", X.stripped), lambda x: x != ""), "; ")
    each = lambda f: F.flatten(F.transform("vals", f))
    refs, keys = each(X.refs), each(lambda v: X.tracker_keys(v, teams))
    tags = F.when(F.col("many"), F.transform("vals", lambda t: F.lower(F.regexp_replace(X.stripped(t), "^['\"]+|['\"]+$", "")))).otherwise(X.tags(one))
    plain = F.filter(F.transform("vals", X.stripped), lambda x: x != "")
    pair = lambda f, v: F.struct(F.lit(f).alias("f"), v.alias("v"))
    scalar = lambda v: F.filter(F.array(v), lambda x: x.isNotNull())
    linked = F.col("field").isin("issues", "prs")
    out = F.when(linked, F.array(F.struct(F.col("field").alias("f"), refs.alias("v")), pair("tracker", keys)))
    out = out.when(F.col("field") == "tags", F.array(pair("tags", tags))).when(F.col("field").isin("related_solutions", "related_learnings"), F.array(F.struct(F.col("field").alias("f"), plain.alias("v"))))
    out = out.when(F.col("field") == "severity", F.array(pair("priority", scalar(X.priority(one))), pair("severity_level", scalar(X.severity_level(one)))))
    out = out.when(F.col("field") == "category", F.array(pair("category", scalar(X.category(one))))).when(F.col("field") == "status", F.array(pair("status", scalar(X.status(one)))))
    out = out.when(F.col("field") == "found_date", F.array(pair("found_date", scalar(X.first_date(one).cast("string")))))
    out = out.when(F.col("field") == "learning_id", F.array(pair("learning_id", scalar(F.regexp_replace(X.stripped(one), "^['\"\\[\\]]+|['\"\\[\\]]+$", "")))))
    out = out.otherwise(F.array(F.struct(F.col("field").alias("f"), scalar(F.when(F.col("many"), text).otherwise(one)).alias("v"))))
    flat = rows.select("slug", "path", "stem", "pos", F.explode(out).alias("x")).select("slug", "path", "stem", "pos", "x.f", "x.v")
    kept = flat.where(F.col("f").isin(*LISTS) | (F.size("v") > 0))
    first_wins = F.when(F.col("f") == "found_date", -F.col("pos")).otherwise(F.col("pos"))
    by_field = kept.groupBy("slug", "path", "stem", "f").agg(F.max_by("v", first_wins).alias("last"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("v")))).alias("all"))
    value = F.when(F.col("f").isin(*LISTS), F.col("all")).otherwise(F.col("last"))
    return by_field.groupBy("slug", "path", "stem").agg(F.map_from_entries(F.collect_list(F.struct("f", value))).alias("meta"))
