"""What git lists, landed by the driver and shaped by plans."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.markup import doc_meta
from ..functions.text import any_of, glob_regex

#: Fixed values.
DOC_SUFFIXES, SEPARATOR, HEAD_CHARS = ("md", "mdx", "rst", "txt"), "\x1f", 4096
LOG_FORMAT = "%H%x1f%an%x1f%ae%x1f%aI%x1f%s"


def run_git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, text=True, check=True).stdout


def head_of(repo: str) -> tuple[str, str]:
    """(branch, commit) that is checked out; without commits HEAD and nothing."""
    out = []
    for args, none in ((("rev-parse", "--abbrev-ref", "HEAD"), "HEAD"), (("rev-parse", "HEAD"), "")):
        try:
            out.append(run_git(repo, *args).strip())
        except (subprocess.CalledProcessError, OSError):
            out.append(none)
    return out[0], out[1]


def land_listing(spark: SparkSession, repo: str) -> DataFrame:
    """(value): a line for each tracked file."""
    return spark.createDataFrame([(x,) for x in run_git(repo, "ls-files").splitlines() if x.strip()], "value string")


def land_log(spark: SparkSession, repo: str, most: int | None = None) -> DataFrame:
    """(value): a line for each commit; most: newest only."""
    args = ["log", f"--pretty=format:{LOG_FORMAT}", *([f"-n{most}"] if most is not None else [])]
    return spark.createDataFrame([(x,) for x in run_git(repo, *args).splitlines()], "value string")


def listed_files(lines: DataFrame, slug: str, exclude: Sequence[str] = ()) -> DataFrame:
    """(slug, path, is_doc): documents by suffix; the globs leave out documents only."""
    path = F.trim("value")
    doc = F.lower(F.substring_index(F.substring_index(path, "/", -1), ".", -1)).isin(*DOC_SUFFIXES) & F.contains(F.substring_index(path, "/", -1), F.lit("."))
    out = lines.select(F.lit(slug).alias("slug"), path.alias("path"), doc.alias("is_doc")).where("path != ''")
    return out.where(~(F.col("is_doc") & any_of([F.col("path").rlike(glob_regex(g)) for g in exclude]))) if exclude else out


def logged_commits(lines: DataFrame, slug: str) -> DataFrame:
    """(slug, sha, author, email, date, subject); lines without five fields are passed by."""
    x = F.split("value", SEPARATOR)
    return lines.where(F.size(x) == 5).select(F.lit(slug).alias("slug"), x[0].alias("sha"), x[1].alias("author"), x[2].alias("email"), x[3].alias("date"), x[4].alias("subject"))


def doc_heads(files: DataFrame, texts: DataFrame) -> DataFrame:
    """files with title and detail, from the first characters of texts (path, text); unreadable ones have their stem."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    title, detail = doc_meta(F.coalesce("text", F.lit("")), stem)
    docs = files.where("is_doc").join(texts.select("path", F.substring("text", 1, HEAD_CHARS).alias("text")), "path", "left").withColumn("title", title).withColumn("detail", detail)
    none = F.lit(None).cast("string")
    return docs.select("slug", "path", "is_doc", "title", "detail").unionByName(files.where("not is_doc").select("slug", "path", "is_doc", none.alias("title"), none.alias("detail")))
