"""A build: every source to quads, the stored graph, its checks, parts, vectors and figures; and a refresh, which is a build behind a guard.

Sources are a repository's git data and documents, and landed responses in one folder (`Landed`). Each source is
forced on its own, into a table in the shared folder, so that one may fail without the others.
"""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import GraphConfig, configured
from .functions.iri import run_id_of
from .functions.markup import html_pages, markdown_pages
from .model import QUAD
from .operators import embed, explore, guard, incremental, snapshot, validate
from .operators.cards import build_cards
from .plans.construct import Construct, issue_comments
from .plans.graph import Graph
from .sources import docs, git, github, manifest, ntriples, site, tracker
from .storage import fresh_dir

#: Folders of a repository's documents, fixed.
SOLUTIONS, DECISIONS, PLANS = "docs/solutions", "docs/adr", ("docs/plans", "docs/superpowers/plans")
COMMENT = "number long, title string, ordinal long, id long, body string, login string, created_at string"


@dataclass(frozen=True)
class Landed:
    """Where responses were landed, each a folder of JSON lines: pulls, pull_comments, review_comments, reviews, threads,
    issues (a tracker's export), sites/<host> (url, html) and resources/<server> (ordinal, uri, mime, text)."""

    folder: str | None

    def __call__(self, *names: str) -> str | None:
        path = os.path.join(self.folder, *names) if self.folder else None
        return f"file://{os.path.abspath(path)}" if path and os.path.exists(path) else None

    def names(self, kind: str) -> list[str]:
        path = os.path.join(self.folder, kind) if self.folder else ""
        return sorted(os.listdir(path)) if os.path.isdir(path) else []


class Build:
    def __init__(self, spark: SparkSession, m: dict | None = None, landed: str | None = None, prior: Graph | None = None, now: str | None = None):
        self.spark, self.m, self.landed = spark, m or {}, Landed(landed)
        self.cfg: GraphConfig = configured(self.m)
        self.c = Construct(self.cfg)
        self.now = now or datetime.now(UTC).replace(microsecond=0).isoformat()
        self.prior, self.made, self.results = prior, [], []
        self.run = "none"

    def source(self, name: str, kind: str, make: Callable[[], DataFrame]) -> None:
        """Forces a source's quads; what fails is a result with its reason."""
        try:
            path = fresh_dir(self.spark, "source")
            make().write.parquet(path)
            own = self.spark.read.schema(QUAD).parquet(path)
            self.made.append(own)
            self.results.append({"source": name, "kind": kind, "status": "ok", "counts": {"quads": own.count()}})
        except Exception as e:
            self.results.append({"source": name, "kind": kind, "status": "failed", "reason": str(e)[:300], "counts": {}})

    # --- one repository ---
    def repository(self, slug: str, path: str, most: int | None = None, branch: str | None = None, default: bool | None = None, docs_url: str | None = None) -> None:
        """Its node, files, commits and documents; the pulls and their talk are landed for the main repository only."""
        spark, c = self.spark, self.c
        head = git.head_of(path)
        row = (slug, branch or head[0], bool(default), head[1], docs_url)
        self.source(f"{slug}: repository", "git", lambda: c.repos(spark.createDataFrame([row], "slug string, history_branch string, is_default_branch boolean, snapshot_ref string, docs_url string")))
        self.source(f"{slug}: commits", "git", lambda: c.commits(git.logged_commits(git.land_log(spark, path, most), slug)))
        files = lambda: git.listed_files(git.land_listing(spark, path), slug, self.cfg.doc_exclude)
        texts = lambda folder="", recursive=True: docs.markdown_files(spark, f"file://{os.path.join(path, folder)}".rstrip("/"), slug, recursive, f"file://{path}")
        self.source(f"{slug}: files", "git", lambda: c.files(git.doc_heads(files(), texts().select("path", "text"))))
        for folder, kind, make in (
            (SOLUTIONS, "solutions", lambda t: c.solutions(docs.folded(docs.front_matter(t), self.cfg.teams), self.run)),
            (DECISIONS, "decisions", lambda t: c.adrs(t, self.run)),
            *((p, "plans", lambda t: c.plans(docs.front_matter(t), self.run)) for p in PLANS),
        ):
            if os.path.isdir(os.path.join(path, folder)):
                self.source(f"{slug}: {folder}", kind, lambda folder=folder, kind=kind, make=make: make(texts(folder, kind == "solutions")))

    def pulls(self, slug: str, path: str | None) -> None:
        """Pull requests, their comments and reviews."""
        spark, c, at = self.spark, self.c, self.landed
        if not at("pulls"):
            return
        commits = lambda: git.logged_commits(git.land_log(spark, path), slug).select("slug", "sha") if path else spark.createDataFrame([], "slug string, sha string")
        self.source(f"{slug}: pulls", "pulls", lambda: c.pulls(github.pulls(spark, at("pulls"), slug), commits()))
        if at("pull_comments"):
            self.source(f"{slug}: pull comments", "pulls", lambda: c.pull_comments(spark.read.schema(COMMENT).json(at("pull_comments")).withColumn("slug", F.lit(slug)), self.run))
        states = github.thread_states(spark.read.schema("comment_id long, resolved boolean, outdated boolean").json(at("threads"))) if at("threads") else None
        for name, body in (("review_comments", False), ("reviews", True)):
            if at(name):
                self.source(f"{slug}: {name}", "pulls", lambda name=name, body=body: c.reviews(github.reviews_of_all(spark, at(name), slug), self.run, body, None if body else states))

    # --- tracker, sites, resources ---
    def issues(self, path: str) -> None:
        rows = lambda: tracker.issues(tracker.raw_records(self.spark, path))
        self.source("tracker: issues", "tracker", lambda: self.c.issues(rows()))
        self.source("tracker: comments", "tracker", lambda: self.c.comments(issue_comments(rows()), self.run))
        try:
            lacking = {r["field"]: r["n"] for r in tracker.missing_fields(tracker.raw_records(self.spark, path)).where("n > 0").collect()}  # a row a field
            self.results[-2]["counts"] |= {f"without {k}": n for k, n in lacking.items()}
        except Exception as e:
            self.results[-2].setdefault("reason", str(e)[:300])

    def sites(self) -> None:
        own = {str(s.get("root_url", "")).split("://")[-1].split("/")[0]: s for s in self.m.get("docs_sites") or []}
        for host in self.landed.names("sites"):
            s = own.get(host, {})
            root = s.get("root_url") or f"https://{host}"
            cfg = site.CrawlConfig(root, tuple(s.get("include") or ()), tuple(s.get("exclude") or ()), s.get("max_depth", 4), s.get("max_pages", 300))

            def make(host=host, s=s, root=root, cfg=cfg) -> DataFrame:
                raw = self.spark.read.schema("url string, html string").json(self.landed("sites", host))
                reached = raw.join(site.crawl(raw, cfg).select("url"), "url", "left_semi")
                pages = incremental.refreshed_pages(reached, incremental.prior_pages(self.prior), html_pages) if self.prior is not None else html_pages(reached)
                return self.c.pages(pages, root, s.get("title") or host, self.now, s.get("branch"), s.get("docs_of"))

            self.source(f"site: {host}", "docs", make)

    def resources(self) -> None:
        for server in self.landed.names("resources"):

            def make(server=server) -> DataFrame:
                raw = self.spark.read.schema("ordinal long, uri string, mime string, text string").json(self.landed("resources", server))
                return self.c.pages(markdown_pages(site.text_resources(raw)), server, server, self.now, server=server)

            self.source(f"resources: {server}", "resources", make)

    # --- all of it ---
    def all(self, repo: str | None = None, slug: str | None = None, export: str | None = None, repos_root: str | None = None, most: int | None = None) -> Graph:
        """The graph of the manifest's sources, or of those that are named."""
        code = self.m.get("code_repo") or {}
        code = {"slug": code} if isinstance(code, str) else code
        slug, repo = slug or code.get("slug") or (repo.rstrip("/").split("/")[-1] if repo else None), repo or code.get("path")
        self.run = run_id_of(self.cfg.pipeline_ver, f"{slug} {git.head_of(repo)[1] if repo else ''} {export or ''}")
        if repo:
            self.repository(slug, os.path.abspath(repo), most, code.get("history_branch"), code.get("is_default_branch"), code.get("docs_url"))
        if slug:
            self.pulls(slug, repo)
        others, repeated = manifest.secondary(self.m, slug)
        for entry in others:
            path = manifest.repo_path(entry, repos_root or os.path.dirname(os.path.abspath(repo or ".")))
            if path:
                self.repository(entry["slug"], path, most, entry.get("history_branch"), entry.get("is_default_branch"), entry.get("docs_url"))
            else:
                self.results.append({"source": entry["slug"], "kind": "git", "status": "failed", "reason": "not checked out", "counts": {}})
        self.results += [{"source": s, "kind": "git", "status": "skipped", "reason": "listed before", "counts": {}} for s in repeated]
        for path in filter(None, (export, self.landed("issues"))):
            self.issues(path)
        self.sites()
        self.resources()
        g = ntriples.empty_graph(self.spark, self.cfg).added(self.c.run(self.spark, self.run), *self.made)
        return Graph(g.quads.unionByName(self.c.stamp(self.spark, self.now)), self.cfg)

    def failed(self) -> bool:
        return any(r["status"] == "failed" for r in self.results)


def counts_at(spark: SparkSession, where: str) -> DataFrame:
    """(part, n) of a folder of parts, or of `<ref>:<path>` in the repository at hand."""
    from .operators.aggregates import part_counts

    ref, _, path = where.partition(":")
    if not path or path.startswith("//"):
        text = spark.read.text(where)
        return part_counts(text.select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("line")))
    names = [x for x in subprocess.run(["git", "ls-tree", "--name-only", ref, path.rstrip("/") + "/"], capture_output=True, text=True, check=True).stdout.splitlines() if x.endswith(".nt")]
    rows = []
    for name in names:  # a file at a time; of its lines only the number stays
        with subprocess.Popen(["git", "show", f"{ref}:{name}"], stdout=subprocess.PIPE, text=True, encoding="utf-8", errors="replace") as p:
            rows.append((name.rsplit("/", 1)[-1], sum(1 for line in p.stdout if line.strip())))
    own = spark.createDataFrame(rows, "name string, n long")
    return own.groupBy(F.regexp_replace("name", r"^(.+)\.\d+\.nt$", "$1.nt").alias("part")).agg(F.sum("n").alias("n")).orderBy("part")


def publish(spark: SparkSession, g: Graph, parts: str, vectors: str, previous: str | None = None, issue_count: int = 0, embedder: embed.Embedder | None = None, began: float | None = None) -> dict:
    """Violations, the guard's verdict and, unless it refuses, parts, digest, vectors and the line of figures."""
    began = began or time.time()
    broken = validate.violations(g).count()
    tmp = f"{parts}.new"
    snapshot.export_parts(g, tmp)
    new = counts_at(spark, f"file://{os.path.abspath(tmp)}")
    verdict = None
    if previous:
        verdict = guard.verdict(guard.evaluate(counts_at(spark, previous), new, issue_count), issue_count)
        if verdict["verdict"] == "refuse":
            return {"violations": broken, "guard": verdict, "published": False}
    snapshot.swap(tmp, parts)
    with open(os.path.join(os.path.dirname(os.path.abspath(parts)), "digest.md"), "w", encoding="utf-8") as f:
        f.write(snapshot.digest(g))
    embed.write_index(build_cards(g), vectors, embedder or embed.HashingEmbedder(), ntriples.stamp_of(g) or "")
    index = embed.read_index(spark, vectors)
    stats = snapshot.refresh_stats(counts_at(spark, f"file://{os.path.abspath(parts)}"), index[0] if index else None, [parts, vectors], time.time() - began)
    return {"violations": broken, "guard": verdict, "published": True, "derivedLearnings": explore.derived_from_docs(g), "stats": stats}


def write_results(path: str, results: list[dict]) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(results, f, indent=2)
