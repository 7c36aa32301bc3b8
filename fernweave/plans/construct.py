"""Rows of sources as quads. Each function is one projection and one explode; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import config as K
from ..config import GraphConfig
from ..functions import text as X
from ..functions.iri import Iris
from ..model import COMMENT, QUAD
from . import graph as G

XSD = "http://www.w3.org/2001/XMLSchema#"
STRING, INTEGER, BOOLEAN, DATETIME, DATE = (XSD + x for x in ("string", "integer", "boolean", "dateTime", "date"))
Fact = tuple[str, Column, str, str | None]


def iri(p: str, o: Column) -> Fact:
    return p, o, "iri", None


def lit(p: str, o: Column, dt: str | None = None) -> Fact:
    return p, o.cast("string"), "literal", dt


def term(fact: Fact) -> Column:
    p, o, k, dt = fact
    return F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(k).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"))


def quads(df: DataFrame, g: Column, s: Column, facts: list[Fact], more: Sequence[Column] = (), keep: Sequence[str] = ()) -> DataFrame:
    """A quad for each fact with a value, for each row; more: arrays of further terms, keep: columns that stay."""
    each = F.array(*map(term, facts))
    rows = df.select(g.alias("g"), s.alias("s"), F.explode(F.concat(each, *more) if more else each).alias("x"), *keep).where("x.o is not null and s is not null")
    return rows.select("g", "s", "x.p", "x.o", "x.o_kind", "x.o_dt", F.lit(None).cast("string").alias("o_lang"), *keep)


def not_empty(c: Column) -> Column:
    return F.when(c != "", c)


class Construct:
    """Builders for a deployment's namespace."""

    def __init__(self, cfg: GraphConfig | None = None):
        self.cfg = cfg or GraphConfig()
        self.iris = Iris(self.cfg)
        self.spine = F.lit(self.cfg.spine)

    def o(self, name: str) -> str:
        return self.cfg.onto + name

    def type(self, name: str | Column) -> Fact:
        return iri(G.RDF_TYPE, F.lit(self.o(name)) if isinstance(name, str) else F.concat(F.lit(self.cfg.onto), name))

    # --- repository ---
    def repos(self, df: DataFrame) -> DataFrame:
        """df (slug, history_branch, is_default_branch, snapshot_ref, docs_url)."""
        slug = F.col("slug")
        return quads(df, self.spine, self.iris.repo(slug), [self.type("Repo"), lit(self.o("sourceSystem"), F.lit("github")), lit(self.o("sourceId"), slug), lit(G.TITLE, slug), lit(self.o("docsUrl"), F.col("docs_url")), lit(self.o("historyBranch"), F.col("history_branch")), lit(self.o("isDefaultBranch"), F.col("is_default_branch"), BOOLEAN), lit(self.o("snapshotRef"), not_empty(F.col("snapshot_ref")))])

    def files(self, df: DataFrame) -> DataFrame:
        """df (slug, path, is_doc, title, detail)."""
        slug, path, doc = F.col("slug"), F.col("path"), F.col("is_doc")
        node = F.when(doc, self.iris.doc(slug, path)).otherwise(self.iris.file(slug, path))
        return quads(df, self.spine, node, [self.type(F.when(doc, "Doc").otherwise("File")), lit(self.o("path"), path), iri(self.o("partOf"), self.iris.repo(slug)), lit(G.TITLE, F.when(doc, X.first_of(F.col("title"), self.cfg.title_chars))), lit(self.o("detail"), F.when(doc, not_empty(F.col("detail"))))])

    def _person(self, df: DataFrame, g: Column, login: Column, label: Column | None = None, bots: bool = True) -> DataFrame:
        kind = F.when(X.is_bot_login(login), "BotAgent").otherwise("Person") if bots else F.lit("Person")
        more = [lit(G.RDFS_LABEL, label)] if label is not None else []
        return quads(df.where(login != ""), g, self.iris.person(login), [self.type(kind), lit(self.o("login"), login), *more])

    def commits(self, df: DataFrame) -> DataFrame:
        """df (slug, sha, author, email, date, subject)."""
        slug, login = F.col("slug"), F.when(F.col("author") != "", F.col("author")).otherwise(F.col("email"))
        node = self.iris.commit(slug, F.col("sha"))
        own = quads(df, self.spine, node, [self.type("Commit"), lit(self.o("sourceId"), F.col("sha")), lit(G.TITLE, X.first_of(F.col("subject"), self.cfg.title_chars)), lit(G.CREATED, F.col("date"), DATETIME), iri(self.o("partOf"), self.iris.repo(slug)), iri(G.ATTRIBUTED, self.iris.person(login))])
        return own.unionByName(self._person(df, self.spine, login, login)).unionByName(self.links(df.select(node.alias("node"), F.col("subject").alias("text")))).dropDuplicates()

    def pulls(self, df: DataFrame, commits: DataFrame) -> DataFrame:
        """df (slug and model.PULL); a merge commit is linked only if it is among commits (slug, sha)."""
        slug, login, merged = F.col("slug"), F.coalesce(not_empty(F.col("user.login")), F.lit("unknown")), F.col("merged_at")
        node = self.iris.pull(slug, F.col("number"))
        own = quads(df, self.spine, node, [self.type("PullRequest"), lit(self.o("number"), F.col("number"), INTEGER), lit(G.TITLE, F.coalesce("title", F.lit(""))), lit(self.o("state"), F.when(merged != "", "merged").otherwise(F.coalesce("state", F.lit("")))), lit(self.o("mergedAt"), not_empty(merged), DATETIME), lit(self.o("baseRefName"), not_empty(F.col("base.ref"))), iri(self.o("partOf"), self.iris.repo(slug)), iri(G.ATTRIBUTED, self.iris.person(login))])
        known = df.where("merged_at != ''").join(commits.select("slug", F.col("sha").alias("merge_commit_sha")).distinct(), ["slug", "merge_commit_sha"], "left_semi")
        merges = quads(known, self.spine, node, [iri(self.o("mergeCommit"), self.iris.commit(slug, F.col("merge_commit_sha")))])
        text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
        return own.unionByName(merges).unionByName(self._person(df, self.spine, login)).unionByName(self.links(df.select(node.alias("node"), text.alias("text")))).dropDuplicates()

    def links(self, df: DataFrame) -> DataFrame:
        """df (node, text): tracker keys in the text, linked both ways, with a stub of the issue."""
        rows = df.select("node", F.explode(X.tracker_keys(F.col("text"), self.cfg.teams)).alias("key"))
        issue = self.iris.issue(F.col("key"))
        out = quads(rows, self.spine, issue, [self.type("Issue"), lit(self.o("trackerKey"), F.col("key")), iri(self.o("addressedBy"), F.col("node"))])
        return out.unionByName(quads(rows, self.spine, F.col("node"), [iri(self.o("references"), issue)])).dropDuplicates()

    # --- runs, topics, stamp ---
    def run(self, spark: SparkSession, run_id: str, model: str = "deterministic-tracker", notes: str = "deterministic ingest", graph: str | None = None) -> DataFrame:
        df = spark.createDataFrame([(run_id,)], "id string")
        g = F.lit(graph) if graph else self.iris.run_graph(F.col("id"))
        return quads(df, g, self.iris.run(F.col("id")), [self.type("ExtractionRun"), lit(self.o("pipelineVer"), F.lit(self.cfg.pipeline_ver)), lit(self.o("model"), F.lit(model)), lit(self.o("promptHash"), F.lit("n/a-deterministic")), lit(self.o("notes"), F.lit(notes))])

    def topics(self, df: DataFrame, g: Column) -> DataFrame:
        """df (tag)."""
        return quads(df.select("tag").distinct(), g, self.iris.topic(F.col("tag")), [self.type("Topic"), lit(G.PREF_LABEL, F.col("tag"))])

    def stamp(self, spark: SparkSession, when: str) -> DataFrame:
        return spark.createDataFrame([(self.cfg.spine, self.cfg.spine, G.MODIFIED, when, "literal", DATETIME, None)], QUAD)

    # --- tracker ---
    def issues(self, df: DataFrame) -> DataFrame:
        """df: model.ISSUE.

        Most facts belong to one issue: where its rows are one, they are distinct as they are made. Only rows move, by
        identifier; what issues share, and nodes' types, which other issues state too, are made distinct in narrow form.
        """
        key, node = F.col("identifier"), self.iris.issue(F.col("identifier"))
        rows = df.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("identifier")))
        team = F.coalesce(not_empty(F.col("team")), F.when(F.instr(key, "-") > 0, F.substring_index(key, "-", 1)), F.lit("UNKNOWN"))
        state = not_empty(F.col("state.name"))
        own = [lit(self.o("trackerKey"), key), lit(self.o("trackerTeam"), team), lit(self.o("sourceSystem"), F.coalesce(not_empty(F.col("sourceSystem")), F.lit("linear"))), lit(G.TITLE, X.first_of(F.coalesce(not_empty(F.col("title")), key), self.cfg.issue_title_chars)), lit(G.RDFS_LABEL, key), lit(self.o("description"), not_empty(X.first_of(F.col("description"), self.cfg.description_chars))), lit(self.o("branchName"), not_empty(F.col("branchName"))), lit(self.o("state"), state), lit(self.o("status"), X.status(state)), iri(self.o("inProject"), F.when(F.col("project.name") != "", self.iris.project(F.col("project.name")))), iri(self.o("partOf"), F.when(F.col("parent.identifier") != "", self.iris.issue(F.col("parent.identifier"))))]
        labels = F.array_distinct(F.filter(F.coalesce("labels.nodes.name", F.array().cast("array<string>")), lambda x: x != ""))
        tags = F.array_distinct(F.filter(F.transform(labels, F.lower), lambda x: ~x.isin(*K.LIFECYCLE_LABELS)))
        of_issues = quads(rows, self.spine, node, own, [F.transform(labels, lambda x: term(lit(self.o("label"), x))), F.transform(tags, lambda x: term(iri(self.o("tagged"), self.iris.topic(x))))], keep=["_n"])
        out = of_issues.where("_n = 1").drop("_n").unionByName(of_issues.where("_n > 1").drop("_n").distinct())
        named = df.select(F.explode(tags).alias("tag"))
        projects = quads(df.select("project.name").where("name != ''").distinct(), self.spine, self.iris.project(F.col("name")), [self.type("Project"), lit(G.TITLE, F.col("name"))])
        related = df.select("identifier", F.explode("relations.nodes").alias("r")).select("identifier", "r.type", F.col("r.relatedIssue.identifier").alias("other"))
        issues = df.select("identifier").unionByName(df.select(F.col("parent.identifier").alias("identifier")).where("identifier != ''")).unionByName(related.select(F.col("other").alias("identifier")).where("identifier != ''")).distinct()
        for more in (quads(issues, self.spine, node, [self.type("Issue")]), self.topics(named, self.spine), projects, self._edges(related).distinct()):
            out = out.unionByName(more)
        return out

    def relations(self, df: DataFrame) -> DataFrame:
        """df (identifier, type, other): blocks is turned round to dependsOn, duplicate is duplicateOf, all else relatedTo."""
        return self._edges(df).unionByName(quads(df.where("other != ''"), self.spine, self.iris.issue(F.col("other")), [self.type("Issue")])).dropDuplicates()

    def _edges(self, df: DataFrame) -> DataFrame:
        rows = df.where("other != ''")
        kind = F.lower(F.coalesce("type", F.lit("")))
        this, other = self.iris.issue(F.col("identifier")), self.iris.issue(F.col("other"))
        p = F.when(kind == "blocks", self.o("dependsOn")).when(kind == "duplicate", self.o("duplicateOf")).otherwise(self.o("relatedTo"))
        turned = kind == "blocks"
        return rows.select(self.spine.alias("g"), F.when(turned, other).otherwise(this).alias("s"), p.alias("p"), F.when(turned, this).otherwise(other).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))

    def comments(self, df: DataFrame, run_id: str) -> DataFrame:
        """df (identifier, title, tags array<string>, ordinal, body, author): those with a kind, with provenance and the issue's tags."""
        g = self.iris.run_graph(F.lit(run_id))
        rows = df.withColumn("body", X.stripped(F.coalesce("body", F.lit("")))).withColumn("author", F.coalesce("author", F.lit("")))
        rows = rows.withColumn("kind", X.classify(F.col("body"), (K.PLANNING_HEADING, *self.cfg.comment_headings), X.is_bot_name(F.col("author"), self.cfg.bot_users))).where("kind is not null")
        kind, node = F.col("kind"), self.iris.comment(F.col("identifier"), F.col("ordinal"))
        name = F.when(kind == "learning", "Learning").when(kind == "decision", "Decision").when(kind == "planning_note", "PlanningNote").when(kind == "verification", "Verification").otherwise("ImplementationNote")
        title = X.comment_title(F.col("identifier"), F.coalesce("title", F.lit("")), F.col("body"), kind)
        own = quads(rows, g, node, [self.type(name), lit(G.TITLE, X.first_of(title, self.cfg.title_chars), STRING), lit(self.o("detail"), X.first_of(F.col("body"), self.cfg.detail_chars)), lit(self.o("fix"), F.when(kind != "decision", X.first_of(F.col("body"), self.cfg.fix_chars))), iri(G.DERIVED, self.iris.issue(F.col("identifier"))), iri(G.GENERATED, self.iris.run(F.lit(run_id))), iri(G.ATTRIBUTED, F.when(F.col("author") != "", self.iris.person(F.col("author"))))])
        tags = rows.select("identifier", "ordinal", F.explode("tags").alias("tag"))
        out = own.unionByName(self._person(rows, g, F.col("author"), bots=False)).unionByName(quads(tags, g, node, [iri(self.o("tagged"), self.iris.topic(F.col("tag")))])).unionByName(self.topics(tags, g))
        return out.dropDuplicates()

    # --- pull request conversation and reviews ---
    def pull_comments(self, df: DataFrame, run_id: str, most: int = 50) -> DataFrame:
        """df (slug, number, title, ordinal, id, body, login, created_at): the first `most` of each pull, classified."""
        rows = df.where(F.col("ordinal") < most).withColumn("kind", X.classify_pull_comment(F.col("body"), F.col("login"))).where("kind is not null")
        kind, pull = F.col("kind"), self.iris.pull(F.col("slug"), F.col("number"))
        node = self.iris.pull_comment(F.col("slug"), F.col("number"), "comment", F.col("id"))
        title = X.comment_title(F.concat(F.lit("PR #"), F.col("number").cast("string")), F.coalesce("title", F.lit("")), F.col("body"), kind)
        return quads(rows, self.spine, node, [self.type(F.initcap(kind)), lit(G.TITLE, X.first_of(title, self.cfg.issue_title_chars), STRING), lit(self.o("detail"), X.first_of(F.col("body"), self.cfg.detail_chars)), lit(self.o("fix"), F.when(kind != "decision", X.first_of(F.col("body"), self.cfg.fix_chars))), lit(G.CREATED, F.col("created_at"), DATETIME), iri(self.o("about"), pull), iri(G.DERIVED, pull), iri(G.GENERATED, self.iris.run(F.lit(run_id))), iri(G.ATTRIBUTED, self.iris.person(F.col("login")))]).dropDuplicates()

    def reviews(self, df: DataFrame, run_id: str, body: bool, states: DataFrame | None = None, most: int = 100) -> DataFrame:
        """df (slug, number, ordinal and model.REVIEW); states (id, thread_state) of inline comments. Those that are kept, as Verification."""
        rows = df.where(F.col("ordinal") < most).withColumn("login", F.coalesce("user.login", F.lit("unknown")))
        rows = rows.join(states, "id", "left") if states is not None else rows.withColumn("thread_state", F.lit(None).cast("string"))
        cols = X.keep_review(F.coalesce("body", F.lit("")), F.col("login"), F.lit(body), F.coalesce("state", F.lit("")))
        rows = rows.withColumns(cols | {"body": X.strip_badges(F.coalesce("body", F.lit("")))}).where("keep")
        pull = self.iris.pull(F.col("slug"), F.col("number"))
        node = self.iris.pull_comment(F.col("slug"), F.col("number"), "review-body" if body else "review-comment", F.col("id"))
        line = X.first_line(F.col("body"))
        title = F.concat(F.lit("PR #"), F.col("number").cast("string"), F.lit(" review: "), F.when(line != "", line).otherwise(F.col("login")))
        return quads(rows, self.spine, node, [self.type("Verification"), lit(G.TITLE, X.first_of(title, self.cfg.issue_title_chars), STRING), lit(self.o("detail"), X.first_of(F.col("body"), self.cfg.detail_chars)), lit(self.o("fix"), X.first_of(F.col("body"), self.cfg.fix_chars)), lit(self.o("reviewerLogin"), F.col("login")), lit(self.o("reviewerKind"), F.col("reviewer_kind")), lit(self.o("severity"), F.col("severity")), lit(self.o("reviewFilePath"), F.col("path")), lit(self.o("reviewLine"), F.coalesce("line", "original_line"), INTEGER), lit(self.o("commitId"), F.col("commit_id")), lit(self.o("originalCommitId"), F.col("original_commit_id")), lit(self.o("threadState"), F.lit(None) if body else F.coalesce("thread_state", F.lit("unknown"))), lit(self.o("reviewState"), F.col("state") if body else F.lit(None)), lit(G.CREATED, F.coalesce("created_at", "submitted_at"), DATETIME), iri(self.o("about"), pull), iri(G.DERIVED, pull), iri(G.GENERATED, self.iris.run(F.lit(run_id)))]).dropDuplicates()

    # --- documents with front matter ---
    def solutions(self, df: DataFrame, run_id: str) -> DataFrame:
        """df (slug, path, stem, meta map<string,array<string>>), the metadata already folded (sources.docs.folded)."""
        g, m = self.iris.run_graph(F.lit(run_id)), lambda k: F.get(F.col("meta")[k], 0)
        rows = df.withColumn("lid", F.coalesce(not_empty(m("learning_id")), F.col("stem")))
        node, doc = self.iris.learning(F.col("slug"), F.lit("solutions"), F.col("lid")), self.iris.doc(F.col("slug"), F.col("path"))
        cut = lambda k, n=self.cfg.detail_chars: not_empty(X.first_of(m(k), n))
        own = quads(rows, g, node, [self.type("Learning"), lit(G.TITLE, X.first_of(F.coalesce(not_empty(m("title")), F.col("stem")), self.cfg.title_chars), STRING), *[lit(self.o(p), cut(k)) for p, k in (("status", "status"), ("category", "category"), ("priority", "priority"), ("severityLevel", "severity_level"), ("symptom", "symptom"), ("rootCause", "root_cause"), ("impact", "impact"), ("fix", "fix"), ("problemType", "problem_type"), ("resolutionType", "resolution_type"))], lit(self.o("learningId"), F.col("lid"), STRING), lit(self.o("foundDate"), m("found_date"), DATE), lit(self.o("affectsComponent"), cut("component", 500)), iri(G.DERIVED, doc), iri(G.GENERATED, self.iris.run(F.lit(run_id)))])
        many = lambda k, p, o: quads(rows.select("slug", "lid", F.explode(F.col("meta")[k]).alias("x")), g, node, [iri(self.o(p), o)])
        out = own
        for k, p, o in (("tags", "tagged", self.iris.topic(F.col("x"))), ("issues", "filedAs", self.iris.repo_issue(F.col("slug"), F.col("x"))), ("tracker", "filedAs", self.iris.issue(F.col("x"))), ("prs", "relatedPr", self.iris.pull(F.col("slug"), F.col("x")))):
            out = out.unionByName(many(k, p, o))
        tags = rows.select(F.explode(F.col("meta")["tags"]).alias("tag"))
        return out.unionByName(self.topics(tags, g)).unionByName(self.related(rows, g, node)).dropDuplicates()

    def related(self, rows: DataFrame, g: Column, node: Column) -> DataFrame:
        """Related solutions: the exact relative path, else the first document of that base name."""
        want = rows.select("slug", "lid", F.explode(F.col("meta")["related_solutions"]).alias("x")).withColumn("base", F.substring_index("x", "/", -1))
        have = rows.select("slug", "path", F.substring_index("path", "/", -1).alias("base")).distinct()  # a path of many documents is joined once
        exact = want.join(have.select("slug", F.col("path").alias("x"), F.col("path").alias("_exact")), ["slug", "x"], "left")
        found = exact.join(have.groupBy("slug", "base").agg(F.min("path").alias("_base")), ["slug", "base"], "left")
        return quads(found, g, node, [iri(self.o("relatedSolution"), self.iris.doc(F.col("slug"), F.coalesce("_exact", "_base")))])

    def adrs(self, df: DataFrame, run_id: str) -> DataFrame:
        """df (slug, path, stem, text): title and number from the first heading, fields in bold."""
        g, t = self.iris.run_graph(F.lit(run_id)), F.col("text")
        head = r"(?m)^#\s+ADR\s+0*(\d+)\s*[:\-]\s*(.+)$"
        field = lambda name: X.first_match(t, rf"(?mi)^\*\*{name}:\*\*\s*(.+)$")
        number = F.coalesce(X.first_match(t, head, 1), F.col("stem"))
        node = self.iris.decision(F.col("slug"), "adr", number)
        title = X.first_of(F.coalesce(X.stripped(X.first_match(t, head, 2)), F.col("stem")), self.cfg.title_chars)
        own = quads(df, g, node, [self.type("Decision"), lit(G.TITLE, F.concat(F.lit("ADR "), number, F.lit(": "), title), STRING), lit(self.o("status"), X.status(F.get(F.split(X.stripped(field("Status")), r"\s+"), 0))), iri(G.DERIVED, self.iris.doc(F.col("slug"), F.col("path"))), iri(G.GENERATED, self.iris.run(F.lit(run_id)))])
        return own.unionByName(self._filed(df.select(node.alias("node"), F.explode(X.tracker_keys(field("References"), self.cfg.teams)).alias("key")), g)).dropDuplicates()

    def plans(self, df: DataFrame, run_id: str) -> DataFrame:
        """df (slug, path, stem, text, raw), raw as sources.docs.front_matter has it, null where it is malformed: keys anywhere in the body are filed."""
        g = self.iris.run_graph(F.lit(run_id))
        meta = lambda k: F.get(F.get(F.filter("raw", lambda x: x["key"] == k), 0)["vals"], 0)
        status = meta("status")
        df = df.withColumn("title", meta("title")).withColumn("status", not_empty(F.coalesce(X.status(status), status))).withColumn("type", not_empty(meta("type"))).withColumn("date", X.first_date(meta("date")))
        df = df.withColumn("text", F.when(F.col("raw").isNotNull(), F.regexp_replace("text", r"(?s)^---[^\n]*\n.*?\n---[^\n]*", "")).otherwise(F.col("text")))
        node = self.iris.decision(F.col("slug"), "plan", F.col("stem"))
        own = quads(df, g, node, [self.type("Decision"), lit(G.TITLE, X.first_of(F.coalesce(not_empty(F.col("title")), F.col("stem")), self.cfg.title_chars), STRING), lit(self.o("status"), F.col("status")), lit(self.o("category"), F.col("type")), lit(self.o("foundDate"), F.col("date"), DATE), iri(G.DERIVED, self.iris.doc(F.col("slug"), F.col("path"))), iri(G.GENERATED, self.iris.run(F.lit(run_id)))])
        return own.unionByName(self._filed(df.select(node.alias("node"), F.explode(X.tracker_keys(F.col("text"), self.cfg.teams)).alias("key")), g)).dropDuplicates()

    def _filed(self, rows: DataFrame, g: Column) -> DataFrame:
        issue = self.iris.issue(F.col("key"))
        return quads(rows, g, issue, [self.type("Issue"), lit(self.o("trackerKey"), F.col("key"))]).unionByName(quads(rows, g, F.col("node"), [iri(self.o("filedAs"), issue)]))

    # --- sites and resources ---
    def pages(self, df: DataFrame, root: str, title: str, fetched: str, branch: str | None = None, docs_of: str | None = None, server: str | None = None) -> DataFrame:
        """df: model.PAGE. A site of pages, or with `server` a source of resources; sections are nodes if they have a heading."""
        spark, mcp = df.sparkSession, server is not None
        one = spark.createDataFrame([(root, server)], "root string, server string")
        site = self.iris.mcp_source(F.lit(server)) if mcp else self.iris.doc_site(F.lit(root))
        page = self.iris.mcp_page(F.lit(server), F.col("url")) if mcp else self.iris.doc_page(F.col("url"))
        modified = lit(G.MODIFIED, F.lit(fetched), DATETIME)
        head = [self.type("McpSource"), lit(self.o("mcpServer"), F.lit(server), STRING)] if mcp else [self.type("DocSite"), lit(self.o("rootUrl"), F.lit(root), STRING), lit(self.o("documentsBranch"), F.lit(branch), STRING)]
        out = quads(one, self.spine, site, [*head, lit(G.TITLE, F.lit(title), STRING), modified])
        if docs_of:
            out = out.unionByName(quads(one, self.spine, self.iris.repo(F.lit(docs_of)), [lit(self.o("docsUrl"), F.lit(root))]))
        preamble = F.array_join(F.transform(F.filter("sections", lambda s: (s["level"] == 0) & (s["text"] != "")), lambda s: s["text"]), " ")
        out = out.unionByName(quads(df, self.spine, page, [self.type("DocPage"), lit(self.o("url"), F.col("url"), STRING), lit(G.TITLE, F.col("title"), STRING), lit(self.o("contentHash"), F.col("content_hash"), STRING), lit(self.o("detail"), not_empty(X.first_of(preamble, self.cfg.detail_chars))), iri(self.o("partOf"), site), modified]))
        s = anchored(df)
        node = (self.iris.mcp_section(F.lit(server), F.col("url"), F.col("anchor")) if mcp else self.iris.doc_section(F.col("url"), F.col("anchor")))
        return out.unionByName(quads(s, self.spine, node, [self.type("DocSection"), lit(self.o("heading"), F.col("heading"), STRING), lit(self.o("level"), F.col("level"), INTEGER), lit(self.o("anchor"), F.col("anchor"), STRING), lit(self.o("text"), F.col("text"), STRING), iri(self.o("partOf"), page)]))


def anchored(pages: DataFrame) -> DataFrame:
    """(url, pos, heading, level, text, anchor): headed sections; later equal anchors of a page get -2, -3, ...

    Each version of a page that is given more than once is numbered by itself, and equal versions alike.
    """
    rows = pages.select("url", F.xxhash64("sections").alias("_page"), F.posexplode("sections").alias("pos", "x")).select("url", "_page", "pos", "x.heading", "x.level", "x.text")
    return _numbered(rows, F.dense_rank(), "url", "_page").drop("_page")


def anchored_rows(rows: DataFrame) -> DataFrame:
    """The same of sections that are rows already (url, pos, heading, level, text)."""
    return _numbered(rows, F.row_number(), "url")


def _numbered(rows: DataFrame, number: Column, *page: str) -> DataFrame:
    s = rows.where("level > 0 and heading != ''")
    s = s.withColumn("_a", X.heading_anchor(F.col("heading"))).where("_a != ''")
    n = number.over(W.partitionBy(*page, "_a").orderBy("pos"))
    return s.withColumn("_n", n).withColumn("anchor", F.when(F.col("_n") == 1, F.col("_a")).otherwise(F.concat("_a", F.lit("-"), F.col("_n").cast("string")))).drop("_a", "_n")


def issue_comments(issues: DataFrame) -> DataFrame:
    """(identifier, title, tags, ordinal, body, author) from model.ISSUE, whose comments are JSON: a list, or {"nodes": list}."""
    plain, nodes = F.from_json("comments", f"array<{COMMENT}>"), F.from_json("comments", f"struct<nodes: array<{COMMENT}>>")["nodes"]
    names = F.coalesce(F.col("labels.nodes.name"), F.array().cast("array<string>"))
    tags = F.filter(F.transform(F.filter(names, lambda x: x != ""), F.lower), lambda x: ~x.isin(*K.LIFECYCLE_LABELS))
    each = issues.select("identifier", "title", tags.alias("tags"), F.posexplode(F.when(F.ltrim("comments").startswith("{"), nodes).otherwise(plain)).alias("ordinal", "c"))
    return each.select("identifier", "title", "tags", "ordinal", F.col("c.body").alias("body"), F.col("c.user.name").alias("author"))
