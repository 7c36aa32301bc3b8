"""Summaries of a graph: sizes, counts, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iri import local_name
from ..plans import graph as G
from ..plans.graph import Graph

#: The relations that a digest lists.
DIGEST_EDGES = ("partOf", "dependsOn", "duplicateOf", "relatedTo", "inProject")


def graph_sizes(graph: Graph) -> DataFrame:
    return graph.quads.groupBy("g").agg(F.count("*").alias("n")).orderBy("g")


def nodes_by_type(graph: Graph) -> DataFrame:
    """Nodes by class, most first."""
    t = graph.node_types.groupBy("type").agg((F.count("iri") if graph.distinct else F.count_distinct("iri")).alias("n"))
    return t.select(local_name(F.col("type")).alias("type"), "n").orderBy(F.desc("n"), "type")


def issues_by_team(graph: Graph) -> DataFrame:
    teams, issues = graph.values(graph.onto("trackerTeam"), "team"), graph.instances("Issue").select("s")
    of_issues = graph.spread(teams, "s").join(graph.spread(issues, "s"), "s", "left_semi")
    return of_issues.groupBy("team").agg((F.count("s") if graph.distinct else F.count_distinct("s")).alias("n")).orderBy("team")


def edge_counts(graph: Graph, names: Sequence[str] = DIGEST_EDGES) -> DataFrame:
    """Statements of each named predicate; those without any are listed with 0."""
    spark = graph.quads.sparkSession
    wanted = spark.createDataFrame([(n, graph.onto(n)) for n in names], "predicate string, p string")
    t = graph.quads.where(F.col("p").isin([graph.onto(x) for x in names])).select("s", "p", "o")
    n = (t if graph.distinct else t.distinct()).groupBy("p").agg(F.count("*").alias("n"))
    return wanted.join(n, "p", "left").select("predicate", F.coalesce("n", F.lit(0)).alias("n")).orderBy("predicate")


def learnings(graph: Graph) -> DataFrame:
    return graph.instances("Learning").join(graph.values(G.TITLE, "title"), "s").select("title").orderBy("title")


def topics(graph: Graph) -> DataFrame:
    """(label, n): topics with their uses by learnings, none included, most first."""
    used = graph.where(graph.onto("tagged")).select("s", F.col("o").alias("topic")).join(graph.instances("Learning").select("s"), "s", "left_semi").groupBy("topic").agg(F.count_distinct("s").alias("n"))
    labels = graph.instances("Topic").select(F.col("s").alias("topic")).join(graph.values(G.PREF_LABEL, "label").withColumnRenamed("s", "topic"), "topic")
    return labels.join(used, "topic", "left").select("label", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "label")


def issue_inventory(graph: Graph) -> DataFrame:
    """(key, team, status, project, labels, parent, learned): one line an issue, `-` for what is missing, by team and number."""
    at = lambda p, name: graph.values(graph.onto(p), name)
    one = lambda df, c: graph.spread(df, "s").groupBy("s").agg(F.min(c).alias(c))
    to = lambda p: graph.where(graph.onto(p)).select("s", F.col("o").alias("x"))
    title = graph.values(G.TITLE, "t")
    titled = title.select(F.col("s").alias("x"), F.col("t").alias("project")).join(to("inProject").select("x").distinct(), "x", "left_semi").groupBy("x").agg(F.min("project").alias("project"))  # a row a project, however many issues it has
    project = one(to("inProject").join(titled, "x"), "project")
    parent = one(graph.spread(to("partOf"), "x").join(graph.spread(at("trackerKey", "parent").withColumnRenamed("s", "x"), "x"), "x"), "parent")
    labels = graph.spread(at("label", "l"), "s").groupBy("s").agg(F.array_join(F.array_sort(F.collect_set("l")), ", ").alias("labels"))
    phase = F.when(F.contains("t", F.lit("build-up")), "up").when(F.contains("t", F.lit("build-down")), "down")
    learned = graph.instances("Learning").join(title, "s").withColumn("phase", phase).where("phase is not null").join(graph.where(G.DERIVED).select("s", F.col("o").alias("x")), "s").groupBy(F.col("x").alias("s")).agg(F.array_join(F.array_sort(F.collect_set("phase")), ",").alias("learned"))
    out = graph.spread(graph.instances("Issue").select("s"), "s").join(one(at("trackerKey", "key"), "key"), "s")
    for part in (one(at("trackerTeam", "team"), "team"), one(at("status", "status"), "status"), project, labels, parent, graph.spread(learned, "s")):
        out = out.join(part, "s", "left")
    dash = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("-")).alias(c)
    number = F.coalesce(F.try_to_number(F.substring_index("key", "-", -1), F.lit("999999999999")), F.lit(0)).cast("long")
    return out.select("key", dash("team"), dash("status"), dash("project"), dash("labels"), dash("parent"), dash("learned")).orderBy("team", number, "key")


def quad_count(graph: Graph) -> DataFrame:
    return graph.quads.agg(F.count("*").alias("quads"), F.count_distinct("s", "p", "o", "o_kind", F.coalesce("o_dt", F.lit(""))).alias("triples"))


def logical_part(name: str) -> Column:
    return F.regexp_replace(name, r"^(.+)\.\d+\.nt$", "$1.nt")


def part_counts(files: DataFrame) -> DataFrame:
    """files (name, line): lines that aren't blank by part, numbered pieces counted with their part."""
    return files.where(F.trim("line") != "").groupBy(logical_part("name").alias("part")).agg(F.count("*").alias("n")).orderBy("part")


def folded(rows: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """rows (iri, title, tag, extra, key) as one row an iri: sorted distinct tags, the least of the others that isn't empty."""
    tag = F.when(~F.lower("tag").isin(*drop), F.col("tag")) if drop else F.col("tag")
    least = lambda c: F.min(F.when(F.col(c) != "", F.col(c))).alias(c)
    return rows.groupBy("iri").agg(least("title"), F.array_sort(F.collect_set(tag)).alias("tags"), least("extra"), least("key"))


def first_last(commits: DataFrame) -> DataFrame:
    """commits (date): the earliest and latest instants, as they were written."""
    t = F.to_timestamp("date")
    return commits.where(t.isNotNull()).agg(F.min(F.struct(t, "date"))["date"].alias("first_commit"), F.max(F.struct(t, "date"))["date"].alias("last_commit"))


def ingest_stats(quads: DataFrame, onto: str) -> DataFrame:
    """(graph, type, n): what a build made, from its result rather than from counters that retries would raise."""
    t = quads.where((F.col("p") == G.RDF_TYPE) & F.col("o").startswith(onto))
    return t.groupBy("g", local_name(F.col("o")).alias("type")).agg(F.count_distinct("s").alias("n"))


def at_least_as_high(rows: DataFrame, group: str = "event_type", value: str = "v") -> DataFrame:
    """rows with n, the rows of their group whose value is as high or higher.

    Rows are counted by value first, and only these counts are summed up in order; so no task orders a group's rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c"))
    over = Window.partitionBy(group).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(counts.withColumn("n", F.sum("_c").over(over)).drop("_c"), [group, value])


def topic_count(quads: DataFrame, onto: str) -> DataFrame:
    return quads.where(F.col("p") == onto + "tagged").agg(F.count_distinct("o").alias("topics"))
