"""Index cards: one row a node, the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as K
from ..functions.text import card_text
from ..plans import graph as G
from ..plans.graph import Graph

#: The property of a class's snippet; sections have cards of their own.
SNIPPET = {"Learning": "fix", "Decision": "detail", "Verification": "fix", "PlanningNote": "fix", "ImplementationNote": "fix", "Issue": "description", "Doc": "detail", "DocPage": "detail"}
#: The predicate that stands for a topic's label in the rows to be folded.
TAG = "tag"


def build_cards(graph: Graph, only: DataFrame | None = None) -> DataFrame:
    """(iri, type, title, snippet, card_text) of nine classes; a node without a title has none.

    The few predicates that cards show are read once and folded by one aggregate a node: the least value that
    isn't empty, and the sorted labels. only (iri): the nodes whose cards are wanted, all by default.
    """
    own, props = graph.onto, {"fix", "detail", "description", "trackerKey", "label", "heading", "text", "partOf"}
    classes = [own(c) for c in (*SNIPPET, "DocSection")]
    facts = graph.quads.where(F.col("p").isin(G.TITLE, *map(own, props)) | ((F.col("p") == G.RDF_TYPE) & F.col("o").isin(classes))).select("s", "p", "o")
    topics = graph.where(own("tagged")).select("s", F.col("o").alias("topic"))
    if only is not None:
        few = only.select(F.col("iri").alias("s"))
        facts, topics = facts.join(few, "s", "left_semi"), topics.join(few, "s", "left_semi")
    labels = graph.values(G.PREF_LABEL, "o").withColumnRenamed("s", "topic")
    facts = facts.unionByName(topics.join(labels, "topic").select("s", F.lit(TAG).alias("p"), "o"))

    def of(p: str) -> Column:
        return F.when(F.col("p") == p, F.col("o"))

    def least(p: str, name: str) -> Column:
        return F.min(F.when((F.col("p") == p) & (F.col("o") != ""), F.col("o"))).alias(name)

    shown = F.when(~F.lower("o").isin(*K.LIFECYCLE_LABELS), of(own("label")))
    node = (graph.spread(facts, "s", times=2) if only is None else facts).groupBy("s").agg(
        F.collect_set(of(G.RDF_TYPE)).alias("types"), F.count_if(F.col("p") == G.TITLE).alias("titles"), least(G.TITLE, "title"), F.array_sort(F.collect_set(of(TAG))).alias("tags"), F.array_sort(F.collect_set(shown)).alias("labels"), *[least(own(p), p) for p in sorted(props - {"label", "partOf"})], F.collect_set(of(own("partOf"))).alias("wholes")
    )  # types are of nine classes at most
    each = node.where("titles > 0 and size(types) > 0").withColumn("type", F.explode(F.transform("types", lambda t: F.substring_index(t, "#", -1)))).where("type != 'DocSection'")
    extra = F.lit(None).cast("string")
    for prop in sorted(set(SNIPPET.values())):
        extra = F.when(F.col("type").isin(*[c for c, p in SNIPPET.items() if p == prop]), F.col(prop)).otherwise(extra)
    tags = F.when(F.col("type") == "Learning", F.col("tags")).when(F.col("type") == "Issue", F.col("labels")).otherwise(F.array().cast("array<string>"))
    head = F.when((F.col("type") == "Issue") & (F.col("trackerKey") != ""), F.concat("trackerKey", F.lit(": "), "title")).otherwise(F.col("title"))
    snippet = F.substring(F.coalesce(extra, F.lit("")), 1, graph.cfg.snippet_chars)
    out = each.select(F.col("s").alias("iri"), "type", head.alias("title"), snippet.alias("snippet"), card_text(head, [F.array_join(tags, ", ")], snippet).alias("card_text"))
    # sections: titled by their page and heading
    pages = graph.instances("DocPage").select("s").join(graph.values(G.TITLE, "page_title"), "s").groupBy(F.col("s").alias("page")).agg(F.min("page_title").alias("page_title"))
    sections = node.where(F.array_contains("types", own("DocSection")) & F.col("heading").isNotNull() & F.col("text").isNotNull()).select("s", "heading", "text", F.explode("wholes").alias("page")).join(pages, "page")
    head, snippet = F.concat("page_title", F.lit(" › "), "heading"), F.substring("text", 1, graph.cfg.section_snippet_chars)
    return out.unionByName(sections.select(F.col("s").alias("iri"), F.lit("DocSection").alias("type"), head.alias("title"), snippet.alias("snippet"), card_text(head, [], snippet).alias("card_text")))
