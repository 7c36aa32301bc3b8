"""The graph over a table of quads, as views that Catalyst prunes and pushes down."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..model import TERM

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
PREF_LABEL = "http://www.w3.org/2004/02/skos/core#prefLabel"
TITLE = "http://purl.org/dc/terms/title"
CREATED = "http://purl.org/dc/terms/created"
MODIFIED = "http://purl.org/dc/terms/modified"
DERIVED = "http://www.w3.org/ns/prov#wasDerivedFrom"
GENERATED = "http://www.w3.org/ns/prov#wasGeneratedBy"
ATTRIBUTED = "http://www.w3.org/ns/prov#wasAttributedTo"


class Graph:
    """quads (g, s, p, o, o_kind, o_dt, o_lang). `distinct`: whether no (s, p, o) occurs twice, in one graph or in two. tasks: see spread()."""

    def __init__(self, quads: DataFrame, cfg: GraphConfig | None = None, distinct: bool = False, tasks: int | None = None):
        self.quads, self.cfg, self.distinct, self.tasks = quads, cfg or GraphConfig(), distinct, tasks

    def spread(self, df: DataFrame, *cols: str, times: int = 1) -> DataFrame:
        """df by cols over as many tasks as its rows need, where that is known; times: for rows of many predicates. Adaptive execution goes by compressed bytes, and sorted identifiers have few: it would leave millions of rows to a task."""
        return df.repartition(times * self.tasks, *cols) if self.tasks else df

    @cached_property
    def union(self) -> DataFrame:
        """All graphs as one set of triples."""
        t = self.quads.select(*TERM)
        return t if self.distinct else t.distinct()

    def onto(self, name: str) -> str:
        return self.cfg.onto + name

    def where(self, p: str, o: str | None = None) -> DataFrame:
        """(s, o, o_kind) of a predicate, one object's or all. The filters reach the scan before the set is made."""
        t = self.quads.where(F.col("p") == p)
        t = t if o is None else t.where(F.col("o") == o)
        return t.select("s", "o", "o_kind") if self.distinct else t.select(*TERM).distinct().select("s", "o", "o_kind")

    def values(self, p: str, name: str) -> DataFrame:
        """(s, name): all values of a predicate."""
        return self.where(p).select("s", F.col("o").alias(name))

    def instances(self, *names: str) -> DataFrame:
        """(s, type): nodes of the named classes of the vocabulary."""
        t = self.quads.where((F.col("p") == RDF_TYPE) & F.col("o").isin(*[self.onto(n) for n in names]))
        t = t.select("s", F.col("o").alias("type"))
        return t if self.distinct else t.distinct()

    @cached_property
    def node_types(self) -> DataFrame:
        return self.where(RDF_TYPE).select(F.col("s").alias("iri"), F.col("o").alias("type"))

    @cached_property
    def edges(self) -> DataFrame:
        """(src, pred, dst): statements whose object is a node."""
        t = self.quads.where("o_kind = 'iri'").select(F.col("s").alias("src"), F.col("p").alias("pred"), F.col("o").alias("dst"))
        return t if self.distinct else t.distinct()

    def triples(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        t = self.quads
        for name, v in (("s", s), ("p", p), ("o", o)):
            if v is not None:
                t = t.where(F.col(name) == v)
        return t.select(*TERM) if self.distinct else t.select(*TERM).distinct()

    def having(self, nodes: DataFrame, on: str = "s") -> DataFrame:
        """Those of nodes that are the subject of any statement."""
        return nodes.join(self.quads.select(F.col("s").alias(on)).distinct(), on, "left_semi")

    def replaced(self, s: str, p: str, o: str, o_kind: str = "literal", o_dt: str | None = None, g: str | None = None) -> Graph:
        """The graph with exactly one value for a node's property."""
        spark = self.quads.sparkSession
        kept = self.quads.where(~((F.col("s") == s) & (F.col("p") == p)))
        row = spark.createDataFrame([(g or self.cfg.spine, s, p, o, o_kind, o_dt, None)], self.quads.schema)
        return Graph(kept.unionByName(row), self.cfg, self.distinct, self.tasks)

    def added(self, *more: DataFrame) -> Graph:
        q = self.quads
        for m in more:
            q = q.unionByName(m)
        return Graph(q.dropDuplicates(), self.cfg)
