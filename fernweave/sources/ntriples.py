"""N-Triples and N-Quads as lines: reading by one grammar, writing by one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import GraphConfig
from ..model import QUAD, TERM
from ..plans.graph import Graph

LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:<([^>]*)>\s*)?\.\s*$'


def unescaped(c: Column) -> Column:
    """String escapes resolved: a backslash pair is set aside first, so that the others are taken once."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ("\\'", "'")):
        out = F.replace(out, F.lit(a), F.lit(b))
    code = F.split(out, r"(?=\\u[0-9A-Fa-f]{4})|(?=\\U[0-9A-Fa-f]{8})")
    char = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
    small = lambda x: F.concat(char(F.substring(x, 3, 4)), F.substr(x, F.lit(7)))
    large = lambda x: F.concat(char(F.substring(x, 3, 8)), F.substr(x, F.lit(11)))
    each = F.transform(code, lambda x: F.when(x.rlike(r"^\\u[0-9A-Fa-f]{4}"), small(x)).when(x.rlike(r"^\\U[0-9A-Fa-f]{8}"), large(x)).otherwise(x))
    out = F.when(F.contains(out, F.lit("\\u")) | F.contains(out, F.lit("\\U")), F.array_join(each, "")).otherwise(out)
    return F.replace(out, F.lit("\x00"), F.lit("\\"))


def escaped(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def line_of() -> Column:
    """A term row as a line; the object's datatype and language are part of it."""
    value = F.concat(F.lit('"'), escaped(F.col("o")), F.lit('"'), F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise(""))
    return F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(value), F.lit(" ."))


def parsed(lines: DataFrame, graph: str, col: str = "value") -> DataFrame:
    """Quads of lines; blank lines and comments are passed by. `graph` is the graph of lines that name none."""
    at = lambda i: F.regexp_extract(col, LINE, i)
    some = lambda c: F.when(c != "", c)
    rows = lines.where(F.col(col).rlike(LINE))
    iri = F.coalesce(some(at(3)), some(at(4)))
    return rows.select(F.coalesce(some(at(8)), F.lit(graph)).alias("g"), F.regexp_replace(at(1), "^<|>$", "").alias("s"), at(2).alias("p"), F.coalesce(iri, unescaped(at(5))).alias("o"), F.when(iri.isNotNull(), "iri").otherwise("literal").alias("o_kind"), some(at(6)).alias("o_dt"), some(at(7)).alias("o_lang"))


def read_lines(spark: SparkSession, path: str, cfg: GraphConfig | None = None) -> Graph:
    """All .nt and .nq files of a folder."""
    cfg = cfg or GraphConfig()
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return Graph(parsed(text, cfg.spine).dropDuplicates(), cfg)


def write_quads(graph: Graph, path: str) -> None:
    """The stored form: Parquet by graph, each quad once, sorted by predicate and subject so that row groups are skipped by their statistics."""
    graph.quads.dropDuplicates().sortWithinPartitions("g", "p", "s").write.mode("overwrite").partitionBy("g").option("compression", "zstd").parquet(path)


def read_quads(spark: SparkSession, path: str, cfg: GraphConfig | None = None) -> Graph:
    return Graph(spark.read.parquet(path).select("g", *TERM), cfg)


def materialise(spark: SparkSession, parts: str, path: str, cfg: GraphConfig | None = None) -> int:
    """Parts as the stored form; returns the number of triples, and refuses an empty folder."""
    g = read_lines(spark, parts, cfg)
    n = g.quads.count()
    if not n:
        raise FileNotFoundError(f"no triples in {parts}")
    write_quads(g, path)
    return n


FORMATS = {"parquet": read_quads, "nt": read_lines, "nq": read_lines}


def open_graph(spark: SparkSession, path: str, fmt: str = "parquet", cfg: GraphConfig | None = None) -> Graph:
    """A stored graph by its format; an unknown one is the default."""
    return FORMATS.get(fmt, read_quads)(spark, path, cfg)


def empty_graph(spark: SparkSession, cfg: GraphConfig | None = None) -> Graph:
    return Graph(spark.createDataFrame([], QUAD), cfg)


def prior_graph(spark: SparkSession, path: str, cfg: GraphConfig | None = None) -> Graph:
    """The last build's graph, or an empty one where there is none."""
    try:
        return read_quads(spark, path, cfg)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return empty_graph(spark, cfg)
        raise


def stamp_of(graph: Graph) -> str | None:
    """The age stamp: the one modified date of the spine graph."""
    row = graph.quads.where((F.col("s") == graph.cfg.spine) & (F.col("p") == "http://purl.org/dc/terms/modified")).select("o").first()
    return row["o"] if row else None
