"""Sorted N-Triples parts of a graph, their pieces, digest and copies."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.iri import part_of
from ..plans.graph import Graph
from ..sources.ntriples import line_of
from . import aggregates as A

#: Fixed values.
PART_CAP, FILE_CAP, MOST_PIECES = 50 << 20, 95 << 20, 256


def part_lines(graph: Graph) -> DataFrame:
    """(part, s, line) of the union of all graphs."""
    return graph.union.select(part_of(graph.cfg, F.col("s")).alias("part"), "s", line_of().alias("line"))


def piece(s: Column, k: Column | int) -> Column:
    """The piece of a subject: the first byte of the SHA-256 of its term, brackets included, modulo k."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("<"), s, F.lit(">")), 256), 1, 2), 16, 10).cast("int") % k


def piece_counts(lines: DataFrame, cap: int = PART_CAP) -> DataFrame:
    """(part, k): 1 for parts within the cap, else the least power of two that brings every piece within it (256 at most).

    One pass: bytes are summed by first hash byte, and the candidates are summed up from these 256 sums.
    """
    size = F.octet_length("line") + 1
    by_byte = lines.groupBy("part", piece(F.col("s"), 256).alias("b")).agg(F.sum(size).alias("n"))
    each = by_byte.select("part", "b", "n", F.explode(F.array(*[F.lit(1 << i) for i in range(9)])).alias("k"))
    most = each.groupBy("part", "k", (F.col("b") % F.col("k")).alias("i")).agg(F.sum("n").alias("n")).groupBy("part", "k").agg(F.max("n").alias("n"))
    return most.groupBy("part").agg(F.coalesce(F.min(F.when(F.col("n") <= cap, F.col("k"))), F.lit(MOST_PIECES)).alias("k"))


def pieces(graph: Graph, cap: int = PART_CAP) -> DataFrame:
    """(part, file, line): each line with the file that it belongs in."""
    lines = part_lines(graph)
    k = piece_counts(lines, cap)
    out = lines.join(F.broadcast(k), "part")  # a row a kind of node
    name = F.when(F.col("k") == 1, F.concat("part", F.lit(".nt"))).otherwise(F.concat("part", F.lit("."), F.lpad(piece(F.col("s"), F.col("k")).cast("string"), 2, "0"), F.lit(".nt")))
    return out.select("part", name.alias("file"), "line")


def write_parts(graph: Graph, path: str, cap: int = PART_CAP, rows_a_run: int = 200_000) -> DataFrame:
    """Writes the lines sorted within each file's folder; returns (file, n).

    A file is a folder `file=<name>` of range-partitioned, sorted text parts: read in name order they are the
    sorted file, whatever its size, and no task sorts a whole file. Equal graphs give equal bytes.
    """
    rows = pieces(graph, cap)
    runs = max(1, rows.count() // rows_a_run)
    rows.repartitionByRange(runs, "file", "line").sortWithinPartitions("file", "line").select("file", F.col("line").alias("value")).write.mode("overwrite").partitionBy("file").text(path)
    spark = graph.quads.sparkSession
    return spark.read.format("text").load(path).groupBy("file").agg(F.count("*").alias("n")).orderBy("file")


def file_lines(rows: DataFrame) -> Iterator[tuple[str, str]]:
    """(file, line) in order, streamed: for a local copy in plain files."""
    for r in rows.orderBy("file", "line").toLocalIterator():
        yield r["file"], r["line"]


def export_parts(graph: Graph, folder: str, cap: int = PART_CAP, file_cap: int = FILE_CAP) -> dict[str, int]:
    """Plain sorted files in a local folder for version control, written aside and then renamed; lines by part."""
    tmp = f"{folder}.{uuid.uuid4().hex}"
    os.makedirs(tmp)
    out, name = None, None
    counts: dict[str, int] = {}
    for f, line in file_lines(pieces(graph, cap)):
        if f != name:
            if out:
                out.close()
            out, name = open(os.path.join(tmp, f), "w", encoding="utf-8"), f  # noqa: SIM115
        out.write(line + "\n")
        part = f.split(".")[0]
        counts[part] = counts.get(part, 0) + 1
    if out:
        out.close()
    for f in os.listdir(tmp):
        if os.path.getsize(os.path.join(tmp, f)) > file_cap:
            shutil.rmtree(tmp)
            raise RuntimeError(f"{f} is beyond {file_cap} bytes: raise the number of pieces")
    swap(tmp, folder)
    return dict(sorted(counts.items()))


def swap(new: str, folder: str) -> None:
    """Puts new in the place of folder; readers see one or the other."""
    old = f"{folder}.old.{uuid.uuid4().hex}"
    if os.path.isdir(folder):
        os.rename(folder, old)
    os.rename(new, folder)
    shutil.rmtree(old, ignore_errors=True)


def copy_parts(src: str, dst: str) -> int:
    """Copies a folder of parts without parsing them; returns the number of files."""
    files = sorted(f for f in os.listdir(src) if f.endswith(".nt"))
    if not files:
        raise FileNotFoundError(f"no parts in {src}")
    tmp = f"{dst}.{uuid.uuid4().hex}"
    os.makedirs(tmp)
    for f in files:
        shutil.copyfile(os.path.join(src, f), os.path.join(tmp, f))
    swap(tmp, dst)
    return len(files)


def digest(graph: Graph) -> str:
    """The summary of a graph as markdown; inventories are streamed."""
    section = lambda title, df: [f"## {title}", "", *("- " + " | ".join(str(v) for v in r) for r in df.toLocalIterator()), ""]
    out = ["# Graph digest", ""]
    for title, df in (("Triples per graph", A.graph_sizes(graph)), ("Nodes by type", A.nodes_by_type(graph)), ("Issues by team", A.issues_by_team(graph)), ("Edges", A.edge_counts(graph)), ("Learnings", A.learnings(graph)), ("Topics", A.topics(graph)), ("Issues", A.issue_inventory(graph))):
        out += section(title, df)
    return "\n".join(out)


def refresh_stats(parts: DataFrame, vectors: DataFrame | None, folders: Sequence[str], seconds: float) -> dict:
    """One line of figures about a refresh: parts (part, n), vectors, and the local folders that it wrote."""
    n = {r["part"]: r["n"] for r in parts.collect()}  # a row a part
    files = [(os.path.getsize(p), os.path.relpath(p, os.path.dirname(os.path.abspath(f)))) for f in folders for d, _, names in os.walk(f) for p in (os.path.join(d, x) for x in names)]
    size, largest = max(files, default=(0, ""))
    own = sum(os.path.getsize(os.path.join(d, x)) for f in folders if os.path.isdir(os.path.join(f, "vectors")) for d, _, names in os.walk(os.path.join(f, "vectors")) for x in names)
    return {"quads": sum(n.values()), "vectors": vectors.count() if vectors is not None else 0, "docPages": n.get("docpage.nt", 0), "durationSec": round(seconds, 1), "parts": n, "embeddingsBytes": own, "largestSnapshotFile": largest, "largestSnapshotBytes": size}


__all__ = ["copy_parts", "digest", "export_parts", "part_lines", "piece", "piece_counts", "pieces", "refresh_stats", "swap", "write_parts"]
