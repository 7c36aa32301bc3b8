"""MinHash near-dedup: a chosen-path set similarity join, and the components of its links.

Documents with equal shingle sets are one class; all that follows works on classes. In each of
`TREES` independent trees a class walks down a path of minwise tokens: the node at level l is the
tree's first l MinHash values. A node of `LEAF` classes or fewer is a leaf and compared exhaustively;
larger ones branch on. Two classes of similarity s are in one node of level l with chance s^l in each
tree, so 12 trees find a pair of 0.85 in some leaf of the first level with 1 - 0.15^12.

Work within a node is done without listing all its pairs. First every class is compared with one
pivot of each of its nodes, of large ones the class that shares most of its tokens with others (the
original of a group of copies); the links found are joined to components. Then leaves compare only
classes of different components. Nodes that are still large at the last level are cut in blocks of a
bounded number of classes and of bytes; block against block the classes of different components are
compared by MinHash bytes, and those that are likely near one are compared on their full sets; of the
links found a spanning forest is kept. So no link between components is lost to a node's size, and groups
of thousands of copies cost a few comparisons a member.

Candidates whose 128 MinHash bytes agree in fewer than 84 places are dropped: below 1e-6 of pairs at
0.85. All others are confirmed on their full sets of 48-bit shingle hashes.

Defined cases: words of a null or empty text: none, an empty set, linked with nothing, its own
component; fewer than five words: the whole sequence is the one shingle; equal doc_ids with different
texts are different classes, and an id in two components has a row in each; a row without doc_id never
represents others, and stays only if its component has no id at all; an empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import find_words, lowered, mixed, shingle_hashes, word_hashes
from .common import drop_since, drop_written, marked, pieces, read, row_key, small_enough, text_bytes, trim, written
from .components import components

SHINGLE, PERCENT = 5, 85
TREES, DEPTH, LEAF, HASHES, AGREE, BLOCK, BLOCK_BYTES = 12, 4, 16, 128, 84, 1024, 16 << 20
_rng = np.random.default_rng(20261)
XOR = _rng.integers(0, 1 << 32, HASHES, np.uint32)
ODD = _rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one after the other, and each text's bounds."""
    n = len(offsets) - 1
    data = lowered(data)
    ws, we, at = find_words(data, offsets)
    h = word_hashes(data, ws, we)
    s = shingle_hashes(h, k)
    own = at[: len(s)] == at[k - 1 :][: len(s)]
    s, of = s[own], at[: len(s)][own]
    count = np.bincount(at, minlength=n)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        first = np.concatenate([[0], np.cumsum(count)])
        made = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            more = count[few] > j
            made[more] = mixed(made[more] * np.uint64(31) + h[first[few[more]] + j] + np.uint64(j + 1))
        s, of = np.concatenate([s, made]), np.concatenate([of, few])
    order = np.argsort(s)
    order = order[np.argsort(of[order], kind="stable")]
    s, of = s[order], of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    return s[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=n))]).astype(np.int64)


def packed(x: np.ndarray, width: int) -> pa.Array:
    """Rows of a byte matrix as binaries."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def class_keys(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """16 bytes a set: two sums of mixed hashes; an empty set: zeros."""
    out = np.zeros((len(bounds) - 1, 2), np.uint64)
    for j, x in enumerate((mixed(s), mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        out[:, j] = c[bounds[1:]] - c[bounds[:-1]]
    return out


def min_hashes(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES 32-bit minima a set; an empty set: the largest value."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.full((len(bounds) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    if len(full):
        top, starts = (s >> np.uint64(32)).astype(np.uint32), bounds[full]
        for j in range(HASHES):
            out[full, j] = np.minimum.reduceat((top ^ XOR[j]) * ODD[j], starts)
    return out


def sketched(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n, c, sig): set size, class key and MinHash bytes: the path values in full, then a byte of each hash. The long columns `carry` go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            data, offsets, _ = text_bytes(b.column(1))
            s, bounds = shingle_sets(data, offsets)
            m = min_hashes(s, bounds)
            sig = np.concatenate([np.ascontiguousarray(m[:, : TREES * DEPTH]).view(np.uint8), (m & 0xFF).astype(np.uint8)], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), packed(class_keys(s, bounds).view(np.uint8), 16), packed(sig, sig.shape[1]), *b.columns[2:]], names=["doc_id", "n", "c", "sig", *carry])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry).mapInArrow(run, ", ".join(["doc_id long, n long, c binary, sig binary", *(f"{x} long" for x in carry)]))


def paths(classes: DataFrame) -> DataFrame:
    """(c, p0 ... p3): the nodes of a class at each level, a row a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            m = np.ascontiguousarray(sig[:, : TREES * DEPTH * 4]).view(np.uint32).astype(np.uint64)
            for r in range(TREES):
                node, cols = np.full(len(m), r + 1, np.uint64), []
                for level in range(DEPTH):
                    node = mixed(node * np.uint64(0x9E3779B97F4A7C15) + m[:, r * DEPTH + level])
                    cols.append(pa.array(node.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["c", *(f"p{i}" for i in range(DEPTH))])
        trim()

    return classes.select("c", "sig").mapInArrow(run, "c binary, " + ", ".join(f"p{i} long" for i in range(DEPTH)))


def tree_nodes(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """(leaves, pairs, wide, tables): members of leaves (node, c), pairs with a pivot (u, v), members of last-level nodes that are large (node, c), and the tables that they are read from.

    Of each level's nodes the size, the least class and the pivot are one aggregate, written before it is joined with the
    members: so both sides of the join come from a shuffle, and the members of one large node are split over tasks.
    """
    rows, leaves, stars, tables = paths(classes), [], [], []

    def joined(rows: DataFrame, level: int, *more) -> DataFrame:
        p = f"p{level}"
        nodes = written(rows.groupBy(p).agg(F.count("*").alias("_m"), F.min("c").alias("_low"), *more).where("_m > 1").withColumnRenamed(p, "_node"), "nodes")
        out = written(rows.join(nodes.hint("merge"), F.col(p) == F.col("_node")).drop("_node"), "tree")
        drop_written(nodes)
        return out

    for level in range(DEPTH):
        pivot = F.max(F.struct("_s", "c"))["c"].alias("_pivot")
        own = joined(rows, level, *([pivot] if level else []))
        tables.append(own)
        small = own.where(F.col("_m") <= LEAF)
        leaves.append(small.select(F.col(f"p{level}").alias("node"), "c"))
        stars.append(small.select(F.col("_low").alias("u"), F.col("c").alias("v")))
        rows = own.where(F.col("_m") > LEAF)
        if not level:  # how many share a class's tokens, over the trees, says which class is a node's pivot
            score = written(rows.groupBy("c").agg(F.sum(F.log(F.col("_m").cast("double"))).alias("_s")), "score")
            own = joined(rows.drop("_m", "_low").join(score, "c"), level, pivot)
            tables += [score, own]
            rows = own
        stars.append(rows.select(F.col("_pivot").alias("u"), F.col("c").alias("v")))
        rows = rows.drop("_m", "_low", "_pivot")
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    pairs = written(union(stars).where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    return union(leaves), pairs, rows.select(F.col(f"p{DEPTH - 1}").alias("node"), "c"), [*tables, pairs]


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs that agree in AGREE of the MinHash bytes and whose sizes allow the similarity."""
    side = classes.select("c", "n", F.expr(f"substring(sig, {TREES * DEPTH * 4 + 1}, {HASHES})").alias("b"))
    rows = pairs.join(side.selectExpr("c as u", "n as nu", "b as bu"), "u").join(side.selectExpr("c as v", "n as nv", "b as bv"), "v").where(f"100 * least(nu, nv) >= {PERCENT} * greatest(nu, nv)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array((x == y).sum(1) >= AGREE))
        trim()

    return rows.select("u", "v", "bu", "bv").mapInArrow(run, "u binary, v binary")


def full_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(c, s): the 48-bit shingle hashes of needed classes (c, rep), from the text of the class's document rep."""
    ids = needed.select("rep").distinct()
    ids = F.broadcast(ids) if small_enough(ids, row_bytes=16) else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", 1 << 20):
            s, bounds = shingle_sets(*text_bytes(b.column(0))[:2])
            raw = np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()
            yield pa.RecordBatch.from_arrays([packed(class_keys(s, bounds).view(np.uint8), 16), pa.array([raw[6 * i : 6 * j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["c", "s"])

    own = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).alias("d").join(ids.alias("i"), F.col("d.rep").eqNullSafe(F.col("i.rep"))).select("text")
    sets = own.mapInArrow(run, "c binary, s binary")
    return sets.join(needed.select("c"), "c", "left_semi").dropDuplicates(["c"])


def unpacked(s: bytes) -> np.ndarray:
    """The 48-bit hashes as sorted integers."""
    raw = np.frombuffer(s, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return np.unique(out.view(np.uint64).ravel())


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are similar on their full sets. The side with fewer members (v, mostly) is moved once a pair."""
    rows = pairs.join(sets.selectExpr("c as v", "s as sv"), "v").join(sets.selectExpr("c as u", "s as su"), "u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [alike(unpacked(x.as_py()), unpacked(y.as_py())) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return rows.select("u", "v", "su", "sv").mapInArrow(run, "u binary, v binary")


def block_links(rows: DataFrame) -> DataFrame:
    """Links within groups (g, side, c, comp, s): side 0 against side 1, or with itself where there is only side 0.

    A group has 2 * BLOCK rows and 2 * BLOCK_BYTES of sets, or so, at most. Of its links a spanning forest over the
    components is returned.
    """

    def links(pdf):
        import pandas as pd

        up: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while up.get(x, x) != x:
                x = up[x]
            return x

        cs, comps, sides = [bytes(x) for x in pdf["c"]], [bytes(x) for x in pdf["comp"]], pdf["side"].to_numpy()
        sets, out = [unpacked(bytes(x)) for x in pdf["s"]], []
        size = np.array([len(x) for x in sets])
        whole = np.concatenate(sets)
        own = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(whole, kind="stable")
        whole, own = whole[order], own[order]
        one = sides.max() == 0
        biggest = max(set(comps), key=comps.count)
        for i in range(len(sets)):
            if (one and comps[i] == biggest) or (not one and sides[i] == 1):
                continue
            lo, hi = np.searchsorted(whole, sets[i]), np.searchsorted(whole, sets[i], "right")
            hits = np.concatenate([own[a:b] for a, b in zip(lo, hi, strict=True)])
            both = np.bincount(hits, minlength=len(sets))
            for j in np.flatnonzero((100 * both >= PERCENT * (size + size[i] - both)) & (one | (sides == 1))):
                a, b = top(comps[i]), top(comps[j])
                if a != b:
                    up[a] = b
                    out.append((cs[i], cs[j]))
        trim()
        return pd.DataFrame(out, columns=["u", "v"])

    return rows.groupBy("g").applyInPandas(links, "u binary, v binary")


def wide_groups(wide: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, side, c, comp): the groups for block_links. Nodes with several components are cut in blocks of BLOCK classes and BLOCK_BYTES of sets at most, each against each.

    The blocks are compared by MinHash bytes first, and only classes stay that are likely to be near one of another
    component. So full sets are moved for those only.
    """
    side = classes.select("c", "n", F.expr(f"substring(sig, {TREES * DEPTH * 4 + 1}, {HASHES})").alias("b"))
    rows = written(wide.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c")).join(side, "c"), "wide")
    size = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 6 / BLOCK_BYTES)).cast("int").alias("k")
    node = written(rows.groupBy("node").agg(size, F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").drop("lo", "hi"), "nodes")
    rows = rows.join(node.hint("merge"), "node").withColumn("i", F.pmod(F.xxhash64("c"), F.col("k")).cast("int"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    rows = rows.select(F.xxhash64("node", F.least("i", "j"), F.greatest("i", "j")).alias("g"), (F.col("i") > F.col("j")).cast("int").alias("side"), "c", "comp", "n", "b")

    def near(pdf):
        import pandas as pd

        b = np.frombuffer(b"".join(bytes(x) for x in pdf["b"]), np.uint8).reshape(len(pdf), -1)
        comps, sides, n = pd.factorize(pdf["comp"].map(bytes))[0], pdf["side"].to_numpy(), pdf["n"].to_numpy()
        one, found = sides.max() == 0, np.zeros(len(pdf), bool)
        right = np.flatnonzero(sides == (0 if one else 1))
        for i in np.flatnonzero(sides == 0):
            j = right[(comps[right] != comps[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))]
            hit = j[(b[j] == b[i]).sum(1) >= AGREE]
            if len(hit):
                found[i] = True
                found[hit] = True
        trim()
        return pdf.loc[found, ["g", "side", "c", "comp"]]

    return rows.groupBy("g").applyInPandas(near, "g long, side int, c binary, comp binary")


def classes_of(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows, classes), written: (doc_id, n, c, *carry) of each document, and (c, rep, n, sig) of each class with shingles."""
    made = written(sketched(docs, carry), "sketch")
    classes = written(made.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sig").alias("sig")), "classes")
    return made.select("doc_id", "n", "c", *carry), classes


def links_of(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(node, component) of the classes that have links."""
    leaves, stars, wide, tables = tree_nodes(classes)
    first = written(likely(stars, classes), "pairs")
    names = classes.select("c", "rep")
    inside = first.select(F.col("u").alias("c")).unionByName(first.select(F.col("v").alias("c"))).distinct()
    sets = written(full_sets(docs, names.join(inside, "c", "left_semi")), "sets")
    links = written(confirmed(first, sets), "links")
    comp = written(components(links).select(F.col("node").alias("c"), F.col("component").alias("comp")), "comp")
    # leaves: pairs of classes that no component joins so far
    own = leaves.join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    mixed_nodes = own.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo != hi and m > 2").select("node")
    own = own.join(mixed_nodes, "node", "left_semi")
    second = own.selectExpr("node", "c as u", "comp as cu").join(own.selectExpr("node", "c as v", "comp as cv"), "node").where("u < v and cu != cv").select("u", "v").distinct()
    second = written(likely(second.join(stars, ["u", "v"], "left_anti"), classes), "pairs")
    mark = marked()
    blocks = written(wide_groups(wide, comp, classes), "blocks")
    drop_since(mark, blocks)
    more = second.select(F.col("u").alias("c")).unionByName(second.select(F.col("v").alias("c"))).unionByName(blocks.select("c")).distinct().join(sets.select("c"), "c", "left_anti")
    sets2 = written(full_sets(docs, names.join(more, "c", "left_semi")), "sets")
    both = sets.unionByName(sets2)
    found = written(confirmed(second, both).unionByName(block_links(blocks.join(both, "c"))), "links")
    for x in (sets, sets2, first, second, links, blocks, *tables):
        drop_written(x)
    if found.isEmpty():
        return comp.select(F.col("c").alias("node"), F.col("comp").alias("component"))
    # the new links join components: only these are connected again
    top = lambda end: comp.select(F.col("c").alias(end), F.col("comp").alias(f"_{end}"))
    edges = found.join(top("u"), "u", "left").join(top("v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    joined = written(components(edges), "comp")
    moved = comp.join(joined, F.col("comp") == F.col("node"), "left").select(F.col("c").alias("node"), F.coalesce("component", "comp").alias("component"))
    return moved.unionByName(joined.join(comp.select(F.col("c").alias("node")), "node", "left_anti"))


def near_dedup(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, *carry), a row for each document."""
    rows, classes = classes_of(docs, carry)
    mark = marked()
    comp = written(links_of(docs, classes), "comp")
    drop_since(mark, comp)
    comp = comp.select(F.col("node").alias("c"), "component")
    named = classes.select("c", "rep").join(comp, "c", "left").withColumn("component", F.coalesce("component", "c"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("c", "component_id")
    out = rows.where("n > 0").join(named, "c").unionByName(rows.where("n = 0").withColumn("component_id", F.col("doc_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"), *carry)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns: kept is doc_id = component_id, so it is null for rows without doc_id, as in the SQL."""
    return near_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def stage_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that aren't their group's representative; rows of one id and text are one document, kept once.

    What goes is named by a key of id and text, as an id may have several texts, or be null. The keys
    are broadcast if they are counted to be few, so that texts aren't shuffled for them.
    """
    side = lambda few, n: F.broadcast(few) if small_enough(few, row_bytes=n) else few
    key = [row_key()["a"].alias("_ka"), row_key()["b"].alias("_kb")]
    made = written(near_dedup(docs.select("doc_id", "text", *key), ("_ka", "_kb")), "dedup")
    gone = written(made.where("not kept").select(F.col("_ka").alias("_ga"), F.col("_kb").alias("_gb")).distinct(), "gone")
    left = docs.join(side(gone, 24), (row_key()["a"] == F.col("_ga")) & (row_key()["b"] == F.col("_gb")), "left_anti")
    again = written(made.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id"), "again")
    none = again.isEmpty()
    many = left.where("doc_id is null") if none else left.where("doc_id is null").unionByName(left.join(side(again, 16), "doc_id", "left_semi").select(*left.columns))
    once = left.where("doc_id is not null") if none else left.where("doc_id is not null").join(side(again, 16), "doc_id", "left_anti")
    return once.select(*docs.columns).unionByName(many.dropDuplicates(["doc_id", "text"]).select(*docs.columns))
