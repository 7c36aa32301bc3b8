import hashlib
import math
import os
import re
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from fernweave.llm import quality_rules, queries
from fernweave.llm.common import drop_since, drop_written, marked, text_bytes, written
from fernweave.llm.decontaminate import decontaminate
from fernweave.llm.pii import base_spans, find, redacted
from fernweave.llm.pii_model import trained

from .test_decontaminate import brute as brute_hits
from .test_graphs import brute_components
from .test_quality import brute as statistics
from .test_quality import brute_targets

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_stages(spark):
    """Each stage holds what it promises on its own input; brute force of single operators is in their tests."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert names == ["quality rules", "near dedup", "decontamination", "personal data", "mixing sources"]
    seen = [docs]
    for _, stage in C.STAGES:
        seen.append(C.written(stage(spark, seen[-1], SMALL), "t"))
    assert all(d.columns == docs.columns for d in seen[1:-1])
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and len(ids[-1]) > 50
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    clean = [i for i in ids[0] if labels.get(i) == 1]
    assert sum(i in ids[1] for i in clean) / len(clean) > 0.95
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate(seen[3], bench).where("contaminated").count() == 0
    assert not any(base_spans(r.text) for r in seen[4].collect())
    sizes = seen[5].groupBy("source").agg({"size": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(size)"] - r["max(target)"]) < 6000 for r in sizes)


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [n for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) if n.startswith("op")]
    assert len(queries.QUERIES) == 10


def folder(spark, path, docs, labels=(), items=()):
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def clashing(docs):
    for name in ("size", "copy", "target", "_k", "kept", "n", "c", "start", "score"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def test_stages_on_edges(spark, tmp_path, edge_docs):
    sf = folder(spark, tmp_path / "sf", edge_docs, [(1, 1, 0), (12, 0, 0), (None, 1, None), (7, None, 0)], [(1, "One"), (None, None), (2, "")])
    docs = clashing(edge_docs)
    for i, (_, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{i}")
        if i < len(C.STAGES) - 1:
            assert out.columns == docs.columns
            assert out.where("size != 'x' or _k != 'x' or c != 'x'").count() == 0
    assert C.run(spark, sf).count() >= 0


def test_stages_on_empty_tables(spark, tmp_path, no_docs):
    sf = folder(spark, tmp_path / "sf", no_docs)
    assert C.run(spark, sf).count() == 0
    for name, q in queries.QUERIES.items():
        if name not in ("op5_url_filters", "op9_warc"):
            assert q(spark, sf).count() == 0, name


def test_queries_on_edges(spark, tmp_path, edge_docs, edge_rows):
    sf = folder(spark, tmp_path / "sf", clashing(edge_docs), [(1, 1, 0)], [(1, "One")])
    for name, q in queries.QUERIES.items():
        if name not in ("op5_url_filters", "op9_warc"):
            assert q(spark, sf).count() == len(edge_rows), name


def brute_mix(rows):
    """(doc_id, text, copies) by one sort a source."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + size(r[1])
    out = []
    for source, target in brute_targets(total, (3, 1, 2), 1.5, 2).items():
        own = []
        for r in rows:
            if r[3] == source:
                u = (int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:13], 16) + 1) / 2**52
                weight = max(0.05, 1 - 4 * (sum(c in "#*$%&|<>!" for c in r[1]) / max(1, len(r[1]))))
                own.append((-math.log(u) / weight, r[0], r[1]))
        epochs = math.floor(target / total[source]) if total[source] else 0
        budget, upto = target - epochs * total[source], 0
        for _, i, t in sorted(own):
            n = size(t)
            drawn = budget > 0 and upto < budget and upto + n / 2 <= budget
            upto += n
            out.append((i, t, epochs + drawn))
    return sorted(x for x in out if x[2])


def test_run_against_brute_force(spark, tmp_path, many_docs, many_rows):
    labels = [(r[0], int(r[0] % 10 > 0), 0) for r in many_rows[:150]]
    items = [(i, " ".join(many_rows[i][1].split()[2:16])) for i in range(0, 100, 17)]
    sf = folder(spark, tmp_path / "sf", many_docs, labels, items)
    model, net = quality_rules.fitted(spark, sf), trained()
    rows = []
    for r in many_rows:
        words, _, _, _, again = statistics(r[1])
        data, offsets, _ = text_bytes(pa.array([r[1]], pa.large_string()))
        if words >= 10 and 100 * again <= 20 * words and model.score(data, offsets)[0] >= 0.3:
            rows.append(r)
    kept = {i for i, _, _, k in brute_components(rows) if k}
    rows = [r for r in rows if r[0] in kept]
    clean = {r[0] for r in brute_hits([(r[0], r[1]) for r in rows], items) if not r[-1]}
    rows = [r for r in rows if r[0] in clean]
    rows = [(r[0], redacted(r[1], [s for x in find([r[1]], net)[0] for s in x]), *r[2:]) for r in rows]
    want = [(i, t, k + 1) for i, t, n in brute_mix(rows) for k in range(n)]
    have = sorted((r.doc_id, r.text, r.copy) for r in C.run(spark, sf).collect())
    assert have == sorted(want) and len(kept) > len(clean) > 20


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}", "{}//x", "{}/a b/", "file://{}/a b"])
def test_tables_are_deleted_by_any_name_of_the_folder(spark, tmp_path, monkeypatch, form):
    """A table that is kept stays and the others go, however the shared folder is written."""
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: form.format(tmp_path).rstrip("/"))
    before, mark = written(spark.range(2), "before"), marked()
    other, kept = written(spark.range(3), "other"), written(spark.range(4), "kept")
    left = lambda: sorted(d.split("-")[0] for _, dirs, _ in os.walk(tmp_path) for d in dirs if "-" in d)
    drop_since(mark, kept)
    assert left() == ["before", "kept"] and (before.count(), kept.count()) == (2, 4)
    assert mark + 1 == marked()
    drop_written(before)
    assert left() == ["kept"] and kept.count() == 4 and other.schema == kept.schema
    drop_written(kept.where("id > 1"))
    assert left() == [] and mark - 1 == marked()


def test_tables_of_other_threads_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: str(tmp_path))
    with ThreadPoolExecutor(1) as pool:
        mark = pool.submit(marked).result()
        here = written(spark.range(2), "here")
        other, kept = (pool.submit(written, spark.range(3), name).result() for name in ("other", "kept"))
        pool.submit(drop_since, mark, kept).result()
        assert sorted(d.split("-")[0] for d in os.listdir(tmp_path)) == ["here", "kept"]
        assert (here.count(), kept.count()) == (2, 3) and other.schema == kept.schema
        pool.submit(drop_written, kept).result()
        assert pool.submit(marked).result() == mark
    drop_written(here)
    assert os.listdir(tmp_path) == []


def test_run_in_a_folder_without_scheme(spark, tmp_path, monkeypatch, many_docs, many_rows):
    """Every stage reads what the one before wrote, and only the last result stays."""
    sf = folder(spark, tmp_path / "sf", many_docs, [(r[0], int(r[0] % 10 > 0), 0) for r in many_rows[:150]], [(1, many_rows[0][1])])
    want = sorted(map(tuple, C.run(spark, sf).collect()))
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: str(tmp_path / "shared"))
    assert sorted(map(tuple, C.run(spark, sf).collect())) == want and want
    assert [d.rsplit("-", 1)[0] for d in os.listdir(tmp_path / "shared")] == ["stage-mixing-sources"]


def test_run_against_brute_force_without_scheme(spark, tmp_path, monkeypatch, many_docs, many_rows):
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: str(tmp_path / "shared"))
    test_run_against_brute_force(spark, tmp_path, many_docs, many_rows)


def test_runs_beside_each_other(spark, tmp_path, many_docs, many_rows):
    """Runs in threads of one process leave each other's stages alone."""
    sf = folder(spark, tmp_path / "sf", many_docs, [(r[0], int(r[0] % 10 > 0), 0) for r in many_rows[:150]], [(1, many_rows[0][1])])
    want = sorted(map(tuple, C.run(spark, sf).collect()))
    with ThreadPoolExecutor(2) as pool:
        assert [*pool.map(lambda _: sorted(map(tuple, C.run(spark, sf).collect())), range(2))] == [want] * 2 and want
