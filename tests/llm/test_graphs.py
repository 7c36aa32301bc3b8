import base64
import gzip
import hashlib
import os
import random
import re
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor

import pytest

from fernweave.llm import link_graph as L
from fernweave.llm import neardup as N
from fernweave.llm import warc as W
from fernweave.llm.components import components
from fernweave.llm.oracles import ORACLES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                up[top(i)] = top(j)
    low = defaultdict(list)
    for i, r in enumerate(rows):
        low[top(i)].append(r[0])
    out = []
    for i, r in enumerate(rows):
        c = min((x for x in low[top(i)] if x is not None), default=None)
        out.append((r[0], len(sets[i]), c, r[0] == c))
    return sorted(out, key=repr)


def test_near_copies(many_docs, many_rows, rows):
    assert rows(N.near_dedup(many_docs)) == brute_components(many_rows)


def test_near_copies_edges(edge_docs, edge_rows, no_docs, rows):
    assert rows(N.near_dedup(edge_docs)) == brute_components(edge_rows)
    assert N.near_dedup(no_docs).count() == 0


def test_near_copies_in_a_folder_without_scheme(tmp_path, monkeypatch, many_docs, many_rows, rows):
    """Rounds of components and blocks read what was written before them, and only the tables behind the lazy result stay."""
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: str(tmp_path))
    assert rows(N.near_dedup(many_docs)) == brute_components(many_rows)
    assert sorted(d.rsplit("-", 1)[0] for d in os.listdir(tmp_path)) == ["classes", "comp", "sketch"]


def test_near_copies_beside_each_other(many_docs, many_rows, rows):
    """Queries in threads of one process leave each other's tables alone."""
    with ThreadPoolExecutor(3) as pool:
        assert [*pool.map(lambda _: rows(N.near_dedup(many_docs)), range(3))] == [brute_components(many_rows)] * 3


def test_near_copies_against_sql(spark, tmp_path, monkeypatch, many_docs, rows):
    """The registered query beside its SQL, in a shared folder without scheme."""
    duckdb = pytest.importorskip("duckdb")
    many_docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("fernweave.storage.shared_dir", lambda _: str(tmp_path / "shared"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLES["op10_near_dedup"])
    assert rows(N.op10_near_dedup(spark, str(tmp_path)), *want.columns) == sorted(want.fetchall(), key=repr)


def test_odd_texts_against_sql_beside_each_other(spark, tmp_path, rows):
    """The registered query twice in threads beside its SQL: case, separators and marks that only some libraries take for such."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(11)
    words, seps = ["a", "B", "Ä", "ä", "İ", "ß", "ſ", "K", "😀", "x\x00y", "\ufeff", "..."], [" ", "\t", "\x0b", "\x0c", "\xa0", "\x1c", "\x85", "\u2028", "\x00"]
    made = [(i, t) for i, t in enumerate([None, "", " \n", "\xa0", "\x00", "a", "A", "a b c d", "A B c D"])]
    for i in range(len(made), 120):
        w = rng.choice(made[9:])[1].split(" ") if i > 60 else [rng.choice(words) + (rng.choice(seps) if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 60))]
        w[rng.randrange(len(w))] = rng.choice(words)
        made.append((i * rng.choice([1, -1, 10**12]), rng.choice(["", *seps]) + " ".join(w)))
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(ORACLES["op10_near_dedup"])
    names, want = want.columns, sorted(want.fetchall(), key=repr)
    with ThreadPoolExecutor(2) as pool:
        assert [*pool.map(lambda _: rows(N.op10_near_dedup(spark, str(tmp_path)), *names), range(2))] == [want] * 2


def test_edges_against_sql(spark, tmp_path, edge_docs, no_docs, rows):
    """The registered query beside its SQL: rows without doc_id, some of them near copies, repeated ids, nulls; no rows."""
    duckdb = pytest.importorskip("duckdb")
    for name, docs in (("edges", edge_docs), ("none", no_docs)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        want = c.sql(ORACLES["op10_near_dedup"])
        assert rows(N.op10_near_dedup(spark, f"{tmp_path}/{name}"), *want.columns) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("words", range(7))
def test_few_words_in_all(spark, rows, words):
    made = [(1, " ".join("abcdef"[:words]))]
    assert rows(N.near_dedup(spark.createDataFrame(made, "doc_id long, text string"))) == brute_components(made)


def test_large_groups(spark, rows, monkeypatch):
    """Leaves and blocks so small that every step has to be taken; chains of edits, so that no pivot is near all."""
    for name, v in (("LEAF", 3), ("BLOCK", 8), ("DEPTH", 2), ("TREES", 6)):
        monkeypatch.setattr(N, name, v)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    made = [(0, " ".join(words))]
    for i in range(1, 60):
        w = made[rng.randrange(len(made))][1].split()
        w[rng.randrange(len(w))] = f"n{i}"
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(N.near_dedup(df)) == brute_components(made)


def test_stage_keeps_one_of_each(spark, edge_docs):
    left = N.stage_near_dedup(spark, edge_docs, "").collect()
    ids = [r.doc_id for r in left if r.doc_id is not None]
    assert 1 in ids and 2 not in ids and 3 not in ids and ids.count(8) == 1 and 9 not in ids


def test_stage_decides_by_id_and_text(spark, rows):
    """Ids with several texts and rows without id, where some are near copies and some aren't."""
    x, y, z = (" ".join(f"{a}{i}" for i in range(60)) for a in "xyz")
    made = [(1, x), (5, x + " end"), (5, "all of this is quite another text"), (7, x + " tail"), (7, y), (8, y + " end"), (None, y + " tail"), (None, z), (None, z), (3, None), (3, x + " x")]
    left = rows(N.stage_near_dedup(spark, spark.createDataFrame(made, "doc_id long, text string"), ""))
    assert left == sorted([made[0], made[2], made[4], made[7], made[9]], key=repr)


def test_components(spark, rows):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 470)] + [(500, i) for i in range(501, 560)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if top(a) != top(b):
            up[max(top(a), top(b))] = min(top(a), top(b))
    want = sorted(((x, top(x)) for x in {v for e in edges if e[0] != e[1] for v in e}), key=repr)
    assert rows(components(spark.createDataFrame(edges, "u long, v long"))) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


PAGES = "page_id long, url string, html string"


def brute_warc(pages, least=0):
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if len(p) >= least:
            first[p] = i if p not in first else min(first[p], i)
    out = []
    for i, _, h in pages:
        p = (h or "").encode()
        again = p in first and first[p] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, rows, tmp_path, least):
    rng = random.Random(7)
    pages = [(i, f"http://h{i % 3}.example/é\r\nX: y", rng.choice(["", None, "<p>ü😀</p>" * 9, "x" * 200_000, f"<p>{i}</p>", "WARC/1.1\r\n\r\n"])) for i in range(60)]
    folder = f"file://{tmp_path}"
    names = W.archive(spark.createDataFrame(pages, PAGES), folder, least, file_bytes=300_000)
    assert rows(W.read_records(names, folder)) == brute_warc(pages, least)
    for f in tmp_path.glob("norm-*.gz"):  # members read one by one are the whole file
        whole = gzip.decompress(f.read_bytes())
        assert whole.count(b"WARC/1.1\r\nWARC-Type") == len((f.parent / (f.name + ".idx")).read_text().splitlines())
    assert not list(tmp_path.glob("mono-*"))


def test_warc_streams():
    data = b"".join(W.record(i, "u", "x" * (i * 1000), None) for i in range(20))
    gz = gzip.compress(data[:5000]) + gzip.compress(data[5000:])
    cut = [gz[i : i + 777] for i in range(0, len(gz), 777)]
    assert b"".join(W.split_records(W.inflate(iter(cut)))) == data
    with pytest.raises(ValueError, match="ends inside"):
        list(W.split_records(iter([data[:-10]])))


def test_warc_empty(spark, tmp_path):
    folder = f"file://{tmp_path}"
    names = W.archive(spark.createDataFrame([], PAGES), folder)
    assert names.count() == 0 and W.read_records(names, folder).count() == 0


def brute_verdicts(pages):
    """The propagation on dictionaries."""
    host = {}
    rule = {}
    for i, u, _ in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        h = re.match(r"[^/?#]*", rest)[0]
        p = re.match(r"[^?#]*", rest[len(h) :])[0]
        h = h.translate(LOWER)
        fits = [(len(a + b), a + b, v) for v, a, b in L.RULES if (h == a or h.endswith("." + a)) and p.startswith(b)]
        host[i], rule[i] = (h, p), max(fits)[1:] if fits else (None, None)
    edges = defaultdict(float)
    for i, _, html in pages:
        for x in re.findall(L.HREF.replace("(?i)", ""), html or "", re.I):
            m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", x)
            edges[host[i][0], (m[1].translate(LOWER) if m and m[1] else host[i][0])] += 1
    n = defaultdict(int)
    for h, _ in host.values():
        n[h] += 1
    mass = {}
    for kind, verdict, e in ((0, "allow", edges), (1, "block", {(b, a): c for (a, b), c in edges.items()})):
        seed = defaultdict(float)
        for i in host:
            if rule[i][1] == verdict:
                seed[host[i][0]] += 1
        total = sum(seed.values()) or 1
        seed = {h: c / total for h, c in seed.items()}
        out = defaultdict(float)
        for (a, _), c in e.items():
            out[a] += c
        r = dict(seed)
        for _ in range(L.ROUNDS):
            flow = defaultdict(float)
            for (a, b), c in e.items():
                flow[b] += r.get(a, 0) * c / out[a] * L.DAMPING
            back = 1 - sum(flow.values())
            r = {h: seed.get(h, 0) * back + flow.get(h, 0) for h in {*seed, *flow}}
        mass[kind] = r
    res = []
    for i, (h, p) in host.items():
        bad, good = mass[1].get(h, 0), mass[0].get(h, 0)
        v = rule[i][1] or ("block" if bad > good and bad > L.RATIO * n[h] / len(pages) else "allow")
        res.append((i, h, p, rule[i][0], v))
    return sorted(res, key=repr)


def test_link_graph(spark, rows):
    rng = random.Random(8)
    hosts = [f"{a}.example.{t}" for a in ("x", "y", "z", "spam") for t in ("com", "net", "org")]
    pages = []
    for i in range(150):
        h = rng.choice(hosts)
        links = " ".join(f'<a href="{rng.choice(["/en", "https://" + rng.choice(hosts) + "/a", "//" + rng.choice(hosts), "#x"])}">' for _ in range(rng.randint(0, 5)))
        pages.append((i, f"HTTPS://{h.upper()}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randint(1, 99)}?q#f", links))
    pages += [(900, None, "<a href=/x>"), (901, "nothing", None), (902, "http://com", ""), (903, "http://a.com/en/", None), (904, "http://xcom/en/", None)]
    assert rows(L.judged(spark.createDataFrame(pages, PAGES))) == brute_verdicts(pages)
    assert {v for *_, v in brute_verdicts(pages)} == {"allow", "block"}


def test_link_graph_empty(spark):
    assert L.judged(spark.createDataFrame([], PAGES)).count() == 0
