import hashlib
import random
import re

from fernweave.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(10, len(w))
        for at in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[at : at + n]), set()).add(i)
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[at : at + n]))) is not None:
                    hit |= set(range(at, at + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def check(spark, rows, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert rows(decontaminate(d, b), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == brute(docs, items)


def test_passages(spark, rows, many_rows):
    rng = random.Random(2)
    docs = [(r[0], r[1]) for r in many_rows]
    items = [(i, " ".join(t.split()[3 : 3 + rng.randint(8, 30)])) for i, t in docs[::9]] + [(900, docs[0][1]), (901, docs[0][1])]
    check(spark, rows, docs, items)


def test_every_span_of_ten_is_found(spark, rows):
    """Random words of a small alphabet, so that hashes repeat and spans overlap."""
    rng = random.Random(3)
    w = lambda n: " ".join(rng.choice(["a", "b", "c"]) for _ in range(n))
    docs = [(i, w(rng.randint(0, 60))) for i in range(60)]
    items = [(i, w(rng.randint(10, 24))) for i in range(20)]
    check(spark, rows, docs, items)


def test_short_items_and_edges(spark, rows, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    check(spark, rows, docs, [(1, "One"), (2, "A b C"), (3, None), (4, "..."), (None, "a b c d"), (5, docs[0][1]), (6, "word word")])


def test_empty_tables(spark, rows, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows]
    check(spark, rows, docs, [])
    check(spark, rows, [], [(1, "a b")])
