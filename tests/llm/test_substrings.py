import random
import re
import time

from fernweave.llm.substrings import dedup

SENTENCE = re.compile(r"(?s)[\x20\x09-\x0D]*.*?(?:[.!?]+[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*|\Z)")


def brute(rows, run=2, least=16, long_words=30):
    """(doc_id, text, n_sentences, n_removed) by the rule, one document after the other: all (first, last) of which no shorter run with the same first, or the same last, has enough."""
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    spans, cut = {}, {d: [x for x in SENTENCE.findall(d[1] or "") if x] for d in docs}
    for d in docs:
        q = [re.sub(r"[\x20\x09-\x0D]+", " ", s).strip(" ").split(" ") for s in cut[d]]
        for i in range(len(q)):
            for n in range(1, len(q) - i + 1):
                words = sum(q[i : i + n], [])
                enough = n >= run and len(words) >= least
                ahead = enough and (n == run or len(words) - len(q[i + n - 1]) < least)
                back = enough and (n == run or len(words) - len(q[i]) < least)
                if ahead or back or (n == 1 and len(words) >= long_words):
                    spans.setdefault(" ".join(words), []).append((d, i, n))
                if len(words) > 3 * least and n > run:
                    break
    gone = {d: set() for d in docs}
    for places in spans.values():
        for d, i, n in places[1:]:
            gone[d] |= set(range(i, i + n))
    out = []
    for r in rows:
        d = (r[0], r[1])
        left = "".join(s for i, s in enumerate(cut[d]) if i not in gone[d])
        out.append((r[0], left if gone[d] else r[1], len(cut[d]), len(gone[d])))
    return sorted(out, key=repr)


def got(df, rows):
    return rows(dedup(df), "doc_id", "text", "n_sentences", "n_removed")


def test_against_brute_force(many_docs, many_rows, rows):
    assert got(many_docs, rows) == brute(many_rows)


def test_edges(edge_docs, edge_rows, rows):
    # two texts of one doc_id have no order but their hashes', and share nothing here
    assert got(edge_docs, rows) == brute(edge_rows)


def test_shared_passage_stays_once(many_docs):
    out = dedup(many_docs).where("doc_id >= 205").collect()
    assert sum(r.n_removed == 0 for r in out) == 1
    assert all(r.n_removed >= 4 for r in out if r.n_removed)


def test_empty(no_docs):
    assert dedup(no_docs).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e. f g h i j. ", 7, 8)], "doc_id long, text string, n_removed int, start int")
    assert dedup(df).select("n_removed", "start").first() == (0, 8)


def test_passages_of_short_lines(spark, rows):
    lines = "".join(f"a{i} b{i} c{i}\n" for i in range(20))  # 60 words, 6 in two lines
    mixed = "One two three four five six seven eight nine ten. Ja. Nein. "
    made = [(i, f"Here begins the document that has number {i}.\n{lines}{mixed}And now it ends as it has begun with {i}.") for i in range(5)]
    made += [(9, "x y z\n"), (10, "x y z\n"), (11, ""), (12, "p q r\n" * 9), (13, "p q r\n" * 9), (14, "x y z\nx y z\n"), (15, " \n "), (16, "\n\n. a b! c"), (17, "Wait... what?! Yes")]
    out = got(spark.createDataFrame(made, "doc_id long, text string"), rows)
    assert out == brute(made)
    left = {r[0]: r for r in out}
    assert left[0][3] == 0 and all(left[i][3] == 23 and "a7" not in left[i][1] and "Nein" not in left[i][1] for i in range(1, 5))
    assert left[13][1] == "" and left[10][1] == "x y z\n"


def test_short_sentences_against_brute_force(spark, rows):
    rng = random.Random(3)
    ends = [".\n", ". ", "! ", "?! ", "\n", " \n\n", ".", "..", "?"]
    made = [(i, "".join(" ".join(rng.choice("aab") for _ in range(rng.randint(1, 4))) + rng.choice(ends) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for run, least, long_words in ((2, 16, 30), (2, 5, 30), (3, 1, 4), (1, 6, 6)):
        assert rows(dedup(df, run, least, long_words), "doc_id", "text", "n_sentences", "n_removed") == brute(made, run, least, long_words)


def test_boilerplate_stays(spark):
    """Two short sentences that many documents share aren't a passage."""
    made = [(i, f"It begins with number {i} and goes on. Released under the license of all. No rights are reserved. Then number {i} ends.") for i in range(50)]
    assert dedup(spark.createDataFrame(made, "doc_id long, text string")).where("n_removed > 0").count() == 0


def test_marks_are_linear(spark):
    made = [(1, "." * 1_000_000 + "x"), (2, "?!" * 500_000), (3, ". " * 300_000)]
    began = time.time()
    out = {r[0]: (r[1], r[2]) for r in dedup(spark.createDataFrame(made, "doc_id long, text string")).select("doc_id", "n_sentences", "n_removed").collect()}
    assert time.time() - began < 30
    assert out[1] == (1, 0) and out[2] == (1, 0) and out[3][0] == 300_000 and out[3][1] > 0


def test_any_type_of_id(spark):
    text = "One sentence has these nine or ten words in it. " * 3 + "And here are some more words, to make it long enough for a run. "
    out = dedup(spark.createDataFrame([("a", text), ("b", text), (None, "x")], "doc_id string, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {"a": out.where("doc_id = 'a'").first()["text"], "b": "", None: "x"}
