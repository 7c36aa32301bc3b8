import random
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernweave.llm.bpe_machine import CHUNK, Machine
from fernweave.llm.common import text_bytes
from fernweave.llm.token_counts import token_counts

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        return Machine(f.read()), tokenizers.Tokenizer.from_file(PATH)


def same(both, texts):
    m, t = both
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert m.counts(*text_bytes(pa.array(texts, pa.large_string()))[:2]).tolist() == want


def test_pieces_put_together(both):
    rng = random.Random(1)
    parts = ["'s", "'re", "'ll", "'d", " ", "  ", "\n", "\t", "<|endoftext|>", "hello", " world", "I'", "''", "'S", "9", "½", "_", "\r\n", " '", "x" * 200, " " * 300, "1" * 50, "é", "中文", "😀", "　", " "]
    same(both, ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)])


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60))
def test_any_text(both, text):
    same(both, [text])


def test_chunks_compose(both):
    """Pre-tokens much longer than a chunk, so that state maps are composed over many chunks."""
    rng = random.Random(2)
    same(both, ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (CHUNK - 1, CHUNK, 7 * CHUNK + 3)] + ["", "a"])


def unbroken(n):
    """Long texts of one pre-token, or nearly."""
    rng = random.Random(3)
    draw = lambda letters: "".join(rng.choice(letters) for _ in range(n))
    prose = draw(["the", "and", "ing", "lich", "ción", "est", "ou"])[:n]
    return [draw("0123456789"), " " * n, "ab" * (n // 2), prose, draw([chr(c) for c in range(0x4E00, 0x4F00)]), "-=" * (n // 2), "\n" * n, draw("ab")]


def test_long_pretokens(both):
    same(both, [x for t in unbroken(60_000) for x in (t, "a " + t + " b")])


def test_maps_with_too_many_entries(both, monkeypatch):
    """Where a map would need more entries than are held, chunks are read from left to right."""
    import fernweave.llm.bpe_machine as B

    for most in (1, 2):
        monkeypatch.setattr(B, "MOST_ENTRIES", most)
        same(both, unbroken(3_000))


def test_long_pretokens_cost_like_others(both):
    m, _ = both
    for t in unbroken(400_000):
        cost = []
        for x in (t, " ".join(t[i : i + 6] for i in range(0, len(t), 6))):
            own = text_bytes(pa.array([x], pa.large_string()))[:2]
            m.counts(*own)  # states are made
            began = time.process_time()
            m.counts(*own)
            cost.append(time.process_time() - began)
        assert cost[0] < 5 * cost[1] + 0.5, (t[:20], cost)


def test_states_are_bounded(both, monkeypatch):
    import fernweave.llm.bpe_machine as B

    monkeypatch.setattr(B, "MOST_STATES", 50)
    same(both, ["some words here", "and there"])
    same(both, ["some words here", "and there"])


def test_query_edges(spark, edge_docs, edge_rows, no_docs, both):
    got = sorted((tuple(r) for r in token_counts(edge_docs, PATH).collect()), key=repr)
    want = []
    for i, t, *_ in edge_rows:
        n = len(both[1].encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=repr)
    assert token_counts(no_docs, PATH).count() == 0
