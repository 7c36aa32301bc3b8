"""PII: exact patterns, and a character-level BiLSTM-CRF that adds what they don't spell out.

A span of the model holds a digit, an `@`, or an `at` that is bracketed (`(at)`, `[AT]`, `{at}`) or
stands before a `dot` (`ann at mail dot com`); elsewhere all characters are outside. So windows are laid
only around such marks (`MARGIN` characters and more on both sides), over whole texts and without a
limit on their number. Windows overlap by half; each character takes its tag from the window whose edge
is farther off, and spans are formed over the reconciled tags of the whole text. Spans of the model are
snapped to word edges and must have the form of their kind (digits of a phone number, a card's check
digit, ...); those that touch a span of the patterns are dropped.

Windows are decoded `AT_ONCE` at a time, within a stretch too; a stretch keeps two bytes a character
until its tags are complete. So a text of marks alone takes a small multiple of its own size.

Defined cases: a null or empty text has no spans; texts without marks aren't read character by
character; equal rows get equal results; offsets are code points; columns other than doc_id and text
are passed by; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import pieces, read, text_bytes
from .pii_model import KINDS, Net, classes, luhn, spans_of, trained

WIDTH, STRIDE, MARGIN, AT_ONCE = 80, 40, 32, 2048
OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive where a group repeats: nothing after it could take less, and a long match needs no memory for ways back
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Written-out @, as a pattern that Python and RE2 read alike.
AT = r"(?i:[(\[{] ?at ?[)\]}]| at [a-z0-9-]+ dot [a-z])"
MARK = re.compile("[0-9@]|" + AT)
WRITTEN_EMAIL = re.compile(r"(?i)[\w.%+-]+\s?(?:@|[(\[{] ?at ?[)\]}])\s?[\w-]+(?:(?:\.| ?[(\[{] ?dot ?[)\]}] ?)[\w-]+)++|[\w.%+-]+ at [\w-]+(?: dot [\w-]+)++")
Span = tuple[str, int, int]


def emails(text: str) -> Iterator[Span]:
    """Each @ with the longest name before it, back to the last match at most, and a domain after it."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in NAME:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        else:
            end = max(end, at + 1)  # no name reaches over an @
        at = text.find("@", max(end, at + 1))


def at_most_255(part: str) -> bool:
    """Whether a run of digits, of any length, is a number up to 255."""
    own = part.lstrip("0")
    return len(own) < 3 or len(own) == 3 and own <= "255"


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    out = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(at_most_255, m[0].split(".")))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=order)


def order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches of the text with all marks and MARGIN characters around them."""
    out: list[list[int]] = []
    for m in MARK.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def starts(a: int, b: int) -> Sequence[int]:
    """Starts of windows over a stretch."""
    return [a] if b - a <= WIDTH else Starts(a, b)


class Starts(Sequence):
    """The starts of a long stretch, made when asked for: every STRIDE characters, and the last at its end."""

    def __init__(self, a: int, b: int):
        self.own, self.last = range(a, b - WIDTH, STRIDE), b - WIDTH

    def __len__(self) -> int:
        return len(self.own) + 1

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[j] for j in range(*i.indices(len(self)))]
        return self.own[i] if i < len(self.own) else self.last


class Stretch:
    """Tags of a stretch, made window by window: from the window whose nearer edge is farther off, the first of equal ones."""

    DEPTH = np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]).astype(np.int8)

    def __init__(self, a: int, b: int):
        self.a, self.b = a, b
        self.best, self.tags = np.full(b - a, -1, np.int8), np.zeros(b - a, np.int8)

    def add(self, start: int, tags: np.ndarray) -> None:
        n = min(WIDTH, self.b - start)
        own = slice(start - self.a, start - self.a + n)
        better = self.DEPTH[:n] > self.best[own]
        self.tags[own][better], self.best[own][better] = tags[:n][better], self.DEPTH[:n][better]


def edges(text: str, spans: Iterable[Span]) -> list[Span]:
    """The spans with their ends moved to word edges, in order. A word that holds many spans is walked once."""
    out, word = set(), (0, 0)

    def around(i: int) -> tuple[int, int]:
        """The word, start and end, that holds place i."""
        nonlocal word
        if not word[0] <= i < word[1]:
            a = b = i
            while a > 0 and text[a - 1].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum():
                b += 1
            word = a, b
        return word

    for kind, a, b in spans:
        if a > 0 and text[a - 1].isalnum():
            a = around(a - 1)[0]
        if b < len(text) and text[b].isalnum():
            b = around(b)[1]
        while a < b and not (text[a].isalnum() or text[a] in "+("):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        out.add((kind, a, b))
    return sorted(out, key=order)


def formed(text: str, s: Span) -> Span | None:
    """The span, without a lone bracket before it, if it has its kind's form."""
    kind, a, b = s
    x = text[a:b]
    if x.startswith("(") and ")" not in x:
        a, x = a + 1, x[1:]
    d = digits(x)
    fits = {
        "email": lambda: WRITTEN_EMAIL.fullmatch(x),
        "ip": lambda: re.fullmatch(r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}", x) and all(map(at_most_255, re.findall("[0-9]+", x))),
        "card": lambda: re.fullmatch(r"[0-9]+(?:[ .-][0-9]+)*+", x) and 12 <= len(d) <= 19 and luhn(d),
        "phone": lambda: re.fullmatch(r"\+?[0-9(][0-9 ().-]*[0-9]", x) and 9 <= len(d) <= 15 and re.search(r"[ ().+-]", x),
    }
    return (kind, a, b) if fits[kind]() else None


def apart(spans: list[Span], own: list[Span]) -> list[Span]:
    """Those of spans (in order) that touch none of own (in order) and no earlier one that stays."""
    begin = [s[1] for s in own]
    reach = list(itertools.accumulate((s[2] for s in own), max))
    out: list[Span] = []
    for s in spans:
        i = bisect.bisect_left(begin, s[2])  # those of own that begin before its end
        if (not i or reach[i - 1] <= s[1]) and (not out or out[-1][2] <= s[1]):
            out.append(s)
    return out


def decoded(texts: list[str], net: Net) -> list[list[Span]]:
    """The spans of each text, at word edges, by the reconciled tags of the model's windows."""
    found: list[list[Span]] = [[] for _ in texts]
    group: list[tuple[int, Stretch, Sequence[int], bool]] = []  # the windows of a part of a stretch, and whether it is the last part

    def flush() -> None:
        x, k = np.full((sum(len(g[2]) for g in group), WIDTH), 5, np.int64), 0
        for i, r, at, _ in group:
            p = classes(np.frombuffer(texts[i][at[0] : min(at[-1] + WIDTH, r.b)].encode("utf-32-le", "surrogatepass"), np.uint32))
            for s in at:
                n = min(WIDTH, r.b - s)
                x[k, :n] = p[s - at[0] : s - at[0] + n]
                k += 1
        tags, k = net.decode(x).astype(np.int8), 0
        for i, r, at, last in group:
            for s in at:
                r.add(s, tags[k])
                k += 1
            if last:
                found[i] += edges(texts[i], spans_of(r.tags, r.a))
        group.clear()

    n = 0
    for i, t in enumerate(texts):
        for a, b in regions(t):
            own, at, r = starts(a, b), 0, Stretch(a, b)
            while at < len(own):
                some = own[at : at + AT_ONCE - n]
                at, n = at + len(some), n + len(some)
                group.append((i, r, some, at == len(own)))
                if n == AT_ONCE:
                    flush()
                    n = 0
    if group:
        flush()
    return found


def find(texts: list[str], net: Net) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the patterns, spans that the model adds) of each text."""
    out = []
    for t, more in zip(texts, decoded(texts, net), strict=True):
        own = base_spans(t)
        fit = sorted({y for x in set(more) if (y := formed(t, x))}, key=order)
        out.append((own, apart(fit, own)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=order))


EMPTY = hashlib.sha256(b"").hexdigest()
MARKED = np.zeros(256, bool)
MARKED[[*range(48, 58), 64]] = True


def candidates(col: pa.Array) -> np.ndarray:
    """Rows that hold a mark; the rest has no spans."""
    data, offsets, _ = text_bytes(col)
    c = np.concatenate([[0], np.cumsum(MARKED[data])])
    at = np.asarray(pc.match_substring_regex(col.fill_null(""), AT).to_numpy(zero_copy_only=False), bool)
    return np.flatnonzero((c[offsets[1:]] > c[offsets[:-1]]) | at)


def pii(docs: DataFrame, net: Net) -> DataFrame:
    """Counts, digest and spans for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            n, own = b.num_rows, candidates(b.column(1))
            counts = {k: np.zeros(n, np.int64) for k in (*KINDS, "added")}
            sha, spans = [EMPTY] * n, [""] * n
            for i, (base, more) in zip(own, find([b.column(1)[int(i)].as_py() for i in own], net), strict=True):
                for k, _, _ in base:
                    counts[k][i] += 1
                counts["added"][i] = len(more)
                sha[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k]) for k in KINDS), pa.array(sha), pa.array(spans), pa.array(counts["added"])], names=[x.split()[0] for x in OUT.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, OUT)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span as its kind in angle brackets; of spans that overlap, their union as the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=order):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(read(spark, sf_dir, "documents"), trained())


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data redacted and n_chars as the new text has them."""
    net = trained()
    at, chars = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            own = candidates(b.column(at))
            if len(own):
                old = b.column(at).to_pylist()
                n = b.column(chars).to_pylist() if chars >= 0 else []
                for i, (base, more) in zip(own, find([old[i] for i in own], net), strict=True):
                    if base or more:
                        old[i] = redacted(old[i], base + more)
                        if n:
                            n[i] = len(old[i])
                cols = list(b.columns)
                cols[at] = pa.array(old, b.column(at).type)
                if n:
                    cols[chars] = pa.array(n, b.column(chars).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)
