"""Byte-level BPE compiled to a deterministic transducer that annotates transitions with token counts.

Reading a pre-token byte by byte, the number of tokens of what has been read so far changes by an
amount that the state and the byte determine; that amount annotates the transition. A state holds what
later bytes can depend on: for each earlier place from which the bytes read since are the beginning
of some longer token, that beginning, the last token before the place, and the count there.
The last token of a prefix is the one that ends there and stands validly beside the last token before
it; tokens stand validly side by side if merging their bytes together gives just the two.

Bytes are read in chunks side by side. A chunk's state map takes each state that may enter it to the
state that leaves it and the tokens counted in between; the maps of neighbouring chunks are composed
by a prefix scan of doubling steps, so one pre-token of any length is read in parallel too.

States are made when first reached, so texts pay for the states they visit, and dropped together
when there are too many, so memory is bounded for any text.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from .bytetext import code_points

CHUNK, MOST_STATES = 128, 150_000
#: Entering states by which a chunk's map is held at most; where more would be needed, the rest is read chunk by chunk.
MOST_ENTRIES = 48
#: Beginnings of at most so many tokens are looked into, to take states with equal futures for one.
ENDS = 16
#: Classes of characters for the cut in pre-tokens.
BLANK, SPACE, LETTER, NUMBER, OTHER, QUOTE = range(6)


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in the files of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Machine:
    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a byte-level BPE without normaliser")
        if spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("add_prefix_space isn't supported")
        unlettered = lambda s: bytes(letters[c] for c in s)
        self.specials = [x["content"].encode() for x in spec.get("added_tokens", [])]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or stand alone aren't supported")
        self.ids = {unlettered(t): i for t, i in model["vocab"].items() if t.encode() not in self.specials}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (unlettered(x) for x in (m.split(" ") if isinstance(m, str) else m))
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.bytes_of = {i: t for t, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.child: dict[int, int] = {}
        self.token, self.inner = [-1], [True]
        for t, i in self.ids.items():
            node = 0
            for b in t:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.token[node] = i
        self.below: list[list[int] | None] = [None] * len(self.token)
        for key, node in self.child.items():
            self.below[key >> 8] = [*(self.below[key >> 8] or []), node]
        self.stable: dict[int, bool] = {}
        self.ends: dict[int, list[int] | None] = {}
        made = {new: (rank, a, b) for (a, b), (rank, new) in self.merges.items()}
        self.simple = len(made) == len(self.merges)  # each token comes from one merge
        self.left_edge, self.right_edge = ({} for _ in range(2))
        for i in sorted(self.bytes_of, key=lambda i: len(self.bytes_of[i])):
            if i in made:
                rank, a, b = made[i]
                self.left_edge[i] = [*self.left_edge[a], (rank, i)]
                self.right_edge[i] = [*self.right_edge[b], (rank, i)]
            else:
                self.left_edge[i] = self.right_edge[i] = [(-1, i)]
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [((0, -1, 0),)]
        self.number = {self.states[0]: 0}
        self.beside: dict[tuple[int, int], bool] = {}
        self.alike: dict[tuple[int, int], int | None] = {}
        self.kinds: dict[tuple, int] = {}
        self.used, self.bits = 0, 16
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)

    def encode(self, text: bytes) -> list[int]:
        """Token ids by merging, straight from the definition."""
        out = [self.single[b] for b in text]
        while len(out) > 1:
            rank, at, new = min(((*self.merges.get(p, (1 << 30, -1))[:1], i, self.merges.get(p, (0, -1))[1]) for i, p in enumerate(zip(out, out[1:], strict=False))), default=(1 << 30, 0, 0))
            if rank == 1 << 30:
                break
            out[at : at + 2] = [new]
        return out

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens stand side by side in what merging makes of their bytes; left -1: nothing."""
        if left < 0:
            if right not in self.stable:
                self.stable[right] = self.encode(self.bytes_of[right]) == [right]
            return self.stable[right]
        key = (left, right)
        got = self.beside.get(key)
        if got is None:
            got = self.beside[key] = self.valid(-1, left) and self.valid(-1, right) and not self.crossed(left, right)
        return got

    def crossed(self, left: int, right: int) -> bool:
        """Whether a merge joins bytes of both tokens.

        Each side's piece at the border grows by that side's own merges, in the order of their ranks;
        the border is crossed if at some time the two pieces merge before either grows. Of equal
        ranks the merge farther left comes first.
        """
        if not self.simple:
            return self.encode(self.bytes_of[left] + self.bytes_of[right]) != [left, right]
        a, b = self.right_edge[left], self.left_edge[right]
        i = j = 0
        while True:
            up_a = a[i + 1][0] if i + 1 < len(a) else 1 << 30
            up_b = b[j + 1][0] if j + 1 < len(b) else 1 << 30
            m = self.merges.get((a[i][1], b[j][1]))
            if m is not None and m[0] < up_a and m[0] <= up_b:
                return True
            if up_a == up_b == 1 << 30:
                return False
            if up_a <= up_b:
                i += 1
            else:
                j += 1

    def tokens_below(self, node: int, most: int = ENDS) -> list[int] | None:
        """Tokens that begin with the node's bytes and are longer; None: more than most."""
        if node in self.ends:
            return self.ends[node]
        self.ends[node] = None
        out, open_ = [], list(self.below[node] or [])
        while open_:
            n = open_.pop()
            if self.token[n] >= 0:
                out.append(self.token[n])
                if len(out) > most:
                    return None
            open_ += self.below[n] or []
        self.ends[node] = out
        return out

    def standing(self, node: int, last: int) -> int | None:
        """A token that stands for `last` before a beginning: the first with the same valid ends; None: no end is valid."""
        key = (node, last)
        if key not in self.alike:
            ends = self.tokens_below(node)
            if ends is None:
                self.alike[key] = last
            else:
                fit = tuple(t for t in ends if self.valid(last, t))
                self.alike[key] = self.kinds.setdefault((node, fit), last) if fit else None
        return self.alike[key]

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, change of the token count)."""
        nexts, found = [], None
        for node, last, rel in self.states[state]:
            n = self.child.get(node << 8 | byte)
            if n is None:
                continue
            if found is None and self.token[n] >= 0 and self.valid(last, self.token[n]):
                found = (self.token[n], rel + 1)
            if self.inner[n] and (same := self.standing(n, last)) is not None:
                nexts.append((n, same, rel))
        token, delta = found
        key = (*((n, last, rel - delta) for n, last, rel in nexts), (0, token, 0))
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.states)
            self.states.append(key)
        return got, delta

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key (state * 256 + byte) is in the table, or the free slot in which it would be."""
        mask = np.int64((1 << self.bits) - 1)
        at = ((keys * np.int64(0x9E3779B97F4A7C15 - (1 << 64))) >> np.int64(64 - self.bits)) & mask
        found = self.keys[at]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            found = self.keys[at[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return at

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct new keys; the table grows at half its slots."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            while 2 * len(keys) > 1 << self.bits:
                self.bits += 1
            self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0
        self.used += len(keys)
        while len(keys):  # each free slot goes to one key a round
            at = self.slots(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values = keys[left], values[left]

    def steps(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and count changes of many states and bytes at once."""
        keys = states << 8 | data
        at = self.slots(keys)
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            missing = np.unique(keys[new])
            made = [self.step(key >> 8, key & 255) for key in missing.tolist()]
            self.put(missing, np.array([to << 8 | (delta + 128) for to, delta in made], np.int64))
            at = self.slots(keys)
        v = self.values[at]
        return v >> 8, (v & 255) - 128

    def run(self, state: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaving states and counts of the first bytes of rows, as many as lengths say, entered by the states."""
        state, n = state.copy(), np.zeros(len(state), np.int64)
        for j in range(int(lengths.max(initial=0))):
            on = np.flatnonzero(lengths > j)
            state[on], d = self.steps(state[on], rows[on, j])
            n[on] += d
        return state, n

    def run_beginnings(self, kind: np.ndarray, enter: np.ndarray, heads: np.ndarray, lengths: np.ndarray, known: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What comes out of chunk beginnings for entering states: (leaving states, tokens counted).

        kind: which of the distinct beginnings (heads, lengths) each one is; known: what has been run, by kind and state.
        """
        key, back = np.unique(kind << 32 | enter, return_inverse=True)
        new = np.array([k for k in key.tolist() if k not in known], np.int64)
        if len(new):
            state, n = self.run(new & 0xFFFFFFFF, heads[new >> 32], lengths[new >> 32])
            known.update(zip(new.tolist(), zip(state.tolist(), n.tolist(), strict=True), strict=True))
        out = np.array([known[k] for k in key.tolist()], np.int64).reshape(-1, 2)[back.ravel()]
        return out[:, 0], out[:, 1]

    def composed(self, first: np.ndarray, leaving: np.ndarray, heads: np.ndarray, kind: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens counted in the beginnings of chunks that stand before the chunks' first pre-token start.

        first: length of each chunk's beginning; leaving: the state that leaves each chunk, -1 where that depends on what
        enters; kind: the distinct beginning of each chunk that has one.
        A map's entries are found by trial: chunks are entered by a guess, then by what left their left neighbour, and so on,
        until no chunk is entered by a new state. As a state forgets what lies farther back than a few tokens, that ends soon.
        """
        own = np.flatnonzero(first > 0)
        place = np.full(len(first), -1)
        place[own] = np.arange(len(own))
        left = place[own - 1]  # own[i]'s left neighbour within own, -1: it has no open beginning
        sure = leaving[own - 1]  # the entering state, where it doesn't depend on the left neighbour's
        known: dict[int, tuple[int, int]] = {}
        enters = np.where(sure >= 0, sure, 0)[:, None]
        to, n = self.run_beginnings(kind[own], enters[:, 0], heads, lengths, known)
        tos, ns = to[:, None], n[:, None]
        while True:
            # what leaves the left neighbour last enters next, where that is new
            new = np.where(sure < 0, tos[left, -1], -1)
            new[(enters == new[:, None]).any(1)] = -1
            at = np.flatnonzero(new >= 0)
            if not len(at) or enters.shape[1] == MOST_ENTRIES:
                break
            to, n = np.full(len(own), -1), np.zeros(len(own), np.int64)
            to[at], n[at] = self.run_beginnings(kind[own[at]], new[at], heads, lengths, known)
            enters, tos, ns = np.column_stack([enters, new]), np.column_stack([tos, to]), np.column_stack([ns, n])
        # a map as numbers: entry of the left neighbour to entry here, -1 where it isn't among the entries
        width, rows = enters.shape[1], np.arange(len(own))[:, None]
        step = np.full((len(own), width), -1)
        dependent = np.flatnonzero(sure < 0)
        for e in range(width):
            came = tos[left[dependent], e]
            hit = (enters[dependent] == came[:, None]) & (came >= 0)[:, None]
            step[dependent, e] = np.where(hit.any(1), hit.argmax(1), -1)
        step[sure >= 0] = 0
        origin, jump = np.where(sure >= 0, np.arange(len(own)), left), step
        while (origin[origin] != origin).any():  # doubling: each map is composed with the one that reaches up to its left end
            before = jump[origin]
            jump = np.where(before >= 0, jump[rows, before], -1)
            origin = origin[origin]
        entry = jump[:, 0]
        out = np.where(entry >= 0, ns[rows[:, 0], entry], 0)
        if (entry < 0).any():
            out = self.chunk_by_chunk(entry, left, tos, out, kind[own], heads, lengths, known)
        count = np.zeros(len(first), np.int64)
        count[own] = out
        return count

    def chunk_by_chunk(self, entry: np.ndarray, left: np.ndarray, tos: np.ndarray, out: np.ndarray, kind: np.ndarray, heads: np.ndarray, lengths: np.ndarray, known: dict) -> np.ndarray:
        """The counts of the chunks whose entering state is in no map, from left to right."""
        leaves = np.where(entry >= 0, tos[np.arange(len(entry)), entry], -1)
        todo = np.flatnonzero(entry < 0)
        while len(todo):
            ready = leaves[left[todo]] >= 0
            now, todo = todo[ready], todo[~ready]
            leaves[now], out[now] = self.run_beginnings(kind[now], leaves[left[now]], heads, lengths, known)
        return out

    def deltas(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Token counts by byte, of which only the sums over whole pre-tokens are meant; starts: where pre-tokens begin (the first byte does).

        Of a chunk's state map all is constant after its first pre-token start, and only what lies
        before depends on the state that enters. First all chunks run from their first start on; then
        the maps of the beginnings are composed.
        """
        if len(self.states) > MOST_STATES:
            self.reset()
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        rows = -(-n // CHUNK)
        d = np.zeros(rows * CHUNK, np.int64)
        d[:n] = data
        s = np.zeros(rows * CHUNK, bool)
        s[:n], s[n:] = starts, True
        d, s = d.reshape(rows, CHUNK), s.reshape(rows, CHUNK)
        out = np.zeros((rows, CHUNK), np.int64)
        first = np.where(s.any(1), s.argmax(1), CHUNK)
        state = np.full(rows, -1, np.int64)  # unknown
        for j in range(CHUNK):
            state[s[:, j]] = 0
            on = np.flatnonzero(first <= j)
            if len(on):
                state[on], out[on, j] = self.steps(state[on], d[on, j])
        # beginnings after a chunk whose leaving state is known, and that let nothing through
        own = np.flatnonzero((first > 0) & (first < CHUNK))
        own = own[state[own - 1] >= 0]
        out[own, 0] += self.run(state[own - 1], d[own], first[own])[1]
        open_ = first > 0
        open_[own] = False
        if open_.any():
            heads = np.where(np.arange(CHUNK) < first[:, None], d, 0)[open_]
            marked = np.column_stack([heads, first[open_]]).astype(np.uint8)  # CHUNK fits a byte
            _, at, back = np.unique(marked.view(f"V{CHUNK + 1}").ravel(), return_index=True, return_inverse=True)
            kind = np.full(rows, -1)
            kind[open_] = back.ravel()
            out[:, 0] += self.composed(np.where(open_, first, 0), state, heads[at], kind, first[open_][at])
        return out.reshape(-1)[:n]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text; special strings count one token each and end what is before them."""
        n = np.zeros(len(offsets) - 1, np.int64)
        cuts = [offsets]
        raw = data.tobytes() if self.specials else b""
        hits = special_hits(raw, self.specials, offsets)
        if hits:
            keep = np.ones(len(data), bool)
            for a, b in hits:
                n[np.searchsorted(offsets, a, "right") - 1] += 1
                keep[a:b] = False
            moved = np.concatenate([[0], np.cumsum(keep)])
            cuts = [moved[offsets], moved[[a for a, _ in hits]]]
            data, offsets = data[keep], moved[offsets]
        if len(data):
            starts = pretoken_starts(data, np.unique(np.concatenate(cuts)))
            c = np.concatenate([[0], np.cumsum(self.deltas(data, starts))])
            n += c[offsets[1:]] - c[offsets[:-1]]
        return n


def special_hits(raw: bytes, specials: list[bytes], offsets: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of special strings within texts, leftmost first, without overlaps."""
    found = []
    for x in specials:
        at = raw.find(x)
        while at >= 0:
            found.append((at, at + len(x)))
            at = raw.find(x, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found, key=lambda h: (h[0], -h[1])):
        inside = np.searchsorted(offsets, a, "right") == np.searchsorted(offsets, b - 1, "right")
        if inside and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


_classes: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _classes:
        t = np.full(0x110000, OTHER, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                t[c] = LETTER
            elif k == "N":
                t[c] = NUMBER
        t[[*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        t[32], t[39] = BLANK, QUOTE
        _classes.append(t)
    return _classes[0]


def pretoken_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, by byte. bounds: where texts begin, and the end.

    The cut is that of an automaton whose state is the class of the character before: letters, numbers
    and other marks run on, one blank before them is theirs, white space is a run whose last character
    goes on its own if something follows, and 's 't 're 've 'm 'll 'd after anything but a mark or a
    blank are cut off.
    """
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    cp = code_points(data, lead)
    k = class_table()[cp]
    n = len(k)
    begin = np.zeros(n + 1, bool)
    begin[np.searchsorted(lead, bounds)] = True
    begin[0] = begin[n] = True
    first, last = begin[:-1], begin[1:]
    white = k <= SPACE
    mark = k >= OTHER
    before = np.concatenate([[OTHER], k[:-1]])
    white_before = (before <= SPACE) & ~first
    start = first.copy()
    # white space: a run's first character, and its last before something else
    nxt_white = np.concatenate([white[1:], [True]])
    start |= white & (~white_before | (~last & ~nxt_white))
    # others: after white space that isn't a blank, or where the kind changes
    run = np.where(mark, OTHER, k)
    run_before = np.where(before >= OTHER, OTHER, before)
    start |= ~white & np.where(white_before, before != BLANK, run != run_before)
    # contractions
    nxt = np.concatenate([cp[1:], [0]])
    nxt[last] = 0
    nxt2 = np.concatenate([nxt[1:], [0]])
    nxt2[last] = 0
    free = (k == QUOTE) & (first | (before == SPACE) | (before == LETTER) | (before == NUMBER))
    one = free & np.isin(nxt, [ord(c) for c in "stmd"])
    two = free & (((nxt == ord("r")) | (nxt == ord("v"))) & (nxt2 == ord("e")) | (nxt == ord("l")) & (nxt2 == ord("l")))
    for hit, size in ((one, 2), (two, 3)):
        at = np.flatnonzero(hit)
        start[at] = True
        for j in range(1, size):
            start[at + j] = False
        after = at + size
        start[after[after < n]] = True
    out = np.zeros(len(data), bool)
    out[lead[start]] = True
    return out
