"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and Viterbi decoding.

Trained from labelled spans: sentences of invented words into which personal data of many written
forms, or numbers and keys that aren't personal data, are put at known places. Everything is drawn
from one seed, so every process trains the same model.
"""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0: outside; then beginning and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
SINGLES = "@.-+()_%:/=\"',#[]{}"
N_CLASSES = 8 + len(SINGLES)


def class_table() -> np.ndarray:
    t = np.full(128, 6, np.uint8)  # other ASCII
    for c in range(128):
        x = chr(c)
        t[c] = 0 if x.isdigit() else 1 if x in "abcdef" else 2 if x.islower() else 3 if x.isupper() else 4 if x == " " else 5 if x.isspace() else 6
    for i, x in enumerate(SINGLES):
        t[ord(x)] = 8 + i
    return t


TABLE = class_table()


def classes(points: np.ndarray) -> np.ndarray:
    """The class of each code point; 7: beyond ASCII."""
    return np.where(points < 128, TABLE[np.minimum(points, 127)], 7).astype(np.int64)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Penalties of tags at the start and of transitions: an inside tag follows its own kind only."""
    start, move = np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        start[2 + 2 * k] = -1e4
        move[:, 2 + 2 * k] = -1e4
        move[1 + 2 * k, 2 + 2 * k] = move[2 + 2 * k, 2 + 2 * k] = 0
    return start, move


START, MOVE = allowed()


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        d = int(x) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def sample(rng: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A sentence and its spans (kind, start, end)."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "ou", "é", "ü", "ción", "eau")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        base = rng.choice("3456") + number(rng.choice((14, 14, 14, 13, 11)))
        d = next(base + x for x in "0123456789" if luhn(base + x))
        sep = rng.choice(("", "", " ", "-", "."))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c, cc = number(3), number(3), number(4), rng.choice(("1", "44", "49", "33", "34"))
        return rng.choice((f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{cc}{a}{b}{c}", f"00{cc} {a} {b}{c}", f"({a}) {b} {c}"))

    def email() -> str:
        name, host, top = word()[:8] + rng.choice(("", "." + number(2), "_" + word()[:4])), rng.choice(("mail", "post", "corp")) + rng.choice(("", number(1))), rng.choice(("com", "org", "example.com", "de", "co.uk"))
        return rng.choice((f"{name}@{host}.{top}", f"{name}@{host}.{top}", f"{name} @ {host}.{top}", f"{name}(at){host}.{top}", f"{name} [at] {host}.{top}", f"{name}@{host}(dot){top}", f"{name} (AT) {host}.{top}", f"{name}{{at}}{host}.{top}", f"{name} at {host} dot {top.replace('.', ' dot ')}"))

    def ip() -> str:
        return rng.choice((".", ".", ".", "[.]")).join(str(rng.randint(0, 255)) for _ in range(4))

    def junk() -> str:
        hexa = "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((18, 32, 40))))
        key = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
        return rng.choice((f'token = "{hexa}"', f"password={hexa}", f"AKIA{key}", f"Version {rng.randint(1, 9)}.0.", f"CC BY-NC {rng.randint(1, 4)}.0.", f"{rng.randint(1800, 2030)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", number(rng.randint(1, 9)), f"{rng.randint(1, 99)}%", f"{number(2)}:{number(2)}", f"{number(3)}.{number(2)}", f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", f"@{word()}", f"{number(4)}/{number(2)}", f"${number(3)},{number(3)}"))

    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(0, 5))) + rng.choice((" ", " ", ": ", ", ", "\n", " ("))
        if rng.random() < 0.6:
            kind = rng.choice(KINDS)
            value = {"card": card, "phone": phone, "email": email, "ip": ip}[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
        else:
            value = junk()
        text += value + rng.choice((" ", " ", ". ", ", ", ") ", ""))
    text += " ".join(word() for _ in range(rng.randint(0, 4)))
    return text, spans


def encoded(rows: list[tuple[str, list]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes, tags and mask of sentences, cut or padded to width."""
    x, y, m = np.full((len(rows), width), 5, np.int64), np.zeros((len(rows), width), np.int64), np.zeros((len(rows), width), np.float32)
    for i, (text, spans) in enumerate(rows):
        p = np.frombuffer(text[:width].encode("utf-32-le"), np.uint32)
        x[i, : len(p)], m[i, : len(p)] = classes(p), 1
        for kind, a, b in spans:
            k = KINDS.index(kind)
            if a < width:
                y[i, a] = 1 + 2 * k
                y[i, a + 1 : min(b, width)] = 2 + 2 * k
    return x, y, m


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Net:
    """Parameters by name: for each direction a table of inputs by class (which embeds them), recurrent weights; then output and CRF."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
        self.h = hidden
        self.p = {f"in{d}": n(N_CLASSES, 4 * hidden) for d in "fb"} | {f"re{d}": n(hidden, 4 * hidden) for d in "fb"} | {"out": n(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in "fb":
            self.p[f"in{d}"][:, hidden : 2 * hidden] += 1.0  # forget gates open

    def lstm(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (T, B, H) for classes (B, T), with what the way back needs in keep."""
        b, t = x.shape
        h, c = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
        out = np.empty((t, b, self.h), np.float32)
        table, re = self.p[f"in{d}"], self.p[f"re{d}"]
        H = self.h
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            z = table[x[:, s]] + h @ re
            g = sigmoid(z[:, : 3 * H])
            a = np.tanh(z[:, 3 * H :])
            i, f, o = g[:, :H], g[:, H : 2 * H], g[:, 2 * H :]
            c_new = f * c + i * a
            tc = np.tanh(c_new)
            h_new = o * tc
            if keep is not None:
                keep.append((s, h, c, i, f, o, a, tc))
            h, c = h_new, c_new
            out[s] = h
        return out

    def lstm_back(self, x: np.ndarray, d: str, keep: list, dout: np.ndarray, grads: dict) -> None:
        b = x.shape[0]
        dh, dc = np.zeros((b, self.h), np.float32), np.zeros((b, self.h), np.float32)
        re = self.p[f"re{d}"]
        for s, h0, c0, i, f, o, a, tc in reversed(keep):
            dh = dh + dout[s]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * a * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - a * a)], 1)
            onehot = np.zeros((b, N_CLASSES), np.float32)
            onehot[np.arange(b), x[:, s]] = 1
            grads[f"in{d}"] += onehot.T @ dz
            grads[f"re{d}"] += h0.T @ dz
            dh, dc = dz @ re.T, dc * f

    def emissions(self, x: np.ndarray) -> np.ndarray:
        h = np.concatenate([self.lstm(x, "f"), self.lstm(x, "b")], 2)
        return h @ self.p["out"] + self.p["bias"]

    def loss(self, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[float, dict]:
        """CRF loss a row and its gradients."""
        b, t = x.shape
        kf, kb = [], []
        h = np.concatenate([self.lstm(x, "f", kf), self.lstm(x, "b", kb)], 2)
        e = h @ self.p["out"] + self.p["bias"]
        move, start = self.p["move"] + MOVE, self.p["start"] + START
        alpha = np.empty((t, b, TAGS), np.float32)
        alpha[0] = start + e[0]
        for s in range(1, t):
            z = alpha[s - 1][:, :, None] + move
            top = z.max(1)
            new = top + np.log(np.exp(z - top[:, None]).sum(1)) + e[s]
            alpha[s] = np.where(m[:, s, None] > 0, new, alpha[s - 1])
        top = alpha[-1].max(1)
        logz = top + np.log(np.exp(alpha[-1] - top[:, None]).sum(1))
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.zeros_like(e)
        beta, rows = np.zeros((b, TAGS), np.float32), np.arange(b)
        gold = start[y[:, 0]] + e[0][rows, y[:, 0]]
        for s in range(t - 1, -1, -1):
            on = m[:, s, None]
            p = np.exp(np.minimum(alpha[s] + beta - logz[:, None], 0)) * on
            de[s] = p
            de[s][rows, y[:, s]] -= m[:, s]
            if s:
                z = np.exp(np.minimum(alpha[s - 1][:, :, None] + move + (e[s] + beta)[:, None, :] - logz[:, None, None], 0)) * on[:, :, None]
                grads["move"] += z.sum(0)
                np.add.at(grads["move"], (y[:, s - 1], y[:, s]), -m[:, s])
                gold += m[:, s] * (move[y[:, s - 1], y[:, s]] + e[s][rows, y[:, s]])
                w = move + (e[s] + beta)[:, None, :]
                top = w.max(2)
                beta = np.where(on > 0, top + np.log(np.exp(w - top[:, :, None]).sum(2)), beta)
        grads["start"] = de[0].sum(0)
        de /= b
        grads["move"] /= b
        grads["start"] /= b
        grads["out"] = np.tensordot(h, de, ([0, 1], [0, 1]))
        grads["bias"] = de.sum((0, 1))
        dh = de @ self.p["out"].T
        self.lstm_back(x, "f", kf, dh[:, :, : self.h], grads)
        self.lstm_back(x, "b", kb, dh[:, :, self.h :], grads)
        return float((logz - gold).mean()), grads

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (B, T) by Viterbi."""
        e = self.emissions(x)
        move = self.p["move"] + MOVE
        t, b, _ = e.shape
        back = np.zeros((t, b, TAGS), np.int8)
        v = self.p["start"] + START + e[0]
        for s in range(1, t):
            z = v[:, :, None] + move
            back[s] = z.argmax(1)
            v = z.max(1) + e[s]
        out, rows = np.empty((b, t), np.int64), np.arange(b)
        out[:, -1] = v.argmax(1)
        for s in range(t - 1, 0, -1):
            out[:, s - 1] = back[s][rows, out[:, s]]
        return out


@functools.lru_cache(maxsize=2)
def trained(steps: int = 320, batch: int = 96, width: int = 80, seed: int = 11) -> Net:
    """The model, trained by Adam; the same for every process and kept within one."""
    rng, net = random.Random(seed), Net()
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        _, g = net.loss(*encoded([sample(rng) for _ in range(batch)], width))
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 10) * (1 - 0.9 * step / steps)
        for k, x in g.items():
            x *= min(1, 5 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * x
            second[k] = 0.999 * second[k] + 0.001 * x * x
            net.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def spans_of(tags: np.ndarray, at: int = 0) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of a row of tags whose first is at place `at`, in order."""
    before = np.concatenate([np.zeros(1, tags.dtype), tags[:-1]])
    begins = (tags > 0) & ((before == 0) | ((tags + 1) // 2 != (before + 1) // 2) | (tags % 2 == 1))
    ends = (before > 0) & (begins | (tags == 0))
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    if len(last) < len(first):
        last = np.concatenate([last, [len(tags)]])
    kinds = (tags[first] - 1) // 2
    for i in range(0, len(first), 4096):  # the spans of a long row are made a few at a time
        own = slice(i, i + 4096)
        yield from zip([KINDS[k] for k in kinds[own]], (first[own] + at).tolist(), (last[own] + at).tolist(), strict=True)
