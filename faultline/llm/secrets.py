"""Secret scans: base patterns, and a character convolutional network over every other candidate.

Base spans (assignments, access keys, long hex runs) always stay. Candidates
are all runs of 16 or more key characters that mix letters and digits, less the
base spans in them; the network reads each whole candidate, in windows, with the
characters before and after it, and the highest window counts. It is trained with numpy on a table of labelled findings, its outputs
are calibrated on findings held out from training, and the threshold is the
largest one that keeps the demanded recall there.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_texts

# The base patterns, their kinds in order, and the least length of what must be long enough.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "net")
LEAST = {"assign": 6, "access": 20, "hex": 24}
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Candidates: their characters and least length.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters the network sees of the candidate at once, and on either side of it.
INSIDE, AROUND = 48, 16
WIDTH, FILTERS, EMBED = 5, 16, 8
#: Recall that the threshold must keep on held-out findings; seed of training.
RECALL, SEED = 0.95, 20

ALPHABET = {c: i + 2 for i, c in enumerate(string.printable[:95])}  # 0: nothing, 1: any other character


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base findings as (kind, start, end), leftmost and non-overlapping for each kind."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # a run of hex digits is matched whole, so only long runs need to be looked for
    out += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs, and the parts of runs outside base spans, that are long enough and mix letters and digits."""
    found = []
    for m in CANDIDATE.finditer(text):
        parts, at = [], m.start()
        for _, a, b in base:  # by start
            if a < m.end() and at < b:
                parts.append((at, a))
                at = b
        for a, b in [*parts, (at, m.end())]:
            run = text[a:b]
            if CANDIDATE.fullmatch(run) and any(map(str.isdigit, run)) and any(map(str.isalpha, run)):
                found.append((a, b))
    return found


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Windows over a candidate and its context: (windows, characters, 2) of character number and inside mark."""
    step = INSIDE
    rows = []
    for a in range(start, end, step):
        b = min(a + INSIDE, end)
        before, after = text[max(0, a - AROUND):a], text[b:b + AROUND]
        codes = [0] * (AROUND - len(before)) + [ALPHABET.get(c, 1) for c in before + text[a:b]] + [0] * (INSIDE - (b - a))
        codes += [ALPHABET.get(c, 1) for c in after] + [0] * (AROUND - len(after))
        inside = [0] * AROUND + [1] * (b - a) + [0] * (INSIDE - (b - a) + AROUND)
        rows.append(np.array([codes, inside]).T)
    return np.stack(rows)


@dataclass
class Net:
    """Embedding, one convolution, maximum and mean over positions, one logit; then a calibrated scale."""

    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    def forward(self, x: np.ndarray) -> tuple:
        e = np.concatenate([self.embed[x[:, :, 0]], x[:, :, 1:2]], axis=2)
        n, length, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * d)
        h = np.maximum(cols @ self.conv + self.bias, 0)
        top = h.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None, :], 1)[:, 0], h.mean(axis=1), np.ones((n, 1))], axis=1)
        return pooled @ self.out, pooled, h, top, cols

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        z = np.concatenate([self.forward(x[i:i + 512])[0] for i in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-(self.scale[0] * z + self.scale[1])))

    def is_secret(self, text: str, spans: list[tuple[int, int]]) -> list[bool]:
        """Whether any window of each candidate reaches the threshold."""
        if not spans:
            return []
        parts = [encode(text, a, b) for a, b in spans]
        return (np.maximum.reduceat(self.probability(np.concatenate(parts)), _firsts(parts)) >= self.threshold).tolist()


def _firsts(parts: list[np.ndarray]) -> np.ndarray:
    """Position of each candidate's first window among all windows."""
    return np.cumsum([0] + [len(x) for x in parts[:-1]])


def labelled_findings(count: int = 3000, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): keys of common shapes (1) and long harmless runs (0), in their usual surroundings."""
    rnd = random.Random(seed)
    pick = lambda chars, a, b: "".join(rnd.choice(chars) for _ in range(rnd.randint(a, b)))
    low, alnum, b64, upper = string.ascii_lowercase, string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    word = lambda: pick(low, 2, 9)
    words = lambda n: " ".join(word() for _ in range(n))
    secret = [
        lambda: pick(alnum, 20, 60), lambda: pick(b64, 38, 40) + "=" * rnd.randint(0, 2), lambda: "sk_live_" + pick(alnum, 24, 34), lambda: "ghp_" + pick(alnum, 36, 36),
        lambda: "xoxb-" + pick(string.digits, 10, 12) + "-" + pick(alnum, 24, 24), lambda: "AIza" + pick(alnum + "-_", 35, 35), lambda: "glpat-" + pick(alnum + "-_", 20, 20),
        lambda: "eyJ" + pick(alnum, 20, 40) + "." + pick(alnum, 30, 60) + "." + pick(alnum + "-_", 30, 43), lambda: pick(string.hexdigits.upper()[:16] + "0123456789ABCDEF", 32, 64),
        lambda: pick(upper, 24, 40), lambda: pick(alnum + "._-", 24, 50),
    ]
    harmless = [
        lambda: ".".join([word() + str(rnd.randint(0, 99)), pick(low, 4, 12), rnd.choice(["com", "net", "org", "example.com"])]),
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(0, 23):02d}.{rnd.randint(0, 59):02d}",
        lambda: "_".join(word() for _ in range(4)) + f"_v{rnd.randint(1, 20)}", lambda: "/".join([word() for _ in range(4)] + [f"page{rnd.randint(1, 400)}.html"]),
        lambda: "".join(word().title() for _ in range(4)) + str(rnd.randint(1, 99)), lambda: f"{word()}-{rnd.randint(1, 20)}.{rnd.randint(0, 20)}.{rnd.randint(0, 9)}-{word()}.tar.gz",
        lambda: "-".join(word() for _ in range(5)) + f"-{rnd.randint(1, 999)}", lambda: f"10.{rnd.randint(1000, 9999)}/{word()}.{rnd.randint(2000, 2024)}.{rnd.randint(1, 999)}",
        lambda: f"/usr/lib/{word()}{rnd.randint(1, 9)}/{word()}/{word()}.so.{rnd.randint(1, 9)}", lambda: "www." + pick(low, 8, 16) + str(rnd.randint(1, 99)) + ".example.org",
        lambda: "=" * rnd.randint(4, 20) + word() + str(rnd.randint(0, 9)) + "=" * rnd.randint(4, 20), lambda: words(3).replace(" ", "") + str(rnd.randint(0, 9)),
        lambda: f"{rnd.randint(100, 999)}.{rnd.randint(100, 999)}.{rnd.randint(100, 999)}-{word()}-{rnd.randint(10, 99)}", lambda: ".".join(word() for _ in range(5)) + str(rnd.randint(0, 9)),
    ]
    around = [("", ""), ('key="', '"'), ("Authorization: Bearer ", "\n"), ("export KEY=", "\n"), ('"credential": "', '",'), ("auth ", " "), ("private_key: ", "\n"), (" ", " ")]
    plain = [("", ""), (" ", " "), ("see ", ", "), ("(", ")"), ("http://", " "), ("@", " "), ("file ", "."), ("\n", "\n"), ("in ", " and ")]
    out = []
    for k in range(count):
        label = k % 2
        run = rnd.choice(secret if label else harmless)()
        if len(run) < 16 or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            run += pick(alnum if label else low, 16, 18) + "7"
        a, b = rnd.choice(around if label and rnd.random() < 0.7 else plain)
        before, after = words(rnd.randint(0, 5)) + " " + a, b + words(rnd.randint(0, 5))
        out.append((before + run + after, len(before), len(before) + len(run), label))
    return out


@lru_cache(maxsize=4)
def train(count: int = 3000, recall: float = RECALL, seed: int = SEED) -> Net:
    """Fit on three quarters of the labelled findings; calibrate and set the threshold on the rest.

    A finding's output is that of its highest window, as when scanning.
    """
    table = labelled_findings(count, seed)
    x = [encode(t, a, b) for t, a, b, _ in table]
    y = np.array([float(label) for *_, label in table])
    rng = np.random.default_rng(seed)
    d = WIDTH * (EMBED + 1)
    net = Net(rng.normal(0, 0.3, (len(ALPHABET) + 2, EMBED)), rng.normal(0, d ** -0.5, (d, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.1, 2 * FILTERS + 1))
    mine = np.arange(len(x)) % 8 < 6
    fit_x, fit_y, held_x, held_y = [x[i] for i in np.flatnonzero(mine)], y[mine], [x[i] for i in np.flatnonzero(~mine)], y[~mine]
    params = [net.embed, net.conv, net.bias, net.out]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(10):
        for part in np.array_split(rng.permutation(len(fit_x)), len(fit_x) // 64):
            step += 1
            highest = _highest(net, [fit_x[i] for i in part])[0]
            for p, g, m, v in zip(params, _gradients(net, highest, fit_y[part]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.004 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    z = _highest(net, held_x)[1]
    w = np.zeros(2)
    f = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):  # scale and shift that make the held-out outputs probabilities
        p = 1 / (1 + np.exp(-f @ w))
        w = w + np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 0.05 * np.eye(2), f.T @ (held_y - p) - 0.05 * w)
    net.scale = (float(w[0]), float(w[1]))
    held = net.probability(np.concatenate(held_x))
    positive = np.sort(np.maximum.reduceat(held, _firsts(held_x))[held_y == 1])
    net.threshold = float(positive[int((1 - recall) * len(positive))])
    return net


def _highest(net: Net, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each finding the window with the highest output, and that output."""
    x = np.concatenate(parts)
    z, at = net.forward(x)[0], _firsts(parts)
    best = [a + int(z[a:a + len(p)].argmax()) for a, p in zip(at, parts)]
    return x[best], z[best]


def _gradients(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log loss for embedding, convolution, bias and output."""
    z, pooled, h, top, cols = net.forward(x)
    n, places = h.shape[:2]
    dz = (1 / (1 + np.exp(-z)) - y) / n
    d_out = pooled.T @ dz
    d_pool = dz[:, None] * net.out[None, :]
    dh = np.repeat(d_pool[:, None, FILTERS:2 * FILTERS] / places, places, axis=1)
    np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + d_pool[:, None, :FILTERS], 1)
    dh *= h > 0
    flat = dh.reshape(-1, FILTERS)
    d_conv = cols.reshape(-1, cols.shape[2]).T @ flat
    d_cols = (flat @ net.conv.T).reshape(n, places, WIDTH, EMBED + 1)[..., :EMBED]
    used = np.stack([x[:, k:k + places, 0] for k in range(WIDTH)], axis=2).ravel()
    d_embed = np.stack([np.bincount(used, d_cols[..., e].ravel(), len(net.embed)) for e in range(EMBED)], axis=1)
    return [d_embed, d_conv, flat.sum(axis=0), d_out]


RESULT = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, carry: list[str], text_col: str = "text", net: Net | None = None) -> DataFrame:
    """The ``carry`` columns of every row and ``findings``: (kind, start, end) in code points, by start, then kind.

    Null, empty and harmless texts have no findings; rows that repeat are each
    scanned; other columns are ignored; no rows give none.
    """
    model = net or train()

    def start():
        def compute(texts):
            out = []
            for raw in texts:
                text = bytes(raw).decode() if raw else ""
                base = base_spans(text)
                runs = candidates(text, base)
                added = [("net", a, b) for (a, b), yes in zip(runs, model.is_secret(text, runs)) if yes]
                spans = sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            return [out]
        return compute

    return map_texts(docs, text_col, carry, [T.StructField("findings", RESULT)], start)


def report(docs: DataFrame) -> DataFrame:
    """op9's counts and digests of each document."""
    found = scan(docs, ["doc_id"])
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]],
                        F.sha2(joined(F.filter("findings", lambda s: s["kind"] != "net")), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
