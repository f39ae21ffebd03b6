"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length.

Folding lower-cases, turns homoglyphs of Latin letters and digits or signs
that stand for letters into those letters, and everything else but letters into
single spaces. Lexicon entries are whole words or stems (word beginnings); their
weights are smoothed log odds among labelled training documents, over a base
list of insults with a prior weight. An entry inside an exception phrase does
not count. The sum of weights, per length, is turned into a probability by a
logistic curve fitted on the same training documents.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_texts, unused
from faultline.session import cut_lineage

#: Labelled documents that the lexicon and the curve are fitted on at most: a bounded sample, chosen by hash.
FIT_ROWS = 20_000
#: Shortest and longest stem; least distinct contexts (neighbouring words) of an entry in toxic documents, so that
#: copies of one document are no evidence; least log odds.
STEMS, SUPPORT, LEAST_ODDS = (4, 7), 4, 3.2
#: A stem is left out if one longer entry has this share of its contexts.
SAME_WORD = 0.8
#: Weight of a base entry that the training documents do not tell about.
PRIOR_WEIGHT = 3.0

# Insults, phrases in which they are harmless, and characters that stand for letters.
BASE = """asshole bastard bitch clown coward crap creep cretin cunt degenerate dickhead disgusting dumbass dunce filth
fool fucker hag idiot imbecile jackass jerk loser maggot moron pathetic pig prick retard scoundrel scum scumbag shithead
slut stupid swine trash twat vermin wanker weirdo whore worthless""".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "idiot proof", "clown fish", "guinea pig", "pig iron", "circus clown"]
HOMOGLYPHS = dict(zip("авеёікмнорстухѕјԁɡαβεικνορτυχ", "abeeikmhopctyxsjdgabeiknoptux"))
DIGITS = dict(zip("013457", "oieast"))
SIGNS = {b"@": b"a", b"$": b"s", b"!": b"i"}

#: ASCII to letters and spaces (digits that stand for letters included); signs stay for a second look.
PLAIN = bytes(ord(DIGITS[chr(c)]) if chr(c) in DIGITS else c if 97 <= c <= 122 or c >= 128 or bytes([c]) in SIGNS else 32 for c in range(256))
NO_SIGNS = bytes(32 if bytes([c]) in SIGNS else c for c in range(256))
SIGN = re.compile(rb"[@$!](?=[a-z])")
GLYPH = re.compile("[" + "".join(HOMOGLYPHS) + "Ａ-Ｚａ-ｚ]")
MAY_HOLD_GLYPHS = re.compile(rb"[\xc9\xce-\xd4\xef]")
MARKS = re.compile(rb"\xe2\x80.|\xc2.")


def _letter(m: re.Match) -> str:
    c = m[0]
    return HOMOGLYPHS.get(c) or chr((ord(c) - 0xFF21) % 32 + 97)


def fold(text: bytes | None) -> bytes:
    """The words of a text in folded letters, one space before each and after the last."""
    if not text:
        return b" "
    out = bytes(text).decode().lower().encode()
    if MAY_HOLD_GLYPHS.search(out):
        out = GLYPH.sub(_letter, out.decode()).encode()
    if b"\xe2\x80" in out or b"\xc2" in out:
        out = MARKS.sub(b" ", out)
    out = out.translate(PLAIN)
    if b"@" in out or b"$" in out or b"!" in out:
        out = SIGN.sub(lambda m: SIGNS[m[0]], out).translate(NO_SIGNS)
    return b" " + b"".join(w + b" " for w in out.split())


@dataclass
class Model:
    """Entries (folded text with its leading and, for whole words, closing space) and the curve."""

    weights: dict[bytes, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def matcher(self):
        auto = ahocorasick.Automaton()
        for entry, w in self.weights.items():
            auto.add_word(entry.decode("latin-1"), (len(entry), w))
        for phrase in EXCEPTIONS:
            p = b" " + phrase.encode() + b" "
            auto.add_word(p.decode("latin-1"), (len(p), None))
        auto.make_automaton()
        return auto

    def features(self, auto, folded: bytes) -> tuple[float, float]:
        """Weight per thousand words (log scale) and whether anything matched."""
        found = [(end - n + 1, end, w) for end, (n, w) in auto.iter(folded.decode("latin-1"))]
        if not found:
            return 0.0, 0.0
        spared = sorted((a, b) for a, b, w in found if w is None)
        starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
        best: dict[int, float] = {}
        for a, b, w in found:  # a word counts once, by its heaviest entry
            if w is not None and not ((k := bisect_right(starts, a)) and reach[k - 1] >= b):
                best[a] = max(best.get(a, 0.0), w)
        if not best:
            return 0.0, 0.0
        return float(np.log1p(1000 * sum(best.values()) / (folded.count(b" ") + 20))), 1.0

    def score(self, x: tuple[float, float]) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-(a + b * x[0] + c * x[1]))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """Text and toxic (0/1) of at most ``rows`` labelled documents whose crc32(id as text) mod 5 is not 0; one row an id and label."""
    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").distinct()
    known = known.filter(~held_out("id")).orderBy(F.xxhash64("id"), "toxic").limit(rows)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    one = texts.join(F.broadcast(known), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))  # at most `rows` ids
    return one.select("text", "toxic")


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def _entries(word: bytes) -> list[bytes]:
    """A word as an entry, and its stems."""
    return [b" " + word + b" ", *(b" " + word[:n] for n in range(STEMS[0], min(STEMS[1], len(word)) + 1))] if len(word) >= STEMS[0] else []


def _candidates(train: DataFrame) -> dict[bytes, int]:
    """Entries of toxic documents that stand in ``SUPPORT`` different contexts or more."""
    seen = T.ArrayType(T.StructType([T.StructField("entry", T.BinaryType()), T.StructField("context", T.LongType())]))

    def start():
        def collect(texts):
            out = []
            for t in texts:
                words = fold(t).split()
                first = {}
                for before, word, after in zip([b"", *words], words, [*words[1:], b""]):
                    for e in _entries(word) if b" " + word + b" " not in first else ():
                        first.setdefault(e, zlib.crc32(before + b" " + after))
                out.append([{"entry": e, "context": c} for e, c in first.items()])
            return [out]
        return collect

    found = map_texts(train.filter("toxic = 1"), "text", [], [T.StructField("seen", seen)], start).select(F.explode("seen").alias("s"))
    held = found.groupBy("s.entry").agg(F.countDistinct("s.context").alias("n")).filter(F.col("n") >= SUPPORT)
    return {bytes(r.entry): r.n for r in held.collect()}  # words of the bounded sample


def _clean_counts(train: DataFrame, candidates: dict[bytes, int]) -> dict[bytes, int]:
    """Documents without the label that hold each candidate."""
    pair = T.ArrayType(T.StructType([T.StructField("entry", T.BinaryType()), T.StructField("n", T.LongType())]))
    wanted = frozenset(candidates)

    def start():
        def count(texts):
            n = Counter()
            for t in texts:
                n.update({e for w in set(fold(t).split()) for e in _entries(w) if e in wanted})
            return [[[{"entry": e, "n": k} for e, k in n.items()], *([] for _ in texts[1:])]]
        return count

    found = map_texts(train.filter("toxic = 0"), "text", [], [T.StructField("counts", pair)], start).select(F.explode("counts").alias("c"))
    return {bytes(r.entry): r.n for r in found.groupBy("c.entry").agg(F.sum("c.n").alias("n")).collect()}  # at most the candidates


def lexicon(contexts: dict[bytes, int], clean: dict[bytes, int], n_pos: int, n_neg: int) -> dict[bytes, float]:
    """Weights of the entries that tell toxic documents from others."""
    odds = {e: float(np.log((c + 0.5) / (n_pos + 1)) - np.log((clean.get(e, 0) + 1) / (n_neg + 1))) for e, c in contexts.items()}
    longer: dict[bytes, int] = {}  # contexts of the largest entry one step longer
    for e, c in contexts.items():
        shorter = e[:-1]
        if len(shorter) > STEMS[0]:
            longer[shorter] = max(longer.get(shorter, 0), c)
    good = [e for e in odds if odds[e] >= LEAST_ODDS and (e.endswith(b" ") or longer.get(e, 0) < SAME_WORD * contexts[e])]
    weights = {}
    for w in BASE:
        e = b" " + w.encode() + b" "
        weights[e] = max(0.0, odds[e]) if e in odds else PRIOR_WEIGHT
    return weights | {e: odds[e] for e in good}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> Model:
    """Lexicon and curve from the labelled documents; the base lexicon and a fixed curve where labels are lacking."""
    train = cut_lineage(training_rows(docs, labels, id_col, text_col, rows))  # read four times
    totals = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return Model({b" " + w.encode() + b" ": PRIOR_WEIGHT for w in BASE})
    contexts = _candidates(train)
    model = Model(lexicon(contexts, _clean_counts(train, contexts), n_pos, n_neg))
    model.curve = _curve(train, model)
    return model


def _curve(train: DataFrame, model: Model) -> tuple[float, float, float]:
    """Ridge logistic regression of the label on the two features, by Newton steps."""
    def start():
        auto = model.matcher()

        def compute(texts, toxic):
            return [[list(model.features(auto, fold(t))) for t in texts]]
        return compute

    rows = map_texts(train, "text", ["toxic"], [T.StructField("x", T.ArrayType(T.DoubleType()))], start, ["toxic"]).collect()  # at most FIT_ROWS pairs of numbers
    x = np.array([[1.0, *r.x] for r in rows])
    y = np.array([float(r.toxic) for r in rows])
    w, ridge = np.zeros(3), np.diag([0.01, 0.1, 0.1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(v, 9)) for v in w)


def scores(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text", result: str = "score") -> DataFrame:
    """The ``carry`` columns of every row and ``result``, the score from 0 to 1, of its whole text.

    Null, empty and wordless texts get the score of a text without a match;
    repeated rows get equal scores; other columns are ignored; no rows give none.
    """
    def start():
        auto = model.matcher()
        return lambda texts: [[model.score(model.features(auto, fold(t))) for t in texts]]

    return map_texts(docs, text_col, carry, [T.StructField(result, T.DoubleType())], start)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op7: held-out mark, score and decision of every document."""
    found = scores(docs, fit(docs, labels), ["doc_id"])
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that score below 0.5, all their columns kept; fitted on ``labelled`` (default: the documents)."""
    model = fit(labelled if labelled is not None else docs, labels)
    mark = unused("score", docs.columns)
    return scores(docs, model, docs.columns, result=mark).filter(F.col(mark) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
