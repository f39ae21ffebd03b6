"""SimHash near-duplicates, linked through Gray-order hierarchical indexes.

A fingerprint takes the majority of each bit over the XXH64 of all word
shingles. Links join fingerprints that differ in at most ``max_bits`` bits.

The 64 bits are cut into ``max_bits + 4`` blocks. Two linked fingerprints
agree in all but ``max_bits`` blocks, so for each choice of four blocks the
fingerprints are reordered with those blocks on top and sorted by Gray rank:
members of a top group share those bits (accumulated difference zero) and stand
next to each other. Inside a group the Gray order is cut into leaves and upper
nodes, each with the mask and pattern of the bits that all its members share;
a pair of nodes whose patterns already differ in more than ``max_bits`` shared
bits is dropped with everything below it. Four blocks hold 40 bits or more at
``max_bits`` 2, so a group has at most 2**22 distinct fingerprints (32 MB).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_texts, unused
from faultline.llm.components import star_components
from faultline.session import cut_lineage, ship_package

#: Fingerprints in a leaf of the index, and children of an upper node.
LEAF, FAN = 16, 8
#: Pairs of nodes or fingerprints compared at once.
PAIRS = 1 << 20
SEED = 42

#: Each bit of a byte as one lane of a 64-bit counter of eight lanes.
LANES = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(text: bytes | None, words: int) -> list[int]:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    w = bytes(text).lower().split() if text else []
    if not w:
        return []
    line = b" ".join(w)
    if len(w) <= words:
        return [xxhash.xxh64_intdigest(line, SEED)]
    size = np.fromiter(map(len, w), np.int64, len(w))
    start = np.cumsum(size + 1) - (size + 1)
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(start[:len(w) - words + 1].tolist(), (start + size)[words - 1:].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each document from its hashes, stored one document after another; zero for none."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    first = np.cumsum(n) - n
    parts = -(-n // 255)  # a lane counts to 255
    part_first = np.cumsum(parts) - parts
    at = np.repeat(first - part_first * 255, parts) + np.arange(parts.sum()) * 255
    lanes = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], at, axis=0)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(at), 64).astype(np.int64), part_first, axis=0)
    bits = counts * 2 > n[:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", words: int = 3) -> DataFrame:
    """The ``carry`` columns and ``fp``, the 64-bit fingerprint as a signed long."""
    def start():
        def compute(texts):
            out, hashes, sizes = [], [], []
            for t in texts:
                h = shingle_hashes(t, words)
                hashes.append(np.array(h, np.uint64))
                sizes.append(len(h))
            out = majority(np.concatenate([np.zeros(0, np.uint64), *hashes]), np.array(sizes, np.int64))
            return [out.view(np.int64)]
        return compute
    return map_texts(docs, text_col, carry, [T.StructField("fp", T.LongType())], start)


def _block_bits(blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of each block, from the top bits down."""
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(64 - sum(widths[:k + 1]), widths[k]) for k in range(blocks)]


def _reordered(fp: Column, top: tuple[int, ...], bits: list[tuple[int, int]]) -> tuple[Column, Column]:
    """The bits of the ``top`` blocks, and all bits with these on top."""
    def joined(ks):
        out = F.lit(0).cast("long")
        for k in ks:
            shift, width = bits[k]
            out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        return out
    rest = [k for k in range(len(bits)) if k not in top]
    return joined(top), joined([*top, *rest])


def gray_ranked(df: DataFrame, code: str, rank: str) -> DataFrame:
    """Add the position of a code word in the Gray sequence, one projection a step."""
    df = df.withColumn(rank, F.col(code))
    for step in (1, 2, 4, 8, 16, 32):
        df = df.withColumn(rank, F.col(rank).bitwiseXOR(F.shiftrightunsigned(rank, step)))
    return df


class Labels:
    """Groups of positions that are known to be linked."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def merge(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            low = np.minimum(x, y)
            np.minimum.at(self.of, x, low)
            np.minimum.at(self.of, y, low)
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


class GrayIndex:
    """Index over the fingerprints of one group, given in Gray order."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        self.levels = []
        ones = zeros = fps  # AND and OR of what is below
        step = LEAF
        while True:
            at = np.arange(0, len(ones), step)
            ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(zeros, at)
            self.levels.append((~(ones ^ zeros), ones))  # shared bits, their values
            if len(at) == 1:
                break
            step = FAN

    def _below(self, a: np.ndarray, b: np.ndarray, step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """All ordered pairs of children of the node pairs (a, b), a <= b."""
        k = np.arange(step)
        x = (a[:, None, None] * step + k[None, :, None] + 0 * k[None, None, :]).ravel()
        y = (b[:, None, None] * step + k[None, None, :] + 0 * k[None, :, None]).ravel()
        keep = (x < n) & (y < n) & (x <= y)
        return x[keep], y[keep]

    def link(self, max_bits: int) -> np.ndarray:
        """For each fingerprint, the position of a member of its linked group, the same for all of the group."""
        labels = Labels(len(self.fps))
        one = np.arange(len(self.fps) - 1)
        near = np.bitwise_count(self.fps[:-1] ^ self.fps[1:]) <= max_bits
        labels.merge(one[near], one[near] + 1)  # Gray neighbours first: what they join need not be compared again
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            room = max(1, PAIRS // (LEAF * LEAF))
            if len(a) > room:
                todo += [(level, a[i:i + room], b[i:i + room]) for i in range(0, len(a), room)]
                continue
            if level == 0:
                x, y = self._below(a, b, LEAF, len(self.fps))
                keep = labels.of[x] != labels.of[y]
                x, y = x[keep], y[keep]
                keep = np.bitwise_count(self.fps[x] ^ self.fps[y]) <= max_bits
                labels.merge(x[keep], y[keep])
                continue
            mask, value = self.levels[level - 1]
            x, y = self._below(a, b, FAN, len(mask))
            keep = np.bitwise_count((value[x] ^ value[y]) & mask[x] & mask[y]) <= max_bits
            x, y = x[keep], y[keep]
            span = LEAF * FAN ** (level - 1)
            lo, hi = self._label_range(labels, x, y, span)
            if (lo < hi).any():
                todo.append((level - 1, x[lo < hi], y[lo < hi]))
        return labels.of

    def _label_range(self, labels: Labels, x, y, span):
        """Smallest and largest label below each pair of nodes: equal if all is linked already."""
        at = np.arange(0, len(self.fps), span)
        lo, hi = np.minimum.reduceat(labels.of, at), np.maximum.reduceat(labels.of, at)
        return np.minimum(lo[x], lo[y]), np.maximum(hi[x], hi[y])


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (u, v) that connect all ``fp`` within ``max_bits`` bits; input distinct fingerprints."""
    ship_package(fps.sparkSession)
    blocks = _block_bits(max_bits + 4)
    options = []
    for k, top in enumerate(combinations(range(len(blocks)), 4)):
        key, code = _reordered(F.col("fp"), top, blocks)
        options.append(F.struct(F.lit(k).alias("tree"), key.alias("top"), code.alias("code")))
    placed = fps.select("fp", F.explode(F.array(*options)).alias("at")).select("at.tree", "at.top", "at.code", "fp")
    placed = gray_ranked(placed, "code", "rank").drop("code")
    low_bits = F.col("rank").bitwiseAND(F.lit((1 << 63) - 1))
    placed = placed.repartition("tree", "top").sortWithinPartitions("tree", "top", (F.col("rank") < 0), low_bits)

    def search(batches):
        tail = None
        for pdf in batches:
            pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            if not len(pdf):
                continue
            tree, top = pdf["tree"].to_numpy(), pdf["top"].to_numpy()
            open_from = len(pdf) - 1  # the last group may go on in the next batch
            same = (tree == tree[-1]) & (top == top[-1])
            open_from = int(np.argmax(same))
            tail = pdf.iloc[open_from:]
            yield from linked(tree[:open_from], top[:open_from], pdf["fp"].to_numpy()[:open_from])
        if tail is not None and len(tail):
            yield from linked(tail["tree"].to_numpy(), tail["top"].to_numpy(), tail["fp"].to_numpy())

    def linked(tree, top, fp):
        if len(fp) < 2:
            return
        fp = fp.view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (tree[1:] != tree[:-1]) | (top[1:] != top[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(fp)))
        small = size[group] <= LEAF
        found = []
        for d in range(1, min(LEAF, int(size.max()))):  # groups of one leaf: all together
            i = np.flatnonzero((group[:-d] == group[d:]) & small[:-d])
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= max_bits]
            found.append((fp[i], fp[i + d]))
        for g in np.flatnonzero(size > LEAF):
            part = fp[first[g]:first[g] + size[g]]
            to = GrayIndex(part).link(max_bits)
            i = np.flatnonzero(to != np.arange(len(part)))
            found.append((part[i], part[to[i]]))
        if found:
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            yield pd.DataFrame({"u": u, "v": v})

    return placed.mapInPandas(search, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: its id, text_hash, fp, root (fingerprint naming its group) and component_id.

    Null, empty and wordless texts have fingerprint zero and link like any
    other; ``component_id`` is the smallest id reachable, null only if no
    reachable row has an id; repeated rows each keep their row; columns other
    than id and text are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    marked = cut_lineage(fingerprints(rows, ["id", "text_hash"], "text", words))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = star_components(links(nodes.select("fp"), max_bits))
    nodes = nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = nodes.select("fp", "root").join(lowest, "root")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "text_hash", "fp", "root", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """op5's fingerprint and component of each document."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The documents with one row of each near-duplicate group: smallest id (null last), then text hash; all columns kept."""
    found = near_duplicates(docs, id_col, text_col, words, max_bits)
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "text_hash")
    best = found.groupBy("root").agg(F.min(order).alias("b")).select("b.id", "b.text_hash")
    mark = unused("__hash", docs.columns)
    mine = docs.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`")))
    best = best.withColumnsRenamed({"id": "best_id", "text_hash": "best_hash"})
    kept = mine.join(best, mine[id_col].eqNullSafe(best.best_id) & (mine[mark] == best.best_hash), "left_semi")
    return kept.dropDuplicates([id_col, mark]).select(*[F.col(f"`{c}`") for c in docs.columns])
