"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents are dealt into chunks by a hash of the row. Each chunk computes the
rolling hash of all its windows and sends the distinct ones — one bit says
whether the chunk itself has it twice — to the bucket that a second,
independent rolling hash names. A bucket counts each hash over all chunks and
answers every chunk with one bit per hash it sent, in the same (ascending)
order. The chunk then marks the words under repeated windows. So the shuffle
holds 8 bytes for each distinct window of a chunk, and a window that a third
of all documents share reaches a bucket once per chunk, not once per document.

The bucket number adds its bits to the 64 of the hash that is compared: as the
number of buckets grows with the data, so does the width of what must agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import ship_package

#: Bytes of text in a chunk, and window hashes in a bucket (8 bytes each), both on average.
CHUNK_BYTES, BUCKET_WINDOWS = 16 << 20, 2 << 20
#: Words hashed together; distinct words whose hash a task remembers.
STRETCH_WORDS, KNOWN_WORDS = 400_000, 500_000

#: Odd multipliers of the two rolling hashes (modulo 2**64).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MASK = (1 << 64) - 1


class WordHashes(dict):
    """64-bit hash of each word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # double the known powers each time
        step = np.uint64(pow(base, done, 1 << 64))
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
    return out


class Rolling:
    """Rabin-Karp: the hash of words i..i+k-1 is sum(w[i+j] * base**(k-1-j)) modulo 2**64."""

    def __init__(self, base: int, window: int, longest: int):
        inverse = pow(base, -1, 1 << 64)
        self.down = _powers(inverse, longest + 1)
        self.up = _powers(base, longest + 1) * np.uint64(pow(base, window - 1, 1 << 64))
        self.window = window

    def __call__(self, w: np.ndarray) -> np.ndarray:
        # sums of w[i] / base**i, whose differences over a window only need scaling
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * self.down[:len(w)], out=sums[1:])
        n = len(w) - self.window + 1
        h = (sums[self.window:] - sums[:n]) * self.up[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def window_hashes(texts: list, window: int):
    """For each stretch of texts: (first text, word lists, start of each text, window starts, hash, second hash).

    A stretch holds whole texts; ``window starts`` are positions in its joined words.
    """
    known = WordHashes()
    rolling: list[Rolling] = []

    def made(lists, first):
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        if total < window:
            none = np.zeros(0, np.uint64)
            return first, lists, starts, np.zeros(0, np.int64), none, none
        if not rolling or len(rolling[0].down) < total:
            rolling[:] = [Rolling(b, window, max(total, STRETCH_WORDS)) for b in BASES]
        w = np.fromiter((h for words in lists for h in map(known.__getitem__, words)), np.uint64, total)
        inside = np.repeat(starts + sizes, sizes)[:total - window + 1] - np.arange(total - window + 1) >= window
        at = np.flatnonzero(inside)
        return first, lists, starts, at, rolling[0](w)[at], rolling[1](w)[at]

    lists, held, first = [], 0, 0
    for i, t in enumerate(texts):
        words = bytes(t).split() if t is not None else []
        if lists and held + len(words) > STRETCH_WORDS:
            yield made(lists, first)
            lists, held, first = [], 0, i
        lists.append(words)
        held += len(words)
    if lists:
        yield made(lists, first)


def _distinct(texts: list, window: int, buckets: int):
    """The chunk's distinct (bucket, hash) in ascending order; which occur twice; and for each window its place there."""
    h1, h2 = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, _, _, _, a, b in window_hashes(texts, window):
        h1.append(a)
        h2.append(b)
    h = np.concatenate(h1)
    bucket = (np.concatenate(h2) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((h, bucket))
    h, bucket = h[order], bucket[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
    place = np.cumsum(new) - 1
    twice = np.bincount(place, minlength=int(new.sum())) > 1 if len(h) else np.zeros(0, bool)
    back = np.empty(len(h), np.int64)
    back[order] = place
    return bucket[new], h[new], twice, back


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35,
                     with_text: bool = True) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    Words are runs of anything but ASCII white space, unchanged. A word goes if
    a window that covers it starts anywhere else too: in another document or
    elsewhere in its own. Windows are judged on the input. Null, empty and
    short texts have no window and lose nothing (kept_sha256 of no words is
    that of the empty string; kept_text is then empty); rows that repeat count
    as copies of each other, so their windows go from all of them; null ids
    are kept as they are; other columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = -(-size // CHUNK_BYTES) + 1
    buckets = -(-size // (6 * BUCKET_WINDOWS)) + 1  # about 6 bytes a word, as many windows as words
    # every copy of a row is its own row of some chunk; the chunk is a function of the row alone
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)))
    kind = rows.schema["id"].dataType.simpleString()
    carried = "string" if kind in ("tinyint", "smallint", "int", "bigint") else kind  # pandas would turn integers with nulls into floats
    dealt = dealt.withColumn("id", F.col("id").cast(carried))

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, h, twice, _ = _distinct(pdf["text"].tolist(), window, buckets)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
        if not len(h):
            lo = hi = np.zeros(0, np.int64)
        return pd.DataFrame({
            "bucket": bucket[lo] if len(lo) else np.zeros(0, np.int64), "chunk": np.full(len(lo), pdf["chunk"].iloc[0], np.int64),
            "hashes": [h[a:b].tobytes() for a, b in zip(lo, hi)], "twice": [np.packbits(twice[a:b]).tobytes() for a, b in zip(lo, hi)]})

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        sent = [np.frombuffer(x, np.uint64) for x in pdf["hashes"]]
        multi = [h[np.unpackbits(np.frombuffer(t, np.uint8), count=len(h)).astype(bool)] for h, t in zip(sent, pdf["twice"])]
        every = np.sort(np.concatenate(sent))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *multi]))

        def bits(h):
            if not len(again):
                return b""
            at = np.minimum(np.searchsorted(again, h), len(again) - 1)
            return np.packbits(again[at] == h).tobytes()
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "n": [len(h) for h in sent], "bits": [bits(h) for h in sent]})

    out = f"id {carried}, n_words long, n_removed long, kept_sha256 string"
    out += ", kept_text string" if with_text else ""

    def remove(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        texts = mine["text"].tolist()
        _, h, _, back = _distinct(texts, window, buckets)
        answers = answers.sort_values("bucket")
        flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) if x else np.zeros(n, bool) for x, n in zip(answers["bits"], answers["n"])]
        repeated = np.concatenate([np.zeros(0, bool), *flags])
        if len(repeated) != len(h):
            raise RuntimeError("the answers for this chunk do not match its windows")
        repeated = repeated[back]
        n_words, n_removed, digest, kept = [], [], [], []
        done = 0
        for _, lists, starts, at, _, _ in window_hashes(texts, window):
            hit = at[repeated[done:done + len(at)]]
            done += len(at)
            total = sum(map(len, lists))
            cover = np.zeros(total + 1, np.int64)
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            for s, words in zip(starts.tolist(), lists):
                g = gone[s:s + len(words)]
                lost = int(g.sum())
                left = b" ".join(words if not lost else [w for w, x in zip(words, g.tolist()) if not x])
                n_words.append(len(words))
                n_removed.append(lost)
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept.append(left.decode())
        got = {"id": mine["id"].values, "n_words": n_words, "n_removed": n_removed, "kept_sha256": digest}
        return pd.DataFrame(got | ({"kept_text": kept} if with_text else {}))

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "chunk")
    sent = dealt.groupBy("chunk").applyInPandas(send, "bucket long, chunk long, hashes binary, twice binary")
    answers = sent.groupBy("bucket").applyInPandas(count, "chunk long, bucket long, n long, bits binary")
    done = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(remove, out)
    return done.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def report(docs: DataFrame) -> DataFrame:
    """op10's digest of each document."""
    return dedup_substrings(docs, with_text=False)
