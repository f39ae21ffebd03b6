"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark
item (an item of fewer words is one window). For patterns of ``m`` words the
search looks at the last ``BLOCK`` words of a possible position: the shift
table says how far the search may move on without missing a pattern, and a
shift of zero selects the bucket of patterns with that suffix, whose words are
then compared one by one. Positions inside clean text are mostly skipped.

The benchmark is cut into blocks of bounded size; each is broadcast and every
document is searched against each block in turn, inside its own partition. With
several blocks the hits so far are written to the shared folder after each, so a
task holds the tables of one block whatever the benchmark's size, and a lost
executor costs one block's pass at most. Documents are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.common import map_texts, unused
from faultline.session import scratch_path

#: Words of a shift block.
BLOCK = 3
#: Words of a benchmark item in one broadcast segment; words in one broadcast block.
SEGMENT_WORDS, BLOCK_WORDS = 50_000, 400_000

#: Word characters are letters and digits of ASCII and everything beyond it; A-Z becomes a-z, all else a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> tuple[bytes, ...]:
    return tuple(text.translate(WORDS).split()) if text else ()


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Join overlapping or touching (start, length) spans."""
    out: list[tuple[int, int]] = []
    for s, n in sorted(spans):
        if out and s <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s + n - out[-1][0]))
        else:
            out.append((s, n))
    return out


class WuManber:
    """Patterns of one length (in words), each with the items that contain it."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], set]):
        self.m, self.block = m, min(BLOCK, m)
        self.far = m - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[bytes, list]] = {}
        for words, items in patterns.items():
            for end in range(self.block, m + 1):
                key = words[end - self.block:end]
                self.shift[key] = min(self.shift.get(key, self.far), m - end)
            self.bucket.setdefault(words[m - self.block:], {}).setdefault(words[0], []).append((words, items))

    def search(self, words: tuple[bytes, ...], spans: list, items: set) -> None:
        shift, far, block, m = self.shift.get, self.far, self.block, self.m
        end, n = m, len(words)
        while end <= n:
            key = words[end - block:end]
            step = shift(key, far)
            if step:
                end += step
                continue
            first = end - m
            for pattern, owners in self.bucket[key].get(words[first], ()):
                if words[first:end] == pattern:
                    spans.append((first, m))
                    items |= owners
            end += 1


def searchers(segments: list[tuple[str | None, bytes]], window: int) -> list[WuManber]:
    """One searcher for each pattern length found in the segments of one block."""
    by_length: dict[int, dict] = {}
    for item, text in segments:
        words = tuple(text.split(b" "))
        m = min(window, len(words))
        found = by_length.setdefault(m, {})
        for i in range(len(words) - m + 1):
            found.setdefault(words[i:i + m], set()).add(item)
    return [WuManber(m, found) for m, found in sorted(by_length.items())]


def benchmark_blocks(benchmark: DataFrame, window: int, id_col: str, text_col: str) -> list:
    """Broadcast blocks of benchmark segments; long items overlap by ``window - 1`` words between segments."""
    def start():
        def cut(texts):
            out = []
            for t in texts:
                w = words_of(t)
                step = SEGMENT_WORDS - window + 1
                at = range(0, max(1, len(w) - window + 1), step) if w else ()
                out.append([{"words": b" ".join(w[i:i + SEGMENT_WORDS]), "n": len(w[i:i + SEGMENT_WORDS])} for i in at])
            return [out]
        return cut

    segment = T.StructType([T.StructField("words", T.BinaryType()), T.StructField("n", T.LongType())])
    cut = map_texts(benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text", ["item"],
                    [T.StructField("segments", T.ArrayType(segment))], start)
    cut = cut.select("item", F.posexplode("segments").alias("at", "s")).select("item", "at", "s.words", "s.n")
    total = cut.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    sc = benchmark.sparkSession.sparkContext
    at = F.pmod(F.xxhash64("item", "at"), F.lit(max(1, blocks)))
    return [sc.broadcast([(r.item, bytes(r.words)) for r in cut.filter(at == k).select("item", "words").collect()]) for k in range(blocks)]


def contamination(docs: DataFrame, benchmark: DataFrame, carry: list[str], text_col: str = "text", window: int = 10,
                  item_id: str = "item_id", item_text: str = "text", result: str = "contamination") -> DataFrame:
    """The ``carry`` columns of every document and ``result``, a struct of n_words, hits, items.

    ``hits`` are the merged (start, length) word spans inside occurrences of a
    window; ``items`` the ids, as sorted strings, of items with an occurring
    window. Null, empty and wordless texts have no words and no hits; an item
    without words matches nothing; a null item id marks hits but is not listed;
    rows or items that repeat are each searched; an empty benchmark gives no
    hits. Other columns of either table are ignored.
    """
    blocks = benchmark_blocks(benchmark, window, item_id, item_text)

    def scan(shared):
        def start():
            found = searchers(shared.value, window) if shared else []

            def search(texts, earlier=None):
                out = []
                for k, text in enumerate(texts):
                    words = words_of(text)
                    spans, items = [], set()
                    for s in found:
                        s.search(words, spans, items)
                    if earlier:
                        spans += [(h["start"], h["length"]) for h in earlier[k]["hits"]]
                        items |= set(earlier[k]["items"])
                    out.append({"n_words": len(words), "hits": [{"start": a, "length": n} for a, n in merge_spans(spans)], "items": sorted(items - {None})})
                return [out]
            return search
        return start

    field = [T.StructField(result, RESULT)]
    if len(blocks) <= 1:
        return map_texts(docs, text_col, carry, field, scan(blocks[0] if blocks else None))
    hidden = unused("__searched", [*carry, result])
    cur = docs.select(*carry, F.col(text_col).alias(hidden))
    for k, shared in enumerate(blocks):
        keep = [*carry, hidden] if k + 1 < len(blocks) else carry
        cur = map_texts(cur, hidden, keep, field, scan(shared), [result] if k else [])
        if k + 1 < len(blocks):
            path = scratch_path(docs.sparkSession, "searched")
            cur.write.parquet(path)
            cur = docs.sparkSession.read.schema(cur.schema).parquet(path)
            shared.unpersist()
    return cur


def n_hit(result: str = "contamination") -> Column:
    """Words of a document inside any hit."""
    return F.aggregate(f"{result}.hits", F.lit(0).cast("long"), lambda a, h: a + h["length"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """The documents without a hit, all their columns kept."""
    mark = unused("contamination", docs.columns)
    found = contamination(docs, benchmark, docs.columns, text_col, window, result=mark)
    return found.filter(F.size(f"{mark}.hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op8's digest of each document."""
    found = contamination(docs, benchmark, ["doc_id"])
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), n_hit().alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        (F.size("contamination.hits") > 0).alias("contaminated"))
