"""Packing: token pieces into fixed-length sequences, shortest pack first over the length histogram.

Documents become pieces of at most ``size`` tokens. The histogram of piece
lengths (at most ``size`` rows) is all the driver sees: lengths are placed from
the longest to the shortest, each into the pack pattern with the most room,
and only counts of patterns are kept. Every piece then finds its place by rank:
its number among the pieces of its length, which the patterns' slots of that
length divide into ranges.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.llm.common import map_texts
from faultline.llm.tokens import word_tokens
from faultline.session import cut_lineage, ship_package

TOKENIZER, END_ID, SIZE = "byte_bpe_50k.json", 0, 1024
#: Pieces that are ranked in one group, about.
RANK_GROUP = 200_000

PIECE = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER,
           end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of each document's ids: id, start, length, ids_crc32, doc_tokens and, if asked for, the ids."""
    piece = T.StructType(PIECE.fields + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    fields = [T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", T.ArrayType(piece))]

    def start():
        tokens, end = word_tokens(tokenizer, lower=False), np.array([end_id], "<u4").tobytes()

        def compute(texts):
            total, cut = [], []
            for blob in tokens.blobs(texts):
                blob += end
                parts = [(a // 4, blob[a:a + 4 * size]) for a in range(0, len(blob), 4 * size)]
                total.append(len(blob) // 4)
                cut.append([{"start": a, "length": len(p) // 4, "ids_crc32": zlib.crc32(p)} | ({"ids": p} if with_ids else {}) for a, p in parts])
            return [total, cut]
        return compute

    found = map_texts(docs, text_col, [id_col], fields, start)
    return found.select(id_col, "doc_tokens", F.explode("pieces").alias("p")).select(id_col, "p.*", "doc_tokens")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(count, lengths) of each pack pattern, for ``histogram`` of piece lengths.

    Pieces of one length are placed together, one into each of the open packs
    with the most room; a pattern whose packs are not all needed is split by
    count. When no open pack has room, new ones are opened.
    """
    open_packs: dict[int, list[tuple[int, list[int]]]] = {}  # by tokens used
    closed: list[tuple[int, list[int]]] = []

    def put(count: int, lengths: list[int]) -> None:
        used = sum(lengths)
        if used == size:
            closed.append((count, lengths))
        else:
            open_packs.setdefault(used, []).append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and open_packs and (used := min(open_packs)) + length <= size:
            packs = open_packs.pop(used)  # the shortest: one more piece for each
            while packs and left:
                count, lengths = packs.pop()
                some = min(count, left)
                put(some, [*lengths, length])
                left -= some
                if count > some:
                    packs.append((count - some, lengths))
            if packs:
                open_packs[used] = packs
        each = size // length  # what is left opens packs, and fills each as the shortest until it has no room
        if left // each:
            put(left // each, [length] * each)
        if left % each:
            put(1, [length] * (left % each))
    return closed + [p for used in sorted(open_packs) for p in open_packs[used]]


def slots(patterns: list[tuple[int, list[int]]]) -> np.ndarray:
    """One row per slot of a pattern: length, first rank, first sequence, sequences, offset; sorted by length and rank."""
    out, taken, first = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for n in lengths:
            out.append((n, taken.get(n, 0), first, count, offset))
            taken[n] = taken.get(n, 0) + count
            offset += n
        first += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(found: DataFrame, by: str, order: list[str], rows: int, name: str) -> DataFrame:
    """Add each row's number (from 0) among those with the same ``by``, without gathering them in one task."""
    groups = max(1, -(-rows // RANK_GROUP))
    found = found.withColumn("__group", F.pmod(F.xxhash64(*order), F.lit(groups)))
    counts = found.groupBy(by, "__group").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__group")) - F.col("__n")
    counts = counts.select(by, "__group", before.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__group").orderBy(*order))
    found = found.withColumn("__row", inside).join(counts, [by, "__group"])
    return found.withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__group", "__before", "__row")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str = TOKENIZER,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for).

    A null or empty text is the end id alone; repeated rows and null ids are
    packed like any other row; pieces of equal length are ranked by id, start
    and checksum, so equal rows may trade places; other columns are ignored;
    no rows give no rows.
    """
    ship_package(docs.sparkSession)
    found = cut_lineage(pieces(docs, id_col, text_col, size, tokenizer, end_id, with_ids))
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most `size` rows
    table = slots(shortest_pack_first(histogram, size))
    keyed = ranked(found, "length", [id_col, "start", "ids_crc32"], sum(histogram.values()), "__rank")
    span = int(table[:, 1].max(initial=0)) + int(table[:, 3].max(initial=0)) + 1
    keys = table[:, 0] * span + table[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * span + rank.to_numpy(), "right") - 1
        row = table[at]
        return pd.DataFrame({"sequence_id": row[:, 2] + rank.to_numpy() - row[:, 1], "offset": row[:, 4]})

    placed = keyed.withColumn("__at", place("length", "__rank"))
    cols = [id_col, "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    return placed.select(*cols, "__at.sequence_id", "__at.offset")


def report(docs: DataFrame) -> DataFrame:
    """op2's pieces of each document and their places."""
    return pack(docs)
