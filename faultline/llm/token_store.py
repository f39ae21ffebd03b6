"""Token-ID store: binary shards of zstandard frames with a shared dictionary and an offset index.

A store is a folder. ``dictionary`` is a zstandard dictionary trained on the
serialized ids of a bounded sample of documents. Each ``shard-NNNNNN.bin``
holds documents in ascending id order and is laid out as

    magic, hash of the dictionary (16 bytes)
    one zstandard frame per document, compressed by itself
    index: one entry per document (id, frame offset, frame length, tokens; four signed 64-bit integers)
    number of entries, offset of the index (two signed 64-bit integers)

so one document is read with two short reads and one small decompression.
Shards are written under a name of their own and renamed when complete, so a
task that is run again leaves the same files.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.llm.common import map_texts
from faultline.llm.tokens import word_tokens
from faultline.session import scratch_path, ship_package

TOKENIZER, END_ID = "word_bpe_49k.json", 1
MAGIC = b"TOKSTOR1"
#: Documents that the dictionary is trained on (a bounded sample), words of each, and the dictionary's size in bytes.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DICTIONARY_BYTES = 2_000, 16 << 10, 64 << 10
LEVEL = 3
#: Texts (bytes) that a writing task handles at once.
WRITE_BYTES = 2 << 20


def _open(path: str):
    """File system and path of a folder or file in it, for any store that Arrow reads."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _uri(path: str) -> str:
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def train_dictionary(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> bytes:
    """Dictionary over the ids of ``SAMPLE_DOCUMENTS`` documents chosen by hash; empty if they are too few or too short."""
    def start():
        tokens, end = word_tokens(tokenizer, lower=True), np.array([end_id], "<u4").tobytes()
        return lambda texts: [[(b + end)[:SAMPLE_BYTES] for b in tokens.blobs(texts)]]

    # ids are chosen first, so that only the chosen texts are moved and tokenized
    few = docs.select("id").filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS)
    chosen = docs.join(F.broadcast(few), "id", "left_semi").repartition(16)
    ids = map_texts(chosen, "text", [], [T.StructField("ids", T.BinaryType())], start).limit(2 * SAMPLE_DOCUMENTS)
    samples = [bytes(r.ids) for r in ids.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _compressor(dictionary: bytes):
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def dictionary_hash(dictionary: bytes) -> bytes:
    return hashlib.sha256(dictionary).digest()[:16]


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
                end_id: int = END_ID) -> DataFrame:
    """Write the store and return its shards: shard, path, documents, tokens, start (tokens of all shards before).

    Documents are dealt into shards by ranges of id (null first; rows of one id
    by a hash of their text), and sorted inside. Null and empty texts are the
    end id alone; rows that repeat are each written; other columns are ignored;
    an empty table writes no shard.
    """
    spark = docs.sparkSession
    ship_package(spark)
    folder = _uri(folder)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    dictionary = train_dictionary(rows, tokenizer, end_id)
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    mark = dictionary_hash(dictionary)
    dealt = rows.withColumn("mix", F.xxhash64("text")).repartitionByRange(F.col("id").asc_nulls_first(), "mix")
    dealt = dealt.sortWithinPartitions(F.col("id").asc_nulls_first(), "mix").withColumn("shard", F.spark_partition_id())
    dealt = dealt.withColumn("id", F.coalesce("id", F.lit(NO_ID)))  # pandas would turn a column with nulls into floats

    def write(batches):
        tokens, end, pack = word_tokens(tokenizer, lower=True), np.array([end_id], "<u4").tobytes(), _compressor(dictionary)
        fs, root = _open(folder)
        out = None
        index, at, total, shard = [], 0, 0, None
        for batch in batches:
            ids, texts = batch["id"].tolist(), batch["text"].tolist()
            part, held = [], 0
            for k, (i, text) in enumerate(zip(ids, texts)):
                part.append((i, text))
                held += len(text) if text is not None else 0
                if held < WRITE_BYTES and k + 1 < len(ids):
                    continue
                if out is None:
                    shard = int(batch["shard"].iloc[0])
                    name = f"{root}/shard-{shard:06d}.bin"
                    draft = f"{root}/_draft-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(draft)
                    out.write(MAGIC + mark)
                    at = len(MAGIC) + len(mark)
                for (i, _), blob in zip(part, tokens.blobs([t for _, t in part])):
                    blob += end
                    frame = pack.compress(blob)
                    out.write(frame)
                    index.append((int(i), at, len(frame), len(blob) // 4))
                    at += len(frame)
                    total += len(blob) // 4
                part, held = [], 0
        if out is not None:
            out.write(np.array(index, "<i8").tobytes() + struct.pack("<qq", len(index), at))
            out.close()
            fs.move(draft, name)
            yield pd.DataFrame({"shard": [shard], "path": [f"shard-{shard:06d}.bin"], "documents": [len(index)], "tokens": [total]})

    done = dealt.mapInPandas(write, "shard long, path string, documents long, tokens long")
    done = spark.createDataFrame(done.collect(), done.schema)  # a row per shard
    before = F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")
    return done.withColumn("start", before)


#: Stands for a null id in the index (the smallest 64-bit integer).
NO_ID = -(1 << 63)


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, fs, path: str, dictionary: bytes):
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n, at = struct.unpack("<qq", self.file.read_at(16, size - 16))
        head = self.file.read_at(len(MAGIC) + 16, 0)
        if head[:len(MAGIC)] != MAGIC or head[len(MAGIC):] != dictionary_hash(dictionary):
            raise ValueError(f"{path} was not written with this dictionary")
        self.index = np.frombuffer(self.file.read_at(32 * n, at), "<i8").reshape(n, 4)
        self.unpack = _decompressor(dictionary)

    def ids(self, k: int) -> bytes:
        """Serialized ids of the shard's k-th document."""
        _, at, size, tokens = self.index[k]
        return self.unpack.decompress(self.file.read_at(int(size), int(at)), max_output_size=int(tokens) * 4)


def read_store(spark: SparkSession, folder: str, shards: DataFrame) -> DataFrame:
    """Every document of a store: doc_id, start, n_tokens, ids_crc32, in the order of the files."""
    ship_package(spark)
    folder = _uri(folder)

    def read(batches):
        fs, root = _open(folder)
        with fs.open_input_stream(f"{root}/dictionary") as f:
            dictionary = f.read()
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"].tolist()):
                shard = Shard(fs, f"{root}/{path}", dictionary)
                n = shard.index[:, 3]
                for a in range(0, len(n), 10_000):
                    part = slice(a, a + 10_000)
                    yield pd.DataFrame({
                        "doc_id": pd.array([None if x == NO_ID else x for x in shard.index[part, 0].tolist()], "Int64"),
                        "start": start + (np.cumsum(n) - n)[part], "n_tokens": n[part],
                        "ids_crc32": [zlib.crc32(shard.ids(k)) for k in range(*part.indices(len(n)))]})
                shard.file.close()

    count = max(1, shards.count())
    spread = shards.repartition(count, "shard")
    return spread.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame) -> DataFrame:
    """op4: write ``docs`` as a store in the shared folder and read every document back."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-store")
    return read_store(spark, folder, write_store(docs, folder))
