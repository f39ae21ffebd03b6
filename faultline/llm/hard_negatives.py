"""Hard-negative mining by angular triangle filtering.

Vectors become integers, floor(scale * x). For every row the angles to a few
reference directions are stored. By the triangle inequality for angles, the
cosine of an anchor and a row lies between cos(a + b) and cos(a - b) for their
angles a and b to any reference; times both norms, widened against rounding,
that bounds the integer score. Only pairs whose bounds overlap the window of
scores still wanted get the integer inner product: at least the fifth best so
far when positives are searched, the positive's share when negatives are.

Rows are ordered by nearest reference and angle and cut into row blocks of
bounded size. Every block meets the anchors as a stream inside one task, so a
task holds one row block and one chunk of anchors; a stated query set against
all rows, in blocks. The best of each block are merged in a window per anchor.
A block is cut into runs of neighbouring angles, whose ranges rule out whole
runs before single rows are bounded.

The directions are fitted on a bounded sample (``SAMPLE_ROWS`` rows by hash,
farthest first). Bounds hold for any directions: results are exact, only the
number of scored pairs depends on them.

Defined results: rows with a null label, a null vector or a null or non-finite
component take no part. Ties go to the smaller id, a null id last; equal rows
stay rows of their own (an equal other row can be a positive). Shorter vectors
count as filled up with zeros, an empty one is all zero. A row with a null id is no
anchor. Scores are exact integers, compared and returned within the range of a
long (larger ones count as its ends). Empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.session import scratch_path, ship_package

#: Rows that the reference directions are fitted on, and how many directions.
SAMPLE_ROWS, DIRECTIONS = 2048, 8
#: Rows of a block at least and at most, of a run of neighbouring angles, and anchors taken from the stream at once.
BLOCK_LEAST, BLOCK_MOST, RUN, CHUNK = 2048, 65536, 1024, 1024
#: Widening of a bound, relative to the product of both norms: far above the rounding of stored angles and of cosines.
SLACK = 1e-6
LEAST, MOST = -(1 << 63), (1 << 63) - 1

_ROW = T.StructType([T.StructField(n, t) for n, t in (
    ("row", T.LongType()), ("id", T.LongType()), ("label", T.LongType()), ("anchor", T.BooleanType()), ("vector", T.BinaryType()),
    ("norm", T.DoubleType()), ("angles", T.BinaryType()), ("cell", T.IntegerType()), ("angle", T.DoubleType()))])
_POSITIVES = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("score", T.LongType())]))
_MET = T.StructType([T.StructField(n, T.LongType()) for n in ("anchor_row", "anchor_id", "place", "score", "row", "id")])


# --- vectors as integers -------------------------------------------------------------------------

def to_integers(x: np.ndarray, scale: int) -> np.ndarray | list[int]:
    """floor(scale * x), exact: as int64, or as Python integers when one is beyond 2^52."""
    x = np.asarray(x, np.float64)
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if (np.abs(y) < 2.0 ** 52).all():
        return y.astype(np.int64)
    return [floor(Fraction(float(v)) * scale) for v in x]


def _packed(v) -> bytes:
    """Two bytes a component where they suffice, else eight, else text; the first byte says which."""
    if isinstance(v, list):
        return b"t" + ",".join(map(str, v)).encode()
    return b"s" + v.astype("<i2").tobytes() if (np.abs(v) < 1 << 15).all() else b"l" + v.astype("<i8").tobytes()


def _unpacked(b: bytes):
    if b[:1] == b"t":
        return [int(x) for x in b[1:].split(b",")]
    return np.frombuffer(b, "<i2" if b[:1] == b"s" else "<i8", offset=1)


def _floats(v) -> np.ndarray:
    """For norms and angles; beyond 1e150 divided, so that squares stay finite."""
    return np.array([float(min(max(x, -(10 ** 150)), 10 ** 150)) for x in v]) if isinstance(v, list) else v.astype(np.float64)


def _matrix(vectors: list, width: int) -> tuple[np.ndarray, bool]:
    """Rows of equal width; object integers if any row needs them."""
    big = any(isinstance(v, list) for v in vectors)
    m = np.zeros((len(vectors), width), object if big else np.int64)
    for i, v in enumerate(vectors):
        m[i, :len(v)] = v
    return m, big


def directions(sample: list[np.ndarray], count: int) -> np.ndarray:
    """Unit vectors, farthest first from the sample's first row: next the row whose largest cosine to those taken is smallest."""
    width = max((len(v) for v in sample), default=0)
    m = np.zeros((len(sample), width))
    for i, v in enumerate(sample):
        m[i, :len(v)] = v
    size = np.linalg.norm(m, axis=1)
    m = m[size > 0] / size[size > 0, None]
    taken, nearest = [], np.full(len(m), -2.0)
    while len(taken) < min(count, len(m)):
        k = int(np.argmin(nearest)) if taken else 0
        taken.append(m[k])
        nearest = np.maximum(nearest, m @ m[k])
    return np.array(taken).reshape(-1, width) if taken else np.eye(1, max(width, 1))


# --- one block of rows against anchors -------------------------------------------------------------

class _Rows:
    """Rows or anchors of one batch of the stream, as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        col = {n: batch.column(n) for n in batch.schema.names}
        self.row = col["row"].to_numpy().astype(np.int64) if isinstance(batch, pa.Table) else col["row"].to_numpy(zero_copy_only=False).astype(np.int64)
        ids, labels = col["id"].to_pylist(), col["label"].to_pylist()
        self.no_id = np.array([i is None for i in ids], bool)
        self.id = np.array([0 if i is None else i for i in ids], np.int64)
        self.label = np.array(labels, np.int64)
        self.vectors = [_unpacked(b) for b in col["vector"].to_pylist()]
        self.norm = np.array(col["norm"].to_pylist(), np.float64)
        self.angles = np.array([np.frombuffer(b, "<f8") for b in col["angles"].to_pylist()]).reshape(len(ids), -1)
        self.width = max((len(v) for v in self.vectors), default=0)
        self.positives = col["positives"].to_pylist()


def _wider(low: np.ndarray, high: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of cosines as bounds of integer scores, safe against rounding."""
    return np.floor((low - SLACK) * norms) - 1, np.ceil((high + SLACK) * norms) + 1


def _scores(a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
    """Exact integer inner products: single or double precision as long as every partial sum is exact there."""
    if a.dtype == object or b.dtype == object or most >= 2.0 ** 52:
        exact = a.astype(object) @ b.astype(object).T
        return np.clip(exact, LEAST, MOST).astype(np.int64)
    kind = np.float32 if most < 2.0 ** 23 else np.float64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


class _Best:
    """The best ``keep`` rows of every anchor so far: higher scores, then smaller ids, null ids last."""

    def __init__(self, n: int, keep: int):
        self.score, self.keep = np.full((n, keep), LEAST, np.int64), keep
        self.none, self.no_id, self.id, self.row = np.ones((n, keep), bool), np.zeros((n, keep), bool), np.zeros((n, keep), np.int64), np.full((n, keep), -1, np.int64)

    def wanted(self) -> np.ndarray:
        """The least score that may still enter."""
        return np.where(self.none[:, -1], LEAST, self.score[:, -1])

    def take(self, at: np.ndarray, score: np.ndarray, ok: np.ndarray, rows: _Rows, of: np.ndarray) -> None:
        """Offer, to anchors ``at``, the rows ``of`` (in order of id) with their scores where ``ok``."""
        some = ok.any(axis=1)
        if not some.any():
            return
        at, score, ok = at[some], score[some], ok[some]
        first = np.lexsort((-score, ~ok), axis=-1)[:, :self.keep]
        pick = lambda x: np.take_along_axis(x, first, axis=1)
        there = of[first]
        score, none = np.concatenate([self.score[at], pick(score)], 1), np.concatenate([self.none[at], ~pick(ok)], 1)
        no_id, ids, row = (np.concatenate([mine[at], new[there]], 1) for mine, new in ((self.no_id, rows.no_id), (self.id, rows.id), (self.row, rows.row)))
        order = np.lexsort((row, ids, no_id, -score, none), axis=-1)[:, :self.keep]
        for name, x in (("score", score), ("none", none), ("no_id", no_id), ("id", ids), ("row", row)):
            getattr(self, name)[at] = np.take_along_axis(x, order, axis=1)


class _Block:
    """One row block, cut into runs of neighbouring angles."""

    def __init__(self, rows: _Rows):
        self.rows = rows
        n = len(rows.row)
        near = np.argmin(rows.angles, axis=1)
        by_angle = np.lexsort((rows.angles[np.arange(n), near], near))
        by_id = np.lexsort((rows.row, rows.id, rows.no_id))
        place = np.empty(n, np.int64)
        place[by_id] = np.arange(n)
        self.runs = []
        for k in range(0, n, RUN):
            of = by_angle[k:k + RUN]
            of = of[np.argsort(place[of])]
            m, _ = _matrix([rows.vectors[i] for i in of], rows.width)
            a = rows.angles[of]
            self.runs.append((of, m, np.cos(a), np.sin(a), a.min(0), a.max(0), rows.norm[of].max(), rows.norm[of].min()))

    def overlaps(self, anchors: _Rows, run, low: np.ndarray, high: np.ndarray):
        """(anchors, mask of anchor and row) that may have a score in [low, high] of the anchor; first by the run's ranges, then row by row."""
        of, _, cos, sin, least, most, big, small = run
        a = anchors.angles
        gap = np.maximum(np.maximum(least - a, a - most), 0).max(1)
        far = np.where(a + most <= np.pi, a + most, np.where(a + least >= np.pi, 2 * np.pi - a - least, np.pi)).min(1)
        top, bottom = np.cos(gap), np.cos(far)
        top, bottom = np.where(top > 0, top * big, top * small), np.where(bottom > 0, bottom * small, bottom * big)
        slack = SLACK * anchors.norm * big
        at = np.flatnonzero((np.ceil(top * anchors.norm + slack) + 1 >= low) & (np.floor(bottom * anchors.norm - slack) - 1 <= high))
        if not len(at):
            return at, None
        ca, sa = np.cos(a[at]), np.sin(a[at])
        upper, lower = np.full((len(at), len(of)), 1.0), np.full((len(at), len(of)), -1.0)
        for k in range(a.shape[1]):
            c, s = np.multiply.outer(ca[:, k], cos[:, k]), np.multiply.outer(sa[:, k], sin[:, k])
            np.minimum(upper, c + s, out=upper)
            np.maximum(lower, c - s, out=lower)
        lo, hi = _wider(lower, upper, np.multiply.outer(anchors.norm[at], self.rows.norm[of]))
        return at, (hi >= low[at, None]) & (lo <= high[at, None])

    def scored(self, anchors: _Rows, run, low: np.ndarray, high: np.ndarray):
        """(anchors, rows, scores, mask) of the pairs whose bounds overlap."""
        at, mask = self.overlaps(anchors, run, low, high)
        if not len(at) or not mask.any():
            return None
        keep_a, keep_r = mask.any(1), mask.any(0)
        at, of, mask = at[keep_a], run[0][keep_r], mask[np.ix_(keep_a, keep_r)]
        width = max(anchors.width, self.rows.width)
        a, _ = _matrix([anchors.vectors[i] for i in at], width)
        b = run[1][keep_r]
        b = np.pad(b, ((0, 0), (0, width - b.shape[1])))
        return at, of, _scores(a, b, float(anchors.norm[at].max() * self.rows.norm[of].max())), mask

    def positives(self, anchors: _Rows, keep: int):
        n = len(anchors.row)
        best = _Best(n, keep)
        for run in self.runs:
            found = self.scored(anchors, run, best.wanted().astype(np.float64), np.full(n, np.inf))
            if found:
                at, of, s, mask = found
                ok = mask & (self.rows.label[of] == anchors.label[at, None]) & (self.rows.row[of] != anchors.row[at, None]) & (s >= best.wanted()[at, None])
                best.take(at, s, ok, self.rows, of)
        yield from self._out(anchors, best, 0)

    def negatives(self, anchors: _Rows, keep: int, shares: tuple[int, int]):
        """The best rows of another label whose score lies between two shares (percent) of a positive's, for each positive."""
        n, places = len(anchors.row), max((len(p) for p in anchors.positives), default=0)
        low, high = np.full((places, n), MOST, np.int64), np.full((places, n), LEAST, np.int64)
        for i, found in enumerate(anchors.positives):
            for k, p in enumerate(found):
                low[k, i], high[k, i] = -(-shares[0] * p["score"] // 100), shares[1] * p["score"] // 100
        best = [_Best(n, keep) for _ in range(places)]
        for run in self.runs:
            if not places:
                break
            still = np.array([np.maximum(low[k], best[k].wanted()) for k in range(places)])
            live = still <= high
            least = np.where(live, still, MOST).min(0).astype(np.float64)
            found = self.scored(anchors, run, least, np.where(live, high, LEAST).max(0).astype(np.float64))
            if not found:
                continue
            at, of, s, mask = found
            mask &= self.rows.label[of] != anchors.label[at, None]
            for k in range(places):
                best[k].take(at, s, mask & (s >= still[k][at, None]) & (s <= high[k][at, None]), self.rows, of)
        for k in range(places):
            yield from self._out(anchors, best[k], k)

    def _out(self, anchors: _Rows, best: _Best, place: int):
        i, k = np.nonzero(~best.none)
        if len(i):
            ids = pa.array(best.id[i, k], pa.int64(), mask=best.no_id[i, k])
            yield pa.RecordBatch.from_arrays([pa.array(anchors.row[i]), pa.array(anchors.id[i]), pa.array(np.full(len(i), place)),
                                              pa.array(best.score[i, k]), pa.array(best.row[i, k]), ids], schema=to_arrow_schema(_MET))


def _meet(work):
    """Function over a stream sorted by (block, kind): the rows of a block (kind 0), then anchors (kind 1) in chunks."""
    def run(batches):
        block_no, held, block = None, [], None
        for batch in batches:
            nos, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(nos) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(nos)]):
                if start == end:
                    continue
                if nos[start] != block_no:
                    block_no, held, block = nos[start], [], None
                if kinds[start] == 0:
                    held.append(batch.slice(start, end - start))
                    continue
                if block is None and held:
                    block, held = _Block(_Rows(pa.Table.from_batches(held))), []
                for k in range(start, end, CHUNK):
                    if block is not None:
                        yield from work(block, _Rows(batch.slice(k, min(CHUNK, end - k))))
    return run


# --- on Spark --------------------------------------------------------------------------------------

def _usable(df: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), v.alias("v"))
            .filter(F.col("label").isNotNull() & F.col("v").isNotNull()).filter(F.forall("v", finite)))


def _indexed(rows: DataFrame, every: int, scale: int) -> DataFrame:
    """Integer vectors with norms and angles; ``row`` tells equal rows apart."""
    sample = [np.array(r.v, np.float64) for r in rows.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(SAMPLE_ROWS).collect()]
    refs = directions([_floats(to_integers(v, scale)) for v in sample], DIRECTIONS)
    src = rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", "v", F.coalesce(F.col("id") % every == 0, F.lit(False)).alias("anchor"))
    arrow = to_arrow_schema(_ROW)

    def run(batches):
        for batch in batches:
            out = {n: [] for n in ("vector", "norm", "angles", "cell", "angle")}
            for v in batch.column("v").to_pylist():
                whole = to_integers(np.array(v, np.float64), scale)
                x = _floats(whole)
                norm = float(np.linalg.norm(x))
                w = min(len(x), refs.shape[1])
                cos = refs[:, :w] @ x[:w] / norm if norm else np.ones(len(refs))
                angles = np.arccos(np.clip(cos, -1, 1))
                cell = int(np.argmin(angles))
                for n, value in zip(out, (_packed(whole), norm, angles.astype("<f8").tobytes(), cell, float(angles[cell])), strict=True):
                    out[n].append(value)
            kept = [batch.column(n) for n in ("row", "id", "label", "anchor")]
            made = [pa.array(out[n], arrow.field(n).type) for n in out]
            yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return src.mapInArrow(run, _ROW)


def _streams(rows: DataFrame, anchors: DataFrame, blocks: int, work) -> DataFrame:
    """Every row block with all anchors after it, and what ``work`` finds there."""
    cols = ["row", "id", "label", "vector", "norm", "angles"]
    held = rows.select("block", F.lit(0).alias("kind"), *cols, F.lit(None).cast(_POSITIVES).alias("positives"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *cols, "positives")
    return held.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "kind", "row").mapInArrow(_meet(work), _MET)


def _first(met: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine(df: DataFrame, id_col: str, vector_col: str, label: Column, every: int, n_positives: int = 5, n_negatives: int = 3,
         shares: tuple[int, int] = (50, 95), scale: int = 256) -> DataFrame:
    """For every anchor (id divisible by ``every``) and each of its best rows of the same label, the best rows of
    another label whose score is between ``shares`` percent of the positive's."""
    spark = df.sparkSession
    ship_package(spark)
    rows = _usable(df, id_col, vector_col, label)
    n = rows.count()
    blocks = max(1, -(-n // min(max(n // 24, BLOCK_LEAST), BLOCK_MOST)))
    folder = scratch_path(spark, "hard-negatives")
    (_indexed(rows, every, scale).repartitionByRange(blocks, "cell", "angle", "row").withColumn("block", F.spark_partition_id())
     .write.parquet(f"{folder}/rows"))
    rows = spark.read.parquet(f"{folder}/rows")
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    anchors = rows.filter("anchor").withColumn("positives", F.lit(None).cast(_POSITIVES))
    _first(_streams(rows, anchors, blocks, lambda b, a: b.positives(a, n_positives)), n_positives).write.parquet(f"{folder}/positives")
    found = spark.read.parquet(f"{folder}/positives")
    lists = found.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "row", "score"))).alias("p"))
    lists = lists.select(F.col("anchor_row").alias("row"), F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["row"].alias("row"), x["score"].alias("score"))).alias("positives"))
    anchors = rows.filter("anchor").join(lists, "row")
    met = _first(_streams(rows, anchors, blocks, lambda b, a: b.negatives(a, n_negatives, shares)), n_negatives)
    positives = found.select("anchor_row", (F.col("rank") - 1).cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return met.join(positives, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def report(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 50; a seventh of the labels is moved on by one first."""
    label, vec_id = F.col("label").cast("long"), F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings, "vec_id", "embedding", label, every=50)
