"""Line dedup: repeated passages of two lines or more, found as content-defined chunks and removed.

Only DataFrame functions.

A rolling hash over line hashes chooses the boundaries. Its window is one
line: a longer one would need context that a short passage does not have.
Three rules cut every text, each at its own remainders of that hash: a sparse
one at a tenth of all lines, two dense ones at all lines but a twentieth. A
chunk goes from a boundary line to the next one, both included, so it has two
lines or more and depends on its own lines alone: an insertion moves only the
chunks that hold it. Any two remainders are boundaries of a common rule, so
any two neighbouring lines are a chunk of some rule, and every repeated passage
is found from its first line to its last, whatever stands around it.

A line is known by 96 hash bits, its marks; distinct lines are grouped by their
bytes, and chunks with a line whose marks another line shares are left alone, so
equal marks are equal bytes. A chunk's key is the marks of all its lines: chunks
travel without text.

Plan: keys are aggregated with partial aggregation, so a chunk that a third of
all documents share is one row per task; occurrences find the verdict by their
key and only then meet per document, so nothing after that join depends on its
partitions and skew handling may split it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from faultline.llm.common import unused

#: Boundary rules: remainders of a line's hash by MODULUS at which a rule cuts; any two remainders are together in one of them.
MODULUS = 20
RULES = (range(0, 2), range(1, MODULUS), [0, *range(2, MODULUS)])
#: A chunk's first line and its number of lines in one long.
SHIFT = 31
#: A line's three hash values.
MARKS = ("m1", "m2", "m3")
#: Bits of the text hash that order documents of one id.
HASH_BITS = 62


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``."""
    return F.transform(F.array(value), body)[0]


def marks(line: Column) -> tuple[Column, Column, Column]:
    """A line's 96 hash bits as three ints."""
    return F.shiftright(F.xxhash64(line), 32).cast("int"), F.shiftright(F.shiftleft(F.xxhash64(line), 32), 32).cast("int"), F.hash(line)


def _mark(k: int) -> Callable[[Column], Column]:
    return lambda line: marks(line)[k]


def cuts(hashes: Column) -> Column:
    """Chunks of all rules, each once: first line * 2^SHIFT + number of lines."""
    def rule(remainders) -> Column:
        edge = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.pmod(F.get(hashes, i), F.lit(MODULUS)).isin(list(remainders)))
        return let(edge, lambda e: F.transform(F.slice(e, F.lit(1), F.greatest(F.size(e) - 1, F.lit(0))), lambda at, k: F.shiftleft(at.cast("long"), SHIFT) + F.get(e, k + 1) - at + 1))
    return F.array_distinct(F.flatten(F.array(*[rule(r) for r in RULES])))


def chunks_of(text: Column) -> Column:
    """Array of the chunks of a text: (at, n_lines, key, blank); the key holds the marks of all lines, blank tells of two blank lines in a row."""
    def cut(lines: Column) -> Column:
        def made(of: Column) -> Column:
            known, blank = [of[name] for name in MARKS], of["blank"]

            def chunk(code: Column) -> Column:
                at, n = F.shiftright(code, SHIFT).cast("int"), code.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int")
                return F.struct(at.alias("at"), n.alias("n_lines"), F.concat(*[F.slice(m, at + 1, n) for m in known]).alias("key"),
                                F.exists(F.slice(blank, at + 1, n - 1), lambda b: b).alias("blank"))
            return F.transform(cuts(known[0]), chunk)

        def white(x: Column) -> Column:
            return F.coalesce(F.trim(F.translate(x, "\t\r", "  ")) == "", F.lit(False))
        blank = F.transform(lines, lambda x, i: white(x) & white(F.get(lines, i + 1)))
        return let(F.struct(*[F.transform(lines, _mark(k)).alias(name) for k, name in enumerate(MARKS)], blank.alias("blank")), made)
    return let(F.split(text, "\n", -1), cut)


def place(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """A document's place in the order of copies: by id, a missing one last, then by text hash."""
    ident = F.col(f"`{id_col}`")
    digest = F.xxhash64(F.col(f"`{text_col}`")).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return (F.coalesce(ident.cast("long"), F.lit((1 << 63) - 1)).cast("decimal(19,0)") * F.lit(1 << HASH_BITS).cast("decimal(19,0)") + digest.cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.concat(F.coalesce(ident.cast("string"), F.lit("\U0010ffff")), F.lit("\0"), F.lpad(F.hex(digest), 16, "0"))


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, gone): the lines of each document that lie in a chunk which an earlier place has too.

    Earlier is another document that comes before, or far enough above in the
    same text: a chunk that overlaps its own first copy there (a line three
    times in a row) stays.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.filter(F.instr(text, "\n") > 0).select(place(docs, id_col, text_col).alias("doc"), text.alias("text"))
    # equal bytes are one group; different bytes under the same marks make it unusable
    line = rows.select(F.explode(F.split("text", "\n", -1)).alias("line")).distinct()
    shared = line.groupBy(*[m.alias(name) for m, name in zip(marks(F.col("line")), MARKS)]).agg(F.count("*").alias("texts"))
    shared = shared.filter("texts > 1").select(*MARKS, F.lit(True).alias("bad"))

    # two blank lines in a row are no passage; the smaller chunks around them find what is
    found = rows.select("doc", F.explode(chunks_of(F.col("text"))).alias("c")).filter(~F.col("c.blank")).select("doc", "c.at", "c.key")
    repeated = found.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("n")).filter("n > 1")
    n_lines = (F.size("key") / len(MARKS)).cast("int")
    lines = F.arrays_zip(*[F.slice("key", k * n_lines + 1, n_lines).alias(name) for k, name in enumerate(MARKS)])
    parts = repeated.select("key", "first", F.explode(lines).alias("m")).select("key", "first", "m.*").join(shared, list(MARKS), "left")
    verdict = parts.groupBy("key", "first").agg(F.max("bad").alias("bad")).filter("bad IS NULL").select("key", "first")

    # only a document that holds the first copy needs to know which of its own is that
    again = found.join(verdict, "key").select("doc", "at", n_lines.alias("n_lines"), F.when(F.col("doc") == F.col("first"), F.col("key")).alias("own"))
    top = F.min("at").over(Window.partitionBy("doc", "own"))
    gone = again.repartition("doc").withColumn("top", top).filter("own IS NULL OR at >= top + n_lines")
    return gone.groupBy("doc").agg(F.collect_set(F.shiftleft(F.col("at").cast("long"), SHIFT) + F.col("n_lines")).alias("gone"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_one: bool = True, counts: bool = False) -> DataFrame:
    """The documents with their text less repeated passages of two lines or more; all columns and rows kept.

    A passage goes line by line to both its ends; the first line with given
    bytes always stays somewhere. A null text stays null; an empty text and one
    without a newline have no two lines and stay; a pair of blank lines is no
    passage. Copies are ordered by id, those without one last, then by a hash of
    the text: rows of one id (or none) with different texts are different documents,
    rows equal in both are one and each keeps what it keeps. With ``keep_one``, a
    document whose lines would all go keeps its first one (one line is no
    passage), otherwise its text is then empty. With ``counts``, also n_lines
    and n_removed (both long).
    """
    doc, lost_doc, gone, kept = (unused(n, docs.columns) for n in ("__doc", "__lost_doc", "__gone", "__kept"))
    lost = repeated_chunks(docs, id_col, text_col).withColumnsRenamed({"doc": lost_doc, "gone": gone})
    text = F.col(f"`{text_col}`")
    mine = docs.withColumn(doc, place(docs, id_col, text_col))
    joined = mine.join(lost, mine[doc] == lost[lost_doc], "left")

    def rebuilt(lines: Column) -> Column:
        def span(code: Column) -> Column:
            at = F.shiftright(code, SHIFT).cast("int")
            return F.sequence(at, at + code.bitwiseAND(F.lit((1 << SHIFT) - 1)).cast("int") - 1)
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.flatten(F.transform(F.col(gone), span)))
        stay = let(stay, lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(0)))) if keep_one else stay
        return let(stay, lambda s: F.struct(F.array_join(F.transform(s, lambda i: F.get(lines, i)), "\n").alias("text"), F.size(s).alias("lines")))

    done = joined.withColumn(kept, F.when(F.col(gone).isNotNull(), let(F.split(text, "\n", -1), rebuilt)))
    cols = [F.when(F.col(gone).isNull(), text).otherwise(F.col(f"{kept}.text")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n_lines = F.when(text.isNull(), F.lit(0)).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        cols += [n_lines.cast("long").alias("n_lines"), F.when(F.col(gone).isNull(), F.lit(0)).otherwise(n_lines - F.col(f"{kept}.lines")).cast("long").alias("n_removed")]
    return done.select(*cols)


def report(docs: DataFrame) -> DataFrame:
    """op1: lines, lines removed and the digest of what is left of each document; a copy may lose all its lines."""
    done = dedup_lines(docs.select("doc_id", "text"), keep_one=False, counts=True)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same rows by brute force: every pair of neighbouring lines, by its bytes.
ORACLE = """
WITH line AS (
  SELECT doc_id, text IS NULL AS missing, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
pair AS (
  SELECT doc_id, i, line, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS below FROM line),
placed AS (
  SELECT doc_id, i, min(doc_id) OVER (PARTITION BY line, below) AS first, min(i) OVER (PARTITION BY line, below, doc_id) AS top
  FROM pair WHERE below IS NOT NULL AND trim(translate(line || below, chr(9) || chr(13), '  ')) <> ''),
again AS (
  SELECT doc_id, i FROM placed WHERE doc_id <> first OR i > top + 1),
gone AS (
  SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again)
SELECT l.doc_id, count(*) FILTER (NOT missing)::BIGINT AS n_lines, count(g.i)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
