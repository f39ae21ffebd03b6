"""Spelling variant grouping: words of one edit apart, found by walking a trie that is a table.

Words of one length and reading direction form a trie whose edges carry
``LABEL`` letters (more for words of over ``LABEL * MOST_LEVELS`` letters, so that the
number of levels stays bounded). A node is the hash of its path; the edge table
(key, node, label, ends) is dealt over the cluster by key. A state (word,
position, node, edits) starts in the middle of its word: an edit lies either in
the second half, which the forward tries find, or in the first, which the tries
of reversed words find. Level by level, the states are joined with the edges
below their node: along the word's own next letters, or, with no edit made yet,
along every edge that agrees with them outside one piece of the label and is one
edit away. States that end with one edit name a neighbour, whose spelling is
compared once more, so that equal hashes cannot add a pair.

States of equal length follow a replaced letter to the larger letter only, and
states of a longer word drop one letter; the reverse pairs are their mirror.
Everything is a join or an aggregate over DataFrames.

Defined results: null and empty texts hold no words; a null id counts as an
empty one; equal rows count as often as they stand there; ties go to the word
that is smallest in code-point order; empty tables give no rows; other columns
are not read. Words may be of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]+"
#: Letters on an edge, levels of a trie at most, pieces of a label that an edit may hide in.
LABEL, MOST_LEVELS, PIECES = 2, 24, 16


def runs(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, run): every lower-cased maximal run of at least ``least`` letters, as often as it occurs."""
    found = F.explode(F.regexp_extract_all(F.col(f"`{text_col}`").cast("string"), F.lit(RUNS), F.lit(0)))
    return (docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), found.alias("run"))
            .filter(F.length("run") >= least).withColumn("run", F.translate("run", UPPER, LOWER)))


def with_typos(found: DataFrame, one_in: int) -> DataFrame:
    """(word): runs, less one letter where ``one_in`` divides the crc32 of ``id:run``; the same draw says which letter."""
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    typo = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return found.withColumn("h", h).select(F.when(F.col("h") % one_in == 0, typo).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, least_letters: int, least_n: int) -> DataFrame:
    """(word, n) of words with enough letters and occurrences."""
    return words.filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_n)


def _label_size(length: Column) -> Column:
    return F.greatest(F.lit(LABEL), F.ceil(length / MOST_LEVELS)).cast("int")


def _half(backward: Column, length: Column) -> Column:
    """Letters that a path takes at once in a trie of words of ``length`` letters; the levels follow."""
    size = _label_size(length)
    forward = F.floor(F.ceil(length / size) / 2).cast("int") * size
    return F.when(backward, F.floor((length - forward) / size).cast("int") * size).otherwise(forward)


def _part(text: Column, start: Column, length: Column) -> Column:
    """``length`` letters of ``text`` from ``start``, counted from 0."""
    return F.substring(text, start + 1, length)


def _root(word: Column, backward: Column, length: Column, half: Column) -> Column:
    return F.xxhash64(backward, length, _part(word, F.lit(0), half))


def _pieces(length: Column) -> Column:
    return F.least(length, F.lit(PIECES))


def _piece_start(piece: Column, length: Column) -> Column:
    return F.floor(piece * length / _pieces(length)).cast("int")


def _hidden_key(node: Column, piece: Column, length: Column, text: Column, start: Column, more: Column) -> Column:
    """Key of labels of ``length`` letters below ``node`` but for one piece; the text has ``more`` letters in that place."""
    a, b = _piece_start(piece, length), _piece_start(piece + 1, length)
    return F.xxhash64(node, piece, length, F.concat(_part(text, start, a), _part(text, start + b + more, length - b)))


def _both_ways(words: DataFrame) -> DataFrame:
    ways = [F.struct(F.lit(back).alias("backward"), (F.reverse("word") if back else F.col("word")).alias("word")) for back in (False, True)]
    return words.select(F.explode(F.array(*ways)).alias("x")).select("x.*")


def _edges(words: DataFrame) -> DataFrame:
    """(level, key, node, label, ends): every edge under the node it leads to and under one key a piece; ``ends``: the word, at its last edge."""
    w = _both_ways(words).withColumn("length", F.length("word"))
    w = w.withColumn("size", _label_size(F.col("length"))).withColumn("half", _half(F.col("backward"), F.col("length")))
    label = lambda level: _part(F.col("word"), F.col("half") + level * F.col("size"), F.col("size"))
    w = w.filter("half < length").withColumn("last", F.ceil((F.col("length") - F.col("half")) / F.col("size")).cast("int") - 1)
    grow = lambda path, level: F.array_append(path, F.xxhash64(F.element_at(path, -1), label(level)))
    w = w.withColumn("path", F.aggregate(F.sequence(F.lit(0), F.col("last")), F.array(_root(F.col("word"), F.col("backward"), F.col("length"), F.col("half"))), grow))
    w = w.select("*", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("level"))
    w = w.select("level", F.get("path", F.col("level")).alias("parent"), F.get("path", F.col("level") + 1).alias("node"),
                 label(F.col("level")).alias("label"), F.when(F.col("level") == F.col("last"), F.col("word")).alias("ends")).distinct()
    n, piece = F.length("label"), F.col("piece")
    w = w.select("*", F.explode(F.sequence(F.lit(-1), _pieces(n) - 1)).alias("piece"))
    hidden = _hidden_key(F.col("parent"), piece, n, F.col("label"), F.lit(0), F.lit(0))
    return w.select("level", F.when(piece < 0, F.col("node")).otherwise(hidden).alias("key"), "node", "label", "ends")


def _start(words: DataFrame) -> DataFrame:
    """(word, backward, dropped, pos, node, edits): every word in the tries of its own length and of one letter less."""
    w = _both_ways(words).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("dropped"))
    length = F.length("word") - F.col("dropped")
    w = w.withColumn("pos", _half(F.col("backward"), length)).filter(F.col("pos") < length)
    return w.withColumn("node", _root(F.col("word"), F.col("backward"), length, F.col("pos"))).withColumn("edits", F.lit(0))


def _step(states: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one level down, with the word of the trie where they arrive at its end."""
    word, pos, node, dropped, piece, n = (F.col(c) for c in ("word", "pos", "node", "dropped", "piece", "n"))
    length = F.length(word) - dropped
    behind = F.when(F.col("edits") == 1, dropped).otherwise(0)
    tries = states.withColumn("n", F.least(_label_size(length), length - pos + behind).cast("int"))
    tries = tries.select("*", F.explode(F.sequence(F.lit(-1), F.when(F.col("edits") == 0, _pieces(n) - 1).otherwise(-1))).alias("piece"))
    more = F.when(piece < 0, 0).otherwise(dropped)
    key = F.when(piece < 0, F.xxhash64(node, _part(word, pos, n))).otherwise(_hidden_key(node, piece, n, word, pos, dropped))
    tries = tries.select("word", "backward", "dropped", (pos + n + more).alias("pos"), (F.col("edits") + (piece >= 0).cast("int")).alias("edits"),
                         (piece >= 0).alias("edited"), _part(word, pos, n + more).alias("own"), key.alias("key"))
    own, label = F.col("own"), F.col("label")
    one_edit = (F.levenshtein(own, label, 1) == 1) & ((F.col("dropped") == 1) | (label > own))
    return (tries.join(edges.select("key", F.col("node"), "label", "ends"), "key")
            .filter(F.when(F.col("edited"), one_edit).otherwise(own == label))
            .filter(F.col("ends").isNull() | (F.col("edits") == 1) | (F.col("dropped") == 1))
            .select("word", "backward", "dropped", "pos", "node", "edits", "ends"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near), both ways, of distinct ``word`` values one inserted, deleted or replaced code point apart."""
    spark = words.sparkSession
    folder = scratch_path(spark, "trie")
    _edges(words.select("word")).write.partitionBy("level").parquet(f"{folder}/edges")
    edges = spark.read.schema("key long, node long, label string, ends string, level int").parquet(f"{folder}/edges")
    levels = edges.agg(F.max("level")).first()[0]
    states, met = _start(words.select("word")), []
    for level in range(0 if levels is None else levels + 1):
        at = f"{folder}/level-{level}"
        _step(states, edges.filter(F.col("level") == level)).write.parquet(at)
        arrived = spark.read.parquet(at)
        states = arrived.filter("ends IS NULL")
        met.append(arrived.filter("ends IS NOT NULL").select("word", "ends", "backward"))
    if not met:
        return words.select("word", F.col("word").alias("near")).limit(0)
    pairs = reduce(DataFrame.union, met).filter(F.levenshtein("word", "ends", 1) == 1)
    turned = lambda c: F.when(F.col("backward"), F.reverse(c)).otherwise(F.col(c))
    pairs = pairs.select(turned("word").alias("word"), turned("ends").alias("near"))
    return pairs.union(pairs.select("near", "word")).distinct()


def grouped(words: DataFrame, ratio: int = 10) -> DataFrame:
    """(word, n, form, form_n, n_near, root) of (word, n): ``form`` is the most frequent near word, if ``ratio`` times as frequent."""
    spark = words.sparkSession
    folder = scratch_path(spark, "spelling")
    words.select("word", "n").write.parquet(f"{folder}/words")
    words = spark.read.schema("word string, n long").parquet(f"{folder}/words")
    near = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= ratio * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    out.write.parquet(f"{folder}/forms")
    out = spark.read.parquet(f"{folder}/forms")
    return out.join(_roots(out, folder), "word", "left").withColumn("root", F.coalesce("root", "word"))


def _roots(forms: DataFrame, folder: str) -> DataFrame:
    """(word, root) of words that have a form: every round doubles how far a word has followed forms, which grow ``ratio`` times a step."""
    spark = forms.sparkSession
    links, done = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), 0
    while True:
        links.write.parquet(f"{folder}/roots-{done}")
        links = spark.read.parquet(f"{folder}/roots-{done}")
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = links.join(onward, "root")
        if longer.isEmpty():
            return links
        links, done = links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), done + 1


def report(docs: DataFrame) -> DataFrame:
    """Words of seven letters and two occurrences or more, their near words, forms and roots, after planting typos by crc32."""
    words = counted(with_typos(runs(docs, least=7), one_in=31), least_letters=7, least_n=2)
    return grouped(words).select("word", "form", "root", "n", "n_near", "form_n")
