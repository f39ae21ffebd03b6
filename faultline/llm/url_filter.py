"""URL filters by a sort-merge range join of urls and nested rules.

A host becomes a canonical key, its labels in reverse with a dot after each:
``en.example.net`` is ``net.example.en.``. A rule's host and all its subdomains
are then one interval of keys, and the intervals of two rules are nested or
apart. Urls are dealt by ranges of (key, path, row number), so that one host, or one
url, may fill many partitions; a rule is copied to each partition that its interval
meets. Every partition is read in key order, rules before urls, with a stack of
the hosts whose intervals are open; a host on the stack holds its rules by path.
Memory is the open rules, whatever the number of urls.

Of the rules that fit a url — its host is the rule's or a subdomain, its path starts with
the rule's — the longest in letters of host and path decides, then the one
with the longer host, then a block before an allow. Without a rule, the default
decides (allow).

Defined results: a null url or one without ``://`` has an empty host and path, which no rule
fits; every row is judged, repeated rows each; rules without a host take no
part, a null path of a rule is empty; without rules the default stands; empty
tables give no rows; only the columns in ``carry`` come along.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from faultline.llm.common import unused
from faultline.session import scratch_path, ship_package

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed values of the query: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_RULE = T.StructType([T.StructField(n, t) for n, t in (
    ("part", T.IntegerType()), ("key", T.StringType()), ("stop", T.StringType()), ("host", T.StringType()), ("path", T.StringType()), ("verdict", T.StringType()))])


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) of rules given as a list."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_key(host: Column) -> Column:
    """Labels in reverse, a dot after each; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class _Sweep:
    """The hosts whose key intervals are open, outermost first, each with its rules by path."""

    def __init__(self):
        self.stack: list[tuple] = []

    def close_before(self, key: str) -> None:
        while self.stack and self.stack[-1][0] <= key:
            self.stack.pop()

    def open(self, stop: str, host: str, path: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][1] != host:
            self.stack.append((stop, host, {}, []))
        _, _, paths, sizes = self.stack[-1]
        paths[path] = min(verdict, paths.get(path, verdict), key=lambda v: v != "block")
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def decide(self, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits a url whose key is the one the sweep stands at."""
        best, rule = (-1, -1), None
        for _, host, paths, sizes in self.stack:
            for size in sizes:
                if size <= len(path) and path[:size] in paths:
                    if (len(host) + size, len(host)) > best:
                        best, rule = (len(host) + size, len(host)), (host + path[:size], paths[path[:size]])
                    break
        return rule


def _copies(rules: DataFrame, parts: list[tuple[int, str, str]]) -> DataFrame:
    """Every rule once for each part whose range of keys its interval meets."""
    first, last, numbers = [p[1] for p in parts], [p[2] for p in parts], [p[0] for p in parts]
    arrow = to_arrow_schema(_RULE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            # a part after the interval's start (its last key at or behind it) and before its stop
            out = [{"part": numbers[k], **r} for r in rows for k in range(bisect_left(last, r["key"].encode()), bisect_left(first, r["stop"].encode()))]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rules.mapInArrow(run, _RULE)


def judge(pages: DataFrame, rules: DataFrame, carry: list[str], url_col: str = "url", default: str = "allow") -> DataFrame:
    """The ``carry`` columns of every row with host, path, the deciding rule (null if none fits) and the verdict."""
    spark = pages.sparkSession
    ship_package(spark)
    names = {n: unused(n, carry) for n in ("host", "path", "rule", "verdict")}
    kept = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("kept") if carry else F.lit(True).alias("kept")
    url = F.col(f"`{url_col}`").cast("string")
    urls = pages.select(kept, host_of(url).alias("host"), path_of(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    path = scratch_path(spark, "urls")
    (urls.withColumn("key", canonical_key(F.col("host"))).repartitionByRange("key", "path", "row")
     .withColumn("part", F.spark_partition_id()).write.parquet(path))
    urls = spark.read.parquet(path)
    ranges = urls.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last")).orderBy("part").collect()
    host = F.translate(F.col("host"), UPPER, LOWER)
    rules = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    rules = rules.withColumn("key", canonical_key(F.col("host"))).withColumn("stop", F.expr("concat(substring(key, 1, length(key) - 1), '/')"))
    rules = _copies(rules.select("key", "stop", "host", "path", "verdict"), [(r.part, r.first.encode(), r.last.encode()) for r in ranges])
    urls = urls.select("part", "key", F.lit(1).alias("kind"), "path", "host", "row", "kept")
    events = urls.unionByName(rules.select("part", "key", F.lit(0).alias("kind"), "path", "host", "stop", F.col("verdict").alias("ruling")), allowMissingColumns=True)
    events = events.repartition(max(1, len(ranges)), "part").sortWithinPartitions("part", "key", "kind", "path", "row")
    fields = [urls.schema["kept"], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))]
    arrow = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, part = _Sweep(), None
        for batch in batches:
            at, rule, verdict = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("part", "kind", "key", "path", "host", "stop", "ruling")]
            for i, (p, kind, key, url_path, rule_host, stop, ruling) in enumerate(zip(*cols, strict=True)):
                if p != part:
                    sweep, part = _Sweep(), p
                sweep.close_before(key)
                if kind == 0:
                    sweep.open(stop, rule_host, url_path, ruling)
                    continue
                found = sweep.decide(url_path) or (None, default)
                at.append(i)
                rule.append(found[0])
                verdict.append(found[1])
            here = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([here.column("kept").cast(arrow.field(0).type), here.column("host"), here.column("path"),
                                              pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=arrow)

    out = events.mapInArrow(run, T.StructType(fields))
    return out.select(*([F.col("kept")[c].alias(c) for c in carry]), *[F.col(n).alias(names[n]) for n in names])


def report(pages: DataFrame) -> DataFrame:
    """The verdict of the four fixed rules on every page."""
    return judge(pages, rule_table(pages.sparkSession, RULES), ["page_id"])


ORACLE = """
WITH p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rule_host, rule_path, ruling) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
q AS (SELECT *, row_number() OVER () AS k FROM p),
fits AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(ruling, length(rule_host || rule_path)) AS ruling
  FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(ruling, 'allow') AS verdict FROM q LEFT JOIN fits USING (k)
"""
