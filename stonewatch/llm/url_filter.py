"""Host and path rules on page addresses by a sort-merge range join.

A rule's key is its host with the labels reversed, a `?` (which neither host nor path can
hold), and its path: everything the rule covers for that host lies in the interval from the
key to the key followed by byte 255. An address has one key for each of its host's endings,
no longer than the longest rule asks for. Keys and both ends of every interval are sorted
together by range partitioning; a sweep over the order keeps the innermost open rule.
Intervals of prefixes nest, so the stack is kept as parent pointers: an interval's start puts
the rule on top, its end puts the enclosing rule back. What is open at the start of a
partition is carried over from the one row per partition that says what was open last.
An address whose endings meet several rules takes the longest one (host and path together;
of equal lengths the later in text order).

No key is special: a host with a third of all rows is cut by range like any other rows.

Null addresses and those without `://` have an empty host and path, meet no rule and get
the default verdict. Of rules with equal host and path, `block` wins; rules without a host
are ignored, a null path is an empty one. Repeated rows are judged one by one; extra columns
are ignored; empty tables give empty results, an empty rule table only default verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stonewatch.llm.common import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DEFAULT_VERDICT = "allow"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("?"), path).cast("binary")


def rule_events(rules: DataFrame) -> DataFrame:
    """Two rows (key, turn, top) per rule: what is on top of the stack from that key on."""
    clean = (
        rules.filter(F.col("host").isNotNull())
        .select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
    )
    rule = F.struct(
        F.length(F.concat("host", "path")).alias("length"), F.concat("host", "path").alias("rule"), "verdict"
    )
    known = clean.withColumn("self", rule)
    shorter = known.filter(F.length("path") > 0).select(
        "host", F.col("path").alias("inner"), F.explode(F.sequence(F.lit(0), F.length("path") - 1)).alias("k")
    )
    parents = (
        shorter.withColumn("path", F.expr("left(inner, k)"))
        .join(known, ["host", "path"])
        .groupBy("host", F.col("inner").alias("path"))
        .agg(F.max("self").alias("parent"))
    )
    nested = known.join(parents, ["host", "path"], "left").withColumn(
        "key", _key(_reversed_labels(F.col("host")), F.col("path"))
    )
    none = F.struct(
        F.lit(None).cast("int").alias("length"), F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
    )
    starts = nested.select("key", F.lit(0).alias("turn"), F.col("self").alias("top"))
    ends = nested.select(
        F.concat("key", F.unhex(F.lit("FF"))).alias("key"),
        F.lit(2).alias("turn"),
        F.coalesce("parent", none).alias("top"),
    )
    return starts.unionByName(ends)


def judge(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict."""
    url = F.col(f"`{url_column}`")
    parsed = stage(
        pages.select(
            F.col(f"`{id_column}`").alias("page_id"),
            host_of(url).alias("host"),
            path_of(url).alias("path"),
            F.monotonically_increasing_id().alias("rid"),
        ),
        "addresses",
    )
    # two numbers that bound what of an address can matter
    most = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("path")).alias("chars")
    ).first()
    depth, chars = most["labels"] or 1, most["chars"] or 0
    ending = F.explode(
        F.transform(
            F.sequence(F.lit(1), F.least(F.size(F.split("host", r"\.")), F.lit(depth))),
            lambda n: F.slice(_reversed_labels(F.col("host")), F.lit(1), n),
        )
    )
    points = (
        parsed.filter("host != ''")
        .select("rid", F.expr(f"left(path, {chars})").alias("cut"), ending.alias("labels"))
        .select(_key(F.col("labels"), F.col("cut")).alias("key"), F.lit(1).alias("turn"), "rid")
    )
    sweep = stage(
        points.unionByName(rule_events(rules), allowMissingColumns=True)
        .repartitionByRange("key", "turn", "rid")
        .withColumn("part", F.spark_partition_id()),
        "sweep",
    )
    last_seen = sweep.groupBy("part").agg(
        F.max_by("top", F.when(F.col("top").isNotNull(), F.struct("key", "turn"))).alias("left_open"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    carried = last_seen.select("part", F.last("left_open", ignorenulls=True).over(before).alias("carried"))
    so_far = Window.partitionBy("part").orderBy("key", "turn", "rid").rowsBetween(Window.unboundedPreceding, 0)
    swept = (
        sweep.withColumn("open", F.last("top", ignorenulls=True).over(so_far))
        .filter("turn = 1")
        .join(F.broadcast(carried), "part", "left")
        .withColumn("open", F.coalesce("open", "carried"))
        .filter("open.rule is not null")
    )
    best = swept.groupBy("rid").agg(F.max("open").alias("best"))
    return parsed.join(best, "rid", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
