"""Connected components of a table of links by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import stage


def _with_label(rows: DataFrame, key: str, labels: DataFrame, out: str) -> DataFrame:
    """The label of each row's `key`. Both sides are read from staged tables, so that adaptive
    execution can split a key with any share of the rows."""
    return rows.join(labels.select(F.col("node").alias(key), F.col("label").alias(out)), key)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all nodes in `links` (a, b): the label is the smallest node reachable.

    Nodes start with the smallest label around them. A round looks at the labels of the
    ends of every link; where they differ, the larger label is pointed to the smallest one it
    meets, and labels of labels are followed, so chains take a logarithmic number of rounds
    and stars one. Links whose ends share a label are dropped from further rounds. Links must
    be staged.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels"
    )
    open_links = links.select("a", "b")
    while True:
        ends = _with_label(open_links, "a", labels, "la")
        ends = stage(_with_label(ends, "b", labels, "lb").filter("la <> lb").select("la", "lb"), "ends")
        if ends.isEmpty():
            break
        # the labels themselves are nodes: link them, then follow labels of labels twice
        open_links = stage(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "open")
        lower = open_links.groupBy(F.greatest("a", "b").alias("node")).agg(F.min(F.least("a", "b")).alias("lower"))
        labels = stage(
            labels.join(lower, "node", "left").select("node", F.least("label", F.coalesce("lower", "label")).alias("label")),
            "labels",
        )
        labels = _jumped(labels)
    while True:  # every component has one label by now, unless a label points further
        further = _jumped(labels)
        if further.join(labels.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty():
            return further
        labels = further


def _jumped(labels: DataFrame) -> DataFrame:
    found = _with_label(labels, "label", labels.select("node", "label"), "further")
    return stage(found.select("node", F.col("further").alias("label")), "labels")
