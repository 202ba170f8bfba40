"""Connected components of a link table, by hooking and pointer jumping; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.scratch import Scratch


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that is linked with it over any number of links. Only nodes with links are there.

    Each round hooks every label to the smallest label beside it and follows the hooks to their end;
    the labels that are left with links inside shrink until none is left.
    """
    scratch, turn = Scratch(links.sparkSession), 0
    rest = scratch.write(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a < b").distinct(), "links-0")
    labels = scratch.write(rest.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "labels-0")
    while not rest.isEmpty():
        turn += 1
        hooks, jumps = scratch.write(rest.groupBy(F.col("b").alias("x")).agg(F.min("a").alias("to")), "hooks-0"), 0
        while True:
            jumps += 1
            on = hooks.select(F.col("x").alias("to"), F.col("to").alias("further"))
            jumped = scratch.write(hooks.join(on, "to", "left").select("x", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), f"hooks-{jumps}")
            scratch.drop(f"hooks-{jumps - 1}")
            hooks = jumped.select("x", "to")
            if jumped.filter("moved").isEmpty():
                break
        labels = scratch.write(labels.join(hooks, labels["label"] == hooks["x"], "left").select("node", F.coalesce("to", "label").alias("label")), f"labels-{turn}")
        end = lambda side: hooks.select(F.col("x").alias(side), F.col("to").alias(f"{side}_to"))  # noqa: E731, B023
        moved = rest.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_to", "a").alias("a"), F.coalesce("b_to", "b").alias("b"))
        rest = scratch.write(moved.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"links-{turn}")
        scratch.drop(f"labels-{turn - 1}", f"links-{turn - 1}", f"hooks-{jumps}")
    return labels
