"""Wide context of keys: many branches as one tagged union, of which a task keeps the first of each key before text moves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Branch:
    """Rows (key, ord, text) in the order of ord, then text: the first `items` that are not empty, the first `chars` characters of their join by
    `gap`; one bound at least is given.  Rows of a null key are every key's, behind its own."""

    rows: DataFrame
    gap: str = "\n"
    items: int | None = None
    chars: int | None = None

    @property
    def most(self) -> int:
        """No more items can count: each has a character at least, and a gap."""
        step = 1 + len(self.gap)
        bounds = [b for b in (self.items, None if self.chars is None else -(-self.chars // step)) if b is not None]
        if not bounds:
            raise ValueError("a branch needs a bound")
        return min(bounds)


def _firsts(rows: DataFrame, group: list[str], branches: dict[str, Branch]) -> DataFrame:
    """The rows of each group that can count there, with their rank."""
    by_tag = lambda of: F.create_map(*(F.lit(x) for tag, b in branches.items() for x in (tag, of(b))))[F.col("tag")]
    order = Window.partitionBy(*group).orderBy("ord", "text")
    gap = by_tag(lambda b: len(b.gap))
    step = F.length("text") + gap
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(b.most for b in branches.values())).where(F.col("rank") <= by_tag(lambda b: b.most))
    before = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)) - step - gap  # the gap before a row may count alone
    return ranked.withColumn("before", before).where(F.col("before") < by_tag(lambda b: 1 << 62 if b.chars is None else b.chars)).drop("before")


def wide_context(keys: DataFrame, branches: dict[str, Branch]) -> DataFrame:
    """keys (key, ...) with a column of text per branch, empty where it has nothing.  What a reading task gives of a
    key and branch is at most Branch.most items of Branch.chars characters, and what goes on to the task of a key at most
    Branch.chars characters and an item of each reading task: ranks are limited in the tasks that read, if Branch.most is within spark.sql.optimizer.windowGroupLimitThreshold, which build_session() raises.  Null keys of `keys` get what is every key's."""
    parts = []
    for tag, b in branches.items():
        text = F.col("text") if b.chars is None else F.left("text", F.lit(b.chars))
        parts.append(b.rows.where("text <> ''").select("key", F.lit(tag).alias("tag"), F.col("ord").cast("long").alias("ord"), text.alias("text")))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    # First of what each reading task has, by items and characters, then of what all tasks have left: so a key's rows do not
    # meet in one task as they are.
    firsts = union.withColumn("part", F.spark_partition_id())
    for group in (["key", "tag", "part"], ["key", "tag"]):
        firsts = _firsts(firsts, group, branches)
    gathered = firsts.groupBy("key", "tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("ts"))
    by_tag = gathered.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("tag", "ts"))).alias("own"))
    every = by_tag.where("key is null").select(F.col("own").alias("every"))
    mine = by_tag.where("key is not null").withColumnRenamed("key", "k")
    joined = keys.join(mine, F.col("key") == F.col("k"), "left").join(F.broadcast(every), F.lit(True), "left")  # one row of bounded size

    def column(tag: str, b: Branch):
        listed = lambda c: F.coalesce(F.try_element_at(c, F.lit(tag)), F.array().cast("array<string>"))
        text = F.array_join(F.slice(F.concat(listed(F.col("own")), listed(F.col("every"))), 1, b.most), b.gap)
        return (text if b.chars is None else F.left(text, F.lit(b.chars))).alias(tag)

    return joined.select(*(keys[c] for c in keys.columns), *(column(t, b) for t, b in branches.items()))
