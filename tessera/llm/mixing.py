"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree, here domain, language, source: a node's budget is shared among its children by
weight. A child that cannot use its share (its documents, repeated for at most `epochs` epochs) takes what it can, and its shortage goes to
its siblings, again by weight; only what all siblings together cannot use is left to the level above, which knows it in advance since capacities
are summed up the tree first. A leaf's budget is a prefix of its seeded epochs: whole epochs, then a prefix in tokens of one
more epoch, whose order is the hash of seed, epoch and doc_id.

A prefix is found without ordering a leaf in one task: tokens are summed for 256 ranges of the hash, then for 256 ranges within the range
where the budget ends, and only documents of that last range are ordered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import dealt, identity, words, written


@dataclass(frozen=True)
class Level:
    """A level of the tree: its name, what a document belongs to, the weights (whole numbers) of names and of all others."""

    name: str
    value: Column
    weights: Mapping[str, int]
    other: int = 0


def share(nodes: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """nodes(parents..., child, weight, capacity, given) with `budget`: given (the parents' budget) shared among the children by weight, up to capacity.

    In the order of capacity per weight a child is full if its capacity is no more than its share of what the full ones before it leave.
    The first that isn't full sets the level for all behind it.
    """
    use = nodes.where("weight > 0")
    by = Window.partitionBy(*parents)
    order = by.orderBy(F.col("capacity") / F.col("weight"), child)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w_before, c_before = F.coalesce(F.sum("weight").over(before), F.lit(0)), F.coalesce(F.sum("capacity").over(before), F.lit(0))
    level = (F.col("given") - c_before) / (F.sum("weight").over(by) - w_before)
    use = use.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    use = use.withColumn("full", F.col("capacity") <= F.col("weight") * F.col("level"))
    water = F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(by)["level"]
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(F.col("weight") * water))
    return use.select(*parents, child, F.least("capacity", F.greatest(budget.cast("long"), F.lit(0))).alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[Level], per_cent: int, epochs: int) -> DataFrame:
    """leaves(level names..., tokens) with each leaf's `budget` in tokens. The whole budget is per_cent of all tokens."""
    names = [x.name for x in levels]
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).select(F.floor(F.col("t") * per_cent / 100).cast("long").alias("given"))
    given = total
    for depth, level in enumerate(levels):
        weight = F.lit(level.other)
        for name, w in level.weights.items():
            weight = F.when(F.col(level.name) == name, w).otherwise(weight)
        path = names[: depth + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("own"))
        # what a node can use is what its usable children can: leaves of weight 0 count for nothing
        nodes = nodes.join(usable(leaves, levels, depth, epochs), path, "left").select(*path, F.coalesce("capacity", F.lit(0)).alias("capacity"), weight.alias("weight"))
        nodes = nodes.join(given, path[:-1]) if depth else nodes.crossJoin(F.broadcast(given))  # one row
        given = written(share(nodes, path[:-1], path[-1]).withColumnRenamed("budget", "given"), "budgets")
    return leaves.join(given.withColumnRenamed("given", "budget"), names, "left").select(*names, "tokens", F.coalesce("budget", F.lit(0)).alias("budget"))


def usable(leaves: DataFrame, levels: Sequence[Level], depth: int, epochs: int) -> DataFrame:
    """(path..., capacity) of the nodes at depth: tokens times epochs of the leaves below that no weight of 0 shuts off."""
    good = F.lit(True)
    for x in levels[depth + 1 :]:
        w = F.lit(x.other)
        for name, v in x.weights.items():
            w = F.when(F.col(x.name) == name, v).otherwise(w)
        good = good & (w > 0)
    return leaves.where(good).groupBy(*(x.name for x in levels[: depth + 1])).agg((F.sum("tokens") * epochs).cast("long").alias("capacity"))


def row_hash(levels: Sequence[Level]) -> Column:
    """Rows of one hash have the same doc_id, text and leaf."""
    return identity(F.struct("doc_id", "text", *(F.coalesce(x.value, F.lit("")).alias(f"level{k}") for k, x in enumerate(levels))))


def plan(docs: DataFrame, levels: Sequence[Level], per_cent: int = 80, epochs: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, the level names, n_tokens, copies, and row (row_hash) of each row of docs(doc_id, text, ...).

    copies is how often the document is taken, 0 for left out. Tokens are words. Null level values count as ''. A document without
    tokens is taken never. Rows equal in doc_id, text and leaf get the same copies if they are not parted by the end of a budget; else some get one more. The order within an epoch is
    by hash, then row. An empty table gives none.
    """
    names = [x.name for x in levels]
    own = docs.select("doc_id", *(F.coalesce(x.value, F.lit("")).alias(x.name) for x in levels), F.size(words(F.col("text"))).cast("long").alias("n_tokens"), row_hash(levels).alias("row"))
    own = written(own, "tokens")
    leaves = written(own.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    allotted = budgets(leaves, levels, per_cent, epochs).where("budget > 0")
    allotted = written(allotted.select(*names, F.floor(F.col("budget") / F.col("tokens")).cast("long").alias("whole"), (F.col("budget") % F.col("tokens")).alias("left")), "allotted")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("doc_id").cast("string")))
    taken = own.where("n_tokens > 0").join(allotted, names).withColumn("key", key)
    taken = taken.withColumns({"b1": F.substring("key", 1, 2), "b2": F.substring("key", 3, 2)})

    def cut(rows: DataFrame, bucket: str, base: Column) -> DataFrame:
        """(names..., edge, start): the range of bucket where left ends and the tokens before it; no row where all fit."""
        sums = rows.groupBy(*names, bucket, "left", base.alias("base")).agg(F.sum("n_tokens").alias("t"))
        upto = F.col("base") + F.sum("t").over(Window.partitionBy(*names).orderBy(bucket))
        sums = sums.withColumn("upto", upto).where("upto > left")
        return sums.groupBy(*names).agg(F.min(F.struct(F.col(bucket).alias("edge"), (F.col("upto") - F.col("t")).alias("start"))).alias("e")).select(*names, "e.edge", "e.start")

    first = written(cut(taken, "b1", F.lit(0).cast("long")), "edges").toDF(*names, "edge1", "start1")
    rows = taken.join(first, names, "left")
    inner = rows.where("b1 = edge1")
    second = written(cut(inner, "b2", F.col("start1")), "edges").toDF(*names, "edge2", "start2")
    last = inner.join(second, names).where("b2 = edge2")
    upto = F.col("start2") + F.sum("n_tokens").over(Window.partitionBy(*names).orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0))
    fits = last.withColumn("fits", (upto <= F.col("left")).cast("long")).select("doc_id", *names, "n_tokens", (F.col("whole") + F.col("fits")).alias("copies"), "row")
    clear = rows.join(second, names, "left").where("edge1 IS NULL OR b1 <> edge1 OR edge2 IS NULL OR b2 <> edge2")
    before = (F.col("edge1").isNull()) | (F.col("b1") < F.col("edge1")) | ((F.col("b1") == F.col("edge1")) & (F.col("edge2").isNull() | (F.col("b2") < F.col("edge2"))))
    clear = clear.select("doc_id", *names, "n_tokens", (F.col("whole") + before.cast("long")).alias("copies"), "row")
    none = own.where("n_tokens = 0").unionByName(own.where("n_tokens > 0").join(allotted, names, "left_anti"))
    none = none.select("doc_id", *names, "n_tokens", F.lit(0).cast("long").alias("copies"), "row")
    return fits.unionByName(clear).unionByName(none)


def mix(docs: DataFrame, levels: Sequence[Level], per_cent: int = 80, epochs: int = 2, seed: int = 0) -> DataFrame:
    """docs, each row as often as plan() takes it; columns are docs'.

    Rows that plan() cannot tell apart (equal in doc_id, text and leaf) share the copies of all of them; where these don't divide, those with the least hash of all
    columns get one more. Null doc_ids, texts and level values are as in plan(); null and wordless texts go. An empty table gives none.
    """
    taken = plan(docs, levels, per_cent, epochs, seed).groupBy("row").agg(F.sum("copies").alias("sum"), F.count("*").alias("n"))
    found = written(taken.where("sum > 0"), "copies")
    own = docs.select(F.struct("*").alias("doc"), row_hash(levels).alias("own"), F.xxhash64(*docs.columns).alias("order"))
    out = own.join(dealt(found), F.col("own") == F.col("row"))
    place = F.row_number().over(Window.partitionBy("row").orderBy("order"))
    copies = F.floor(F.col("sum") / F.col("n")) + (F.col("place") <= F.col("sum") % F.col("n")).cast("long")
    out = out.withColumn("place", place).withColumn("copies", copies).where("copies > 0")
    return out.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")
