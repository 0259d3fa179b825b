"""Mixing sources to target weights: documents in hash-random order within their source, distributed running sums of their words,
and a cut where each source's budget is spent; a budget above the source's size repeats whole passes first.

Every source's budget is its share of all words by its weight, at most ``most`` times its own size; what stays above goes to the others by
weight again. Such repeated sharing ends at one level of words a weight, which is found from running sums over the sources in the order of
the level at which they fill up, so that nothing is iterated and no list of sources reaches the driver.

Nulls: a null text has no words, a null source is a source of its own (the last), a null id is hashed as empty. Repeated rows are documents of
their own; equal rows may change places, which changes no result. An empty table gives none; a source without words has the target 0.
Columns beyond ``doc_id, text, source`` are not read by ``shares``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.ordered import running_sums
from portolan.llm.textio import written

_WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to this number are broadcast (some hundred bytes each); more of them are joined by shuffles.
_FEW = 20_000


def words(text: Column) -> Column:
    """The number of words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], most: int, total: int | None = None) -> DataFrame:
    """``source, source_size, target`` of ``sources`` (source, source_size): weights repeat over the sources by code point, null last.

    ``total``: the words to share, those of all sources where it is None; above ``most`` times these all targets stop there.
    """
    ranked = running_sums(sources.withColumn("_null", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1).cast("long")), ["_null", "source"], [], ["one"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("one_before") % len(weights) + 1).cast("int")).cast("long")
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") / weight).alias("fills_at"))
    sums = running_sums(weighed, ["fills_at", "source"], [], ["source_size", "weight"])
    all_of = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("all_size"))  # one row
    weigh = weighed.agg(F.sum("weight").alias("all_weight"))  # one row
    whole = F.lit(total).cast("long") if total is not None else F.col("all_size")
    exact = lambda c: c.cast("decimal(19,0)")
    left, rest = whole - most * F.col("source_size_before"), F.col("all_weight") - F.col("weight_before")
    full = exact(most * F.col("source_size")) * exact(rest) < exact(left) * exact(F.col("weight"))
    judged = written(sums.crossJoin(all_of).crossJoin(weigh).withColumn("full", full).withColumn("left", whole))
    level = judged.filter("full").agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("full_size"), F.coalesce(F.sum("weight"), F.lit(0)).alias("full_weight"))  # one row
    share = F.col("weight") * (F.col("left") - most * F.col("full_size")).cast("double") / (F.col("all_weight") - F.col("full_weight"))
    limit = (most * F.col("source_size")).cast("double")
    return judged.crossJoin(level).select("source", "source_size", F.when(F.col("full"), limit).otherwise(F.least(limit, share)).alias("target"))


def shares(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, total: int | None = None, seed: str = "") -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, passes`` for each document: ``taken`` of its words are in the mix, ``passes``
    whole passes and then as many of its first words as the budget (the target to the nearest word) leaves."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))))
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("key")))
    aims = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most, total))
    ranked = running_sums(sized, ["source", "key", "doc_id"], ["source"], ["size"])
    few = aims.count() <= _FEW
    aims = aims.withColumnRenamed("source", "_source")
    joined = ranked.join(F.broadcast(aims) if few else aims, F.col("source").eqNullSafe(F.col("_source")))
    budget = F.floor(F.col("target") + 0.5)
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - F.col("passes") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("size_before")))
    joined = joined.withColumn("budget", budget.cast("long")).withColumn("passes", passes)
    return joined.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"), "passes")


def mixed(docs: DataFrame, **how: object) -> DataFrame:
    """``doc_id, source, pass, text``: the texts of the mix (``shares`` with ``how``), a row for each pass; a last one that ends within its text has its
    first words, joined by blanks.

    Repeated ids: each of an id's rows goes through the passes of one of them, the one that takes the most.
    """
    taken = shares(docs, **how).groupBy(F.col("doc_id").alias("_id")).agg(F.max("taken").alias("_taken"))  # type: ignore[arg-type]
    held = docs.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))).filter("_taken > 0")
    size = words(F.col("text"))
    times = held.withColumn("_n", size).withColumn("pass", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("_taken") / size))))
    left = (F.col("_taken") - (F.col("pass") - 1) * F.col("_n")).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lit(1), left), " ")
    return times.select("doc_id", "source", "pass", F.when(left >= F.col("_n"), F.col("text")).otherwise(head).alias("text"))
