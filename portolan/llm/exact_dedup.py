"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

A document's digest is the SHA-256 of its text; a second, independent 64-bit hash goes with it and is part of the key at
every merge, so that entries are only merged where both agree (verified).

Up the tree: documents are dealt to ``fan_in ** rounds`` runs by a hash of their id, at least two rounds and as many as make runs of about
``RUN_ROWS`` rows. Each run is sorted by digest (the
aggregate of a struct is a sorted aggregation: sort, combine, exchange, merge) and merged into (id that stays, rows) per
digest. In every round ``fan_in`` runs meet and are merged the same way, so that a text with a third of all rows has
at most ``fan_in`` entries in a merge beyond the first, which combines rows where they are read. Down the tree: each run's entries
get the decision of the run they went into, and documents that of their own run; no join has more than ``fan_in``
entries, or one run's share of a text's copies, for a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.llm.textio import written

FAN_IN, RUN_ROWS = 16, 250_000
_KEY = ["run", "digest", "proof"]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """The decision on each row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep``: "max" or "min", which id of equal texts stays. Null texts count as empty. A null id stays only where its
    group has no other; then one of its rows does. Of rows that repeat id and text one stays. An empty table gives an
    empty result. Other columns of ``docs`` aren't looked at and may have any name.
    """
    decided = _decided(docs, id_col, text_col, keep, fan_in, rounds)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    place = F.row_number().over(Window.partitionBy(*_KEY).orderBy(stays.desc()))
    decided = decided.withColumn("kept", stays & (place == 1))
    return decided.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns as they are; see ``exact_groups``.

    What stays is decided on keys alone; then the rows meet their keys once. Only where an id repeats its text are rows compared with each other.
    """
    decided = _decided(docs, id_col, text_col, keep, fan_in, rounds).filter(F.col("id").eqNullSafe(F.col("keep_id")))
    stays = written(decided.groupBy(F.col("id").alias("_id"), F.col("digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_times")))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("_i"), F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256).alias("_d"))
    of = lambda keys: row.join(keys, F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_d") == F.col("_digest")))
    if stays.filter("_times > 1").isEmpty():
        return of(stays).select("row.*")
    repeated = of(stays.filter("_times > 1")).withColumn("_place", F.row_number().over(Window.partitionBy("_d", "_i").orderBy(F.lit(0)))).filter("_place = 1")
    return of(stays.filter("_times = 1")).select("row").unionByName(repeated.select("row")).select("row.*")


def _decided(docs: DataFrame, id_col: str, text_col: str, keep: str, fan_in: int, rounds: int | None) -> DataFrame:
    rounds = rounds_for(docs.count(), fan_in) if rounds is None else rounds
    best = {"max": F.max, "min": F.min}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(fan_in**rounds)).alias("run"),
        F.sha2(text, 256).alias("digest"),
        F.xxhash64(text).alias("proof"),
        F.col(id_col).alias("id"),
    )
    null_last = F.col("id").isNotNull() if keep == "max" else F.col("id").isNull()
    levels = [rows.groupBy(*_KEY).agg(best(F.struct(null_last.alias("rank"), "id")).alias("top"), F.count(F.lit(1)).alias("n"))]
    for _ in range(rounds):
        met = levels[-1].withColumn("run", _above(F.col("run"), fan_in))
        levels.append(met.groupBy(*_KEY).agg(best("top").alias("top"), F.sum("n").alias("n")))

    decision = levels.pop().select(*_KEY, F.col("top.id").alias("keep_id"), F.col("n").alias("group_size"))
    while levels:
        lower = levels.pop().select(*_KEY, _above(F.col("run"), fan_in).alias("up"))
        decision = lower.join(decision.withColumnRenamed("run", "up"), ["up", "digest", "proof"]).select(*_KEY, "keep_id", "group_size")
    return rows.join(decision, _KEY)


def rounds_for(rows: int, fan_in: int = FAN_IN) -> int:
    """The rounds of the tree for so many rows."""
    rounds = 2
    while fan_in**rounds * RUN_ROWS < rows:
        rounds += 1
    return rounds


def _above(run: Column, fan_in: int) -> Column:
    return F.floor(run / fan_in).cast("bigint")
