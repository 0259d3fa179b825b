"""Search by trigrams: which rows may hold a term is read from stored lists, and only these are looked at.

The index has a row for each trigram of a row's lower-cased text, in folders by a hash of the trigram. A term's trigrams name the few folders to be read; keys that have all
of them are joined with the rows, which are then compared as a scan would, so that wildcards and case mean the same. A term without three plain characters in a row is searched by the scan.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.sources.store import stored

FOLDERS, SHARES = 64, 8


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text, found in one pass."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


class TrigramIndex:
    """``key`` and trigrams of a column, in a folder that all machines share. Null texts aren't in it; a key may repeat, and then stands for all its rows."""

    def __init__(self, spark: SparkSession, path: str, key: str, column: str) -> None:
        self.spark, self.path, self.key, self.column = spark, path, key, column

    @classmethod
    def build(cls, rows: DataFrame, key: str, column: str, path: str | None = None) -> TrigramIndex:
        spark = rows.sparkSession
        if path is None:
            stored(spark.range(0))  # names the session's shared folder
            path = f"{spark.sparkContext.getCheckpointDir()}/trigrams-{uuid.uuid4().hex}"
        grams = rows.filter(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.explode(trigrams(F.col(column))).alias("gram"))
        dealt = grams.withColumns({"folder": _folder(F.col("gram")), "_share": F.pmod(F.xxhash64("key"), F.lit(SHARES))})  # a common trigram's rows go to several tasks
        parts = max(1, min(FOLDERS * SHARES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt.repartition(parts, "folder", "_share").sortWithinPartitions("folder", "gram", "key").drop("_share").write.option("compression", "zstd").partitionBy("folder").parquet(path)
        return cls(spark, path, key, column)

    def grams_of(self, term: str) -> list[str]:
        """The trigrams that a text with ``term`` must have: those of its pieces between wildcards."""
        pieces = [(p,) for p in re.split(r"[%_]|\\.", term) if len(p) >= 3]
        if not pieces:
            return []
        found = self.spark.createDataFrame(pieces, "p string").select(F.explode(trigrams(F.col("p"))).alias("g")).distinct()
        return sorted(r[0] for r in found.collect())  # as many as the term has characters

    def candidates(self, grams: list[str]) -> DataFrame:
        """Keys that have all of ``grams``; only their folders are read."""
        wanted = self.spark.createDataFrame([(g,) for g in grams], "g string").select("g", _folder(F.col("g")).alias("f")).collect()
        rows = self.spark.read.parquet(self.path).filter(F.col("folder").isin(sorted({r.f for r in wanted})) & F.col("gram").isin([r.g for r in wanted]))
        return rows.groupBy("key").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("key")

    def search(self, rows: DataFrame, term: str) -> DataFrame:
        """The rows (those that were indexed) whose column has ``term`` in it; letters in either case, % and _ as wildcards."""
        grams = self.grams_of(term)
        near = rows.join(self.candidates(grams), F.col(self.key).eqNullSafe(F.col("key")), "left_semi") if grams else rows
        return near.filter(F.col(self.column).ilike(f"%{term}%"))
