"""Roles and relations that are kept up to date by signed changes.

A statement adds one to the counts of what it shows, and takes one back when it goes; a mark holds as long as its count is above nought. A change appends its signed
counts, in folders by hashed tables of the database, and reads nothing; readers add the changes up, and when there are ``CHANGES`` of them they are merged.
Relations are brought up to date when they are asked for, over all changes since: what is stored of them are the sides (which application writes or reads which table) they
were made from, so that only applications whose side at a touched table is another one are paired anew, with a sign, in the folders of their producers.

A change of statements is given as whole rows: those that go and those that come. A row that goes must have been there. Nulls are treated as in ``flow``.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portolan.operators import flow
from portolan.operators.cooccurrence import pair_counts
from portolan.sources.store import stored

#: Folders by table and by producer; changes that are kept apart before they are merged. Each task that adds a change up writes a file a folder, so that these are fewer by table.
BUCKETS, CHANGES = {"key": 16, "producer": 64}, 16
COUNTS = ("n", "writes", "reads", "wm", "wk", "rm", "rs", "ra", "rk", "tells")
_KEY = ("app_id", "target", "key")
_SCHEMAS = {
    "counts": "change string, app_id bigint, target string, key string, " + ", ".join(f"{c} bigint" for c in COUNTS), "relations": "producer bigint, consumer bigint, n_tables bigint",
    "sides": "key string, app_id bigint, side int", "related": "change string",
}


def bucket(column: str) -> Column:
    """The folder of a value; nulls have one too."""
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS[column])).cast("int").alias("bucket")


def counted(changes: list[tuple[DataFrame, int]]) -> DataFrame:
    """``bucket, app_id, target, key`` and how many statements show each mark, over findings with their signs; rows that come to nothing are gone."""
    rows = reduce(DataFrame.unionByName, [flow.marked(flow.operations(x)).withColumn("sign", F.lit(sign).cast("bigint")) for x, sign in changes])
    writes, reads, measured, strong, ambiguous, known = (F.col(c) for c in ("writes", "reads", "measured", "strong", "ambiguous", "known"))
    marks = {
        "n": F.lit(True), "writes": writes, "reads": reads, "wm": writes & measured, "wk": writes & (known | (F.col("op") == "delete")),
        "rm": reads & measured, "rs": reads & strong, "ra": reads & ambiguous, "rk": reads & known,
        "tells": ~F.col("is_sp") & strong,
    }
    total = rows.groupBy(*_KEY).agg(*[F.sum(F.when(c, F.col("sign")).otherwise(0)).alias(k) for k, c in marks.items()])
    return total.filter(_any(COUNTS)).select(bucket("key"), *_KEY, *COUNTS)


def roles_of(counts: DataFrame) -> DataFrame:
    """``app_id, target, key, role, status, n_reads, n_writes`` of signed counts that hold all changes of their tables. They are dealt by table once, to be added up and to
    tell the table's context; rows of no table by application."""
    alone = F.when(F.col("key").isNull(), F.col("app_id")).alias("_alone")
    dealt = counts.select(*_KEY, *COUNTS, alone).repartition("key", "_alone")
    shown = dealt.groupBy(*_KEY, "_alone").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter(_any(COUNTS))
    shown = shown.select(*_KEY, "_alone", F.col("writes").alias("n_writes"), F.col("reads").alias("n_reads"), *[(F.col(c) > 0).alias(c) for c in COUNTS[3:]])
    told = F.max("tells").over(Window.partitionBy("key", "_alone"))
    return flow._with_role(shown.withColumn("confirmed", F.when(F.col("key").isNotNull(), told)))


def _any(values: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in values])


def _added(tables: list[DataFrame], by: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """The sum of counts; rows that come to nothing are gone."""
    total = reduce(DataFrame.unionByName, tables).groupBy(*by).agg(*[F.sum(c).alias(c) for c in values])
    return total.filter(_any(values))


def _pairs(sides: DataFrame, left: list[Column], right: list[Column], sign: int) -> DataFrame:
    """``producer, consumer, n_tables`` with a sign: how often the k-th condition of ``left`` holds of one application and the k-th of ``right`` of another at a table."""
    def side(conditions: list[Column]) -> DataFrame:
        terms = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(conditions)]), lambda k: k.isNotNull())
        if len(conditions) == 1:
            return sides.filter(conditions[0]).select("key", F.col("app_id").alias("member"))
        return sides.select("key", F.col("app_id").alias("member"), F.explode(terms).alias("term")).select(F.struct("key", "term").alias("key"), "member")

    found = pair_counts(side(left), side(right)).filter("a <> b")
    return found.select(F.col("a").alias("producer"), F.col("b").alias("consumer"), (F.col("n") * sign).alias("n_tables"))


class Maintained:
    """Counts and relations in a folder that all machines share, for one writer at a time.

    A change is one append. All that a merge or new relations need is written elsewhere first; the last step replaces whole folders. Where that step is interrupted, the store is to be
    built anew from all statements.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, name: str, buckets: list[int] | None, schema: str) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, bucket int").parquet(f"{self.path}/{name}")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, bucket int").drop("bucket")
        return (rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket")

    def _replace(self, name: str, rows: DataFrame, by: str, buckets: list[int]) -> None:
        """Replaces ``buckets`` by ``rows``, which are written elsewhere first, where there are any to replace; a bucket that has no rows left gets an empty file."""
        held = rows.withColumn("bucket", bucket(by))
        there = buckets and not self._read(name, buckets, _SCHEMAS[name]).isEmpty()
        held = stored(held) if there else held
        gone = set(buckets) - {r[0] for r in held.select("bucket").distinct().collect()} if there else set()  # BUCKETS at most
        writer = held.repartitionById(BUCKETS[by], "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/{name}")
        for b in sorted(gone):
            held.limit(0).drop("bucket").write.mode("overwrite").parquet(f"{self.path}/{name}/bucket={b}")

    def _changes(self) -> tuple[list[str], list[str]]:
        """Names of the changes, and of those among them that relations know."""
        files = self._read("counts", None, _SCHEMAS["counts"]).inputFiles()
        known = [r[0] for r in self._read("related", None, _SCHEMAS["related"]).collect()]  # CHANGES at most
        names = sorted({m[1] for f in files if (m := re.search(r"/change=([0-9a-f]+)/", f))})
        return names, [x for x in names if x in known]

    def counts(self, buckets: list[int] | None = None) -> DataFrame:
        """Signed counts, a row for each change, application and table."""
        return self._read("counts", buckets, _SCHEMAS["counts"])

    def relations(self) -> DataFrame:
        """``producer, consumer, n_tables``: as ``flow.strong_relations`` of all statements that are there."""
        self.relate()
        return self._read("relations", None, _SCHEMAS["relations"])

    def roles(self) -> DataFrame:
        """As ``flow.portfolio_roles`` of all statements that are there."""
        return roles_of(self.counts()).select("app_id", "target", "key", "role", "status", "n_reads", "n_writes")

    def change(self, gone: DataFrame | None, come: DataFrame | None) -> int:
        """Takes findings back and adds others; the number of tables of the database it touched."""
        if len(self._changes()[0]) >= CHANGES:
            self.merge()
        delta = counted([(x, sign) for x, sign in ((gone, -1), (come, 1)) if x is not None])
        path = f"{self.path}/counts/change={uuid.uuid4().hex}"
        delta.write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema("key string, bucket int").parquet(path).filter("key is not null").select("key").distinct().count()

    def merge(self) -> None:
        """Adds changes up: those that relations know, and the others."""
        names, known = self._changes()
        old, new = uuid.uuid4().hex, uuid.uuid4().hex
        rows = self.counts().withColumn("change", F.when(F.col("change").isin(known), old).otherwise(new))
        held = stored(_added([rows], ("change", *_KEY), COUNTS).withColumn("bucket", bucket("key")))
        held.repartitionById(BUCKETS["key"], "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("change", "bucket").parquet(f"{self.path}/counts")
        self.spark.createDataFrame([(old,)], "change string").write.mode("overwrite").parquet(f"{self.path}/related")

    def relate(self) -> None:
        """Brings relations up to date with the changes since they were last."""
        names, known = self._changes()
        fresh = [x for x in names if x not in known]
        if not fresh:
            return
        writes, reads = (lambda c, bit=bit: F.col(c).bitwiseAND(bit) != 0 for bit in (1, 2))
        sides = lambda counts: stored(flow._sides(roles_of(counts)).select("key", "app_id", "side"))
        if not known:
            now = sides(self.counts().filter("key is not null"))
            self._move(_pairs(now, [writes("side")], [reads("side")], 1))
            self._replace("sides", now, "key", [])
        else:
            keys = stored(self.counts().filter(F.col("change").isin(fresh)).select("key").filter("key is not null").distinct())
            touched = sorted(r[0] for r in keys.select(bucket("key")).distinct().collect())  # BUCKETS at most
            now = sides(self.counts(touched).join(keys, "key", "left_semi"))
            before = self._read("sides", touched, _SCHEMAS["sides"])
            none = lambda c: F.coalesce(c, F.lit(0))
            met = before.join(keys, "key", "left_semi").withColumnRenamed("side", "was").join(now, ["key", "app_id"], "full").select("key", "app_id", none("was").alias("was"), none("side").alias("side"))
            moved = met.filter("was <> side").select("key").distinct()
            met = stored(met.join(moved, "key", "left_semi"))
            came = [writes("side") & ~writes("was"), writes("was")], [reads("side"), reads("side") & ~reads("was")]
            went = [writes("was") & ~writes("side"), writes("was")], [reads("side"), reads("was") & ~reads("side")]
            self._move(_added([_pairs(met, *came, 1), _pairs(met, *went, -1)], ("producer", "consumer"), ("n_tables",)))
            self._replace("sides", before.join(keys, "key", "left_anti").unionByName(now), "key", touched)
        self.spark.createDataFrame([(x,) for x in names], "change string").write.mode("overwrite").parquet(f"{self.path}/related")

    def _move(self, moved: DataFrame) -> None:
        """Adds signed pairs to the relations."""
        there = self._read("relations", None, _SCHEMAS["relations"])
        if there.isEmpty():
            self._replace("relations", moved, "producer", [])
            return
        moved = stored(moved)
        near = sorted(r[0] for r in moved.select(bucket("producer")).distinct().collect())  # BUCKETS at most
        if near:
            self._replace("relations", _added([self._read("relations", near, _SCHEMAS["relations"]), moved], ("producer", "consumer"), ("n_tables",)), "producer", near)


def new_store(spark: SparkSession) -> Maintained:
    """An empty store beside the other stored tables of the session."""
    stored(spark.range(0))  # names the session's shared folder
    return Maintained(spark, f"{spark.sparkContext.getCheckpointDir()}/maintained-{uuid.uuid4().hex}")
