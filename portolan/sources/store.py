"""Snapshots of analyses in Parquet: stable identities, replacement per application, curated rows that survive."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stored(frame: DataFrame) -> DataFrame:
    """``frame`` written once to the folder that all machines share (``spark.checkpoint.dir``) and read from there, for what is used several times.

    Where that setting is missing, a session of one machine takes a temporary folder; on a cluster it is an error.
    """
    spark = frame.sparkSession
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="portolan-store-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    path = f"{folder}/stored-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def grown(frame: DataFrame) -> DataFrame:
    """``frame`` as a side of a join that is never broadcast. Spark takes a table's size from its files, and source text that is rendered, stored compressed or read in
    Python has many times that in rows; by such figures Spark sends millions of rows through the driver."""
    return frame.hint("merge")


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The applications after ``new`` was analysed: ``app_id, app_name, source_path, review_status, state``.

    A new row takes the identity of the old one with its path, else with its name, and then keeps that one's id, name and review;
    others are added with ids above all old ones. Old rows that weren't analysed again stay.
    """
    by_path = old.filter("source_path is not null").groupBy(F.col("source_path").alias("p")).agg(F.min("app_id").alias("id_by_path"))
    by_name = old.groupBy(F.col("app_name").alias("n")).agg(F.min("app_id").alias("id_by_name"))
    met = new.join(by_path, F.col("source_path") == F.col("p"), "left").join(by_name, F.col("app_name") == F.col("n"), "left")
    met = met.withColumn("found", F.coalesce("id_by_path", "id_by_name"))
    kept = old.select(F.col("app_id").alias("found"), F.col("app_name").alias("old_name"), F.col("review_status").alias("old_review"))
    known = met.filter("found is not null").join(kept, "found")
    known = known.groupBy(F.col("found").alias("app_id")).agg(F.max(F.struct("source_path", "app_name", "old_name", "old_review")).alias("x"))
    known = known.select("app_id", F.col("x.old_name").alias("app_name"), F.col("x.source_path").alias("source_path"), F.col("x.old_review").alias("review_status"), F.lit("updated").alias("state"))
    top = old.agg(F.coalesce(F.max("app_id"), F.lit(-1)).alias("top"))
    added = numbered(met.filter("found is null").select("app_name", "source_path"), ["app_name", "source_path"]).crossJoin(F.broadcast(top))  # a single row
    added = added.select((F.col("top") + F.col("place")).alias("app_id"), "app_name", "source_path", F.lit("borrador").alias("review_status"), F.lit("added").alias("state"))
    rest = old.join(known.select("app_id"), "app_id", "left_anti").select("app_id", "app_name", "source_path", "review_status", F.lit("kept").alias("state"))
    return known.unionByName(added).unionByName(rest)


def numbered(rows: DataFrame, order: list[str], slots: int = 64) -> DataFrame:
    """``rows`` with their place from 1, by hashed slots, each ordered within: no task orders all rows."""
    dealt = rows.withColumn("slot", F.pmod(F.xxhash64(*order), F.lit(slots)))
    before = dealt.groupBy("slot").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    dealt = dealt.withColumn("k", F.row_number().over(Window.partitionBy("slot").orderBy(*order)))
    return dealt.join(F.broadcast(before.select("slot", "before")), "slot").withColumn("place", F.col("before") + F.col("k")).drop("slot", "before", "k")  # ``slots`` rows


def replace_app_rows(rows: DataFrame, path: str) -> None:
    """Writes child rows partitioned by application; only the partitions of applications in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("app_id").parquet(path)


def read_app_rows(spark: SparkSession, path: str, schema: str, app_ids: list[int] | None = None) -> DataFrame:
    """Child rows, of some applications only if given (whole partitions are skipped); columns an old snapshot lacks are null."""
    from pyspark.sql.types import StructType

    found = spark.read.option("mergeSchema", "true").parquet(path)
    wanted = StructType.fromDDL(schema)
    out = found.select(*[F.col(f.name).cast(f.dataType) if f.name in found.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])
    return out if app_ids is None else out.filter(F.col("app_id").isin(app_ids))


#: States of a review, of a finding, and severities; fixed values.
REVIEW_STATUSES, FINDING_STATUSES, SEVERITIES = ("borrador", "logica_revisada", "listo_para_migrar", "obsoleta"), ("abierto", "en_progreso", "resuelto", "descartado"), ("critica", "alta", "media", "info")


def checked(value: str, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{value!r} isn't one of {', '.join(allowed)}")
    return value


def latest_state(log: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """The last entry per ``key`` of an append-only log of curated changes; ties go to the largest entry."""
    return log.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("x")).select(key, "x.*")


def filled(old: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``old`` with missing ``columns`` taken from ``found``; values that are there stay."""
    new = found.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = old.join(new, F.col(key) == F.col("_k"), "left")
    return out.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in old.columns])
