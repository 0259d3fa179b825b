"""What databases say about objects that findings name, and which connection to believe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a failed connection is called in reports, with the driver's SQLSTATE where it gives one; fixed values.
FAILED, CHECK = "no se pudo conectar", "revisar con infraestructura/DBA"
OBJECT = r"^\[?(\w+)\]?(?:\.\[?(\w+)\]?)?$"
SQL_SERVER, ORACLE = r"(?i)\bServer\s*=|\bUser Id\s*=|\bUid\s*=", r"(?i)Data Source\s*=\s*\(|TNS|Oracle"


def short_error(message: Column) -> Column:
    """A driver's error in short: its state is what stands first in quotes, of messages that begin with a parenthesis."""
    state = F.regexp_extract(message, r"^\([^']*'([^']*)", 1)
    return F.when(state != "", F.concat(F.lit(f"{FAILED} (SQLSTATE "), state, F.lit(f") — {CHECK}"))).otherwise(f"{FAILED} — {CHECK}")


def is_sql_server(connection: Column) -> Column:
    """Whether a connection string names a server or user as SQL Server's do, without signs of Oracle."""
    return connection.rlike(SQL_SERVER) & ~connection.rlike(ORACLE)


def object_name(target: Column) -> Column:
    """struct<schema, name>; dbo where no schema is given; null for what isn't a name."""
    name = F.trim(target)
    first, second = F.regexp_extract(name, OBJECT, 1), F.regexp_extract(name, OBJECT, 2)
    return F.when(name.rlike(OBJECT), F.struct(F.when(second != "", first).otherwise("dbo").alias("schema"), F.when(second != "", second).otherwise(first).alias("name")))


def asked(targets: DataFrame, connections: DataFrame, dead: list[str]) -> DataFrame:
    """Which objects (app_id, target, is_procedure) are asked on which connections (app_id, place, server): distinct whatever the case; dead servers and what isn't a name are left out."""
    objects = targets.withColumn("o", object_name(F.col("target"))).filter("o is not null").groupBy("app_id", "is_procedure", F.lower("o.schema").alias("schema"), F.lower("o.name").alias("name")).agg(F.min("target").alias("target"))
    alive = connections.filter(~F.lower("server").isin([d.lower() for d in dead])) if dead else connections
    return objects.join(alive, "app_id")


def picked(answers: DataFrame) -> DataFrame:
    """The connection each object is taken from (app_id, schema, name, is_procedure, place, n_columns, error): for a procedure the first one
    asked, found or not; for a table the first that gave columns. Errors of all are joined in order."""
    good = F.col("is_procedure") | (F.col("n_columns") > 0)
    errors = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("place", "error")))), lambda x: x["error"]), " | ")
    return answers.groupBy("app_id", "schema", "name", "is_procedure").agg(F.min(F.when(good, F.col("place"))).alias("place"), F.nullif(errors, F.lit("")).alias("errors"))


def counters(objects: DataFrame) -> DataFrame:
    """``app_id, sp_ok, sp_total, tables`` of objects (app_id, is_procedure, status) that databases were asked about."""
    return objects.groupBy("app_id").agg(F.count_if(F.col("is_procedure") & (F.col("status") == "ok")).alias("sp_ok"), F.count_if("is_procedure").alias("sp_total"), F.count_if(~F.col("is_procedure")).alias("tables"))
