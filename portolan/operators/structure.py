"""Relational parts of program structure: methods with findings, callers one hop away, paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portolan.functions.sqltext import table_key


def ends_with_path(path: Column, suffix: Column) -> Column:
    """Whether the last parts of ``path`` are the parts of ``suffix``."""
    parts, tail = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.split(F.replace(suffix, F.lit("\\"), F.lit("/")), "/")
    return (F.size(parts) >= F.size(tail)) & (F.slice(parts, F.greatest(F.size(parts) - F.size(tail) + 1, F.lit(1)), F.size(tail)) == tail)


def path_tails(path: Column) -> Column:
    """Every path that ``path`` ends with (``ends_with_path``), so that paths and suffixes can be joined by equal values."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def findings_by_method(methods: DataFrame, findings: DataFrame, method_id: str, finding_id: str) -> DataFrame:
    """``method_id, n_findings, first_finding``: how many findings (class_name, method, suffix, more) each method (class_name, method, path, more) has and the
    smallest of them, where its path ends with theirs. Findings are counted by class, method and suffix before they meet the methods, so that what is joined grows
    with the rows and not with their pairs."""
    told = findings.groupBy("class_name", "method", F.replace("suffix", F.lit("\\"), F.lit("/")).alias("_tail")).agg(F.count(F.lit(1)).alias("n"), F.min(finding_id).alias("first"))
    asked = methods.select("class_name", "method", method_id, F.explode(path_tails(F.col("path"))).alias("_tail"))
    return asked.join(told, ["class_name", "method", "_tail"]).groupBy(method_id).agg(F.sum("n").alias("n_findings"), F.min("first").alias("first_finding"))


def method_operations(methods: DataFrame, findings: DataFrame) -> DataFrame:
    """Methods (class_name, method, signature, path) with the findings (class_name, method, file, operation, target) in
    them: ``status`` is resolved where a single signature has the name in its file, else ambiguous."""
    one = methods.groupBy("class_name", "method", "path").agg(F.count_distinct("signature").alias("n"))
    met = one.join(findings, ["class_name", "method"]).filter(ends_with_path(F.col("path"), F.col("file")))
    met = met.filter("operation is not null or target is not null")
    return met.select("class_name", "method", "path", "operation", "target", F.when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, 90).otherwise(30).alias("confidence"))


def one_hop_callers(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """Operations that a caller reaches through one resolved call in its class; a row for each call and operation."""
    rows = calls.filter("resolution_status = 'resolved'").select("class_name", "caller", "target_method")
    return rows.join(direct.select("class_name", F.col("method").alias("target_method"), "operation"), ["class_name", "target_method"])


def one_hop_counts(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """``caller, n_operations, first_operation``: the number of ``one_hop_callers`` rows of each caller and the smallest operation. Operations are counted by
    class and method before they meet the calls, so that no call is joined with each of them."""
    told = direct.groupBy("class_name", "method").agg(F.count(F.lit(1)).alias("n"), F.min("operation").alias("operation"))
    met = one_hop_callers(calls, told.select("class_name", "method", F.struct("n", "operation").alias("operation")))
    return met.groupBy("caller").agg(F.sum("operation.n").alias("n_operations"), F.min("operation.operation").alias("first_operation"))


def with_roles(operations: DataFrame, roles: DataFrame) -> DataFrame:
    """Operations (app_id, target, …) with the role the application has at the target's table (``flow.key_roles``: one row per application and
    key, whatever the spellings); indeterminado where it has none."""
    of = roles.select("app_id", "key", "role")
    return operations.withColumn("key", table_key(F.col("target"))).join(of, ["app_id", "key"], "left").withColumn("role", F.coalesce("role", F.lit("indeterminado")))


def running_depth(rows: DataFrame, by: str, order: str, step: Column, mark: Column) -> DataFrame:
    """``rows`` with ``depth``, the sum of ``step`` up to each in its ``by``, and ``last_mark``, the last ``order`` where ``mark`` held."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"depth": F.sum(step).over(upto), "last_mark": F.last(F.when(mark, F.col(order)), ignorenulls=True).over(upto)})
