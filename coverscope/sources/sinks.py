"""Serving tables: partitioned writes by run, replays, retirement, SQL text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverscope.functions.text import sql_literal

_RUN = re.compile(r"[A-Za-z0-9_-]+:[A-Za-z0-9_-]+")


def write_run(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Replaces the runs that df has, and no other: the same write twice leaves the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)


def read_serving(spark: SparkSession, path: str) -> DataFrame:
    """A serving table of any age: columns that older files lack are null."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; Spark's committer makes the whole appear at once or not at all."""
    df.write.mode("overwrite").json(path)


def checked_run_id(run_id: str) -> str:
    if not _RUN.fullmatch(run_id):
        raise ValueError(f"invalid run id: {run_id}")
    return run_id


def without_runs(df: DataFrame, retired: list[str], current: str, run_col: str = "run_id") -> DataFrame:
    """df without runs that are named as superseded; the current one can't be."""
    names = sorted({checked_run_id(x) for x in retired})
    if not names:
        raise ValueError("at least one superseded run is needed")
    if current in names:
        raise ValueError("the current run can't retire itself")
    return df.where(~F.col(run_col).isin(*names))


def sql_script(df: DataFrame, table: str, run_id: str, order: list[str]) -> DataFrame:
    """(value): statements that replace a run's rows of a table, in order. Rendered by partitions; written with write.text. Numbers that aren't finite fail the job."""
    checked_run_id(run_id)
    if not re.fullmatch(r"[a-z_]+", table):
        raise ValueError(f"invalid table: {table}")
    columns = df.columns
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    whole = lambda c, t: F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit(f"a number of {c} isn't finite"))).otherwise(F.col(c)) if t in ("float", "double") else F.col(c)
    shown = [F.coalesce(whole(c, t).cast("string"), F.lit("NULL")) if t in numeric else F.when(F.col(c).isNull(), "NULL").otherwise(F.when(F.col(c), "1").otherwise("0")) if t == "boolean" else sql_literal(F.col(c)) for c, t in df.dtypes]
    insert = F.concat(F.lit(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ("), F.concat_ws(", ", *shown), F.lit(");"))
    head = df.sparkSession.createDataFrame([(f"DELETE FROM {table} WHERE run_id = '{run_id}';",)], "value string")
    return head.unionAll(df.orderBy(*order).select(insert.alias("value")))


def refreshed_script(seed: str, retired: list[str]) -> str:
    """A seed's SQL with the retirement of superseded runs after it; refuses a seed without foreign keys or with other than one run."""
    if "PRAGMA foreign_keys = ON;" not in seed:
        raise ValueError("a seed must turn foreign keys on")
    runs = set(re.findall(r"^-- run: (\S+)$", seed, re.MULTILINE))
    if len(runs) != 1:
        raise ValueError("a seed must be of one run")
    names = sorted({checked_run_id(x) for x in retired})
    if not names or runs & set(names):
        raise ValueError("name superseded runs, but not the seed's own")
    return "\n".join([seed.rstrip(), *(f"DELETE FROM pipeline_runs WHERE run_id = '{x}';" for x in names), ""])


def pinned(spark: SparkSession, path: str, sha256: str) -> bytes:
    """A file's content, if its SHA-256 is the expected one."""
    row = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("h")).first()
    if row is None or row["h"] != sha256.lower():
        raise ValueError("the input isn't the one that was approved")
    return bytes(row["content"])


def upserted_runs(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Runs after a merge, with outcome: inserted, updated, replayed (same input and status), kept, or conflict (same id, other input; the stored row stays).

    Both have the columns of schemas.RUNS; incoming has each run once.
    """
    fields = [c for c in stored.columns if c != "run_id"]
    old, new = stored.select("run_id", F.struct(*fields).alias("o")), incoming.select("run_id", F.struct(*fields).alias("n"))
    both = old.join(new, "run_id", "full")
    outcome = (
        F.when(F.col("n").isNull(), "kept").when(F.col("o").isNull(), "inserted").when(F.col("o.input_fingerprint") != F.col("n.input_fingerprint"), "conflict").when(F.col("o.status") == F.col("n.status"), "replayed").otherwise("updated")
    )
    fixed = ("source", "input_fingerprint", "started_at")
    both = both.withColumn("outcome", outcome)
    pick = lambda c: F.when(F.col("outcome") == "inserted", F.col(f"n.{c}")).when((F.col("outcome") == "updated") & F.lit(c not in fixed), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select("run_id", *[pick(c).alias(c) for c in fields], "outcome")


def snapshot_rows(documents: DataFrame) -> DataFrame:
    """The snapshots of documents that hold one, bare or in an envelope, with the envelope's receipt. documents: snapshot (struct), receipt, and the bare fields."""
    fields = [f.name for f in documents.schema["snapshot"].dataType.fields]
    return documents.select(*[F.coalesce(F.col(f"snapshot.{c}"), F.col(c)).alias(c) for c in fields], "receipt")
