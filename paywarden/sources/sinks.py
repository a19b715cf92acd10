"""Table sinks and incremental publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_counted(df: DataFrame, path: str, **options) -> int:
    """Overwrite a parquet table and return the rows written, counted by the write job itself."""
    seen = Observation("rows_written")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").options(**options).parquet(path)
    return seen.get["n"]


def write_clustered(df: DataFrame, path: str, by: str, tie: str) -> None:
    """Overwrite a table laid out in ranges of ``by`` so that file min/max statistics prune scans.

    The tie column takes part in the range bounds, so one hot value is spread over several files.
    """
    df.repartitionByRange(by, tie).sortWithinPartitions(by, tie).write.mode("overwrite").parquet(path)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows plus the incoming rows whose key is not there yet; equal incoming keys collapse."""
    fresh = incoming.dropDuplicates([key]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh)


def load_if_empty(target: DataFrame, incoming: DataFrame, key: str, force: bool = False) -> DataFrame:
    """The whole load is skipped when the target already holds rows, unless forced."""
    if not force and not target.isEmpty():
        return target
    return insert_if_absent(target, incoming, key)


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def publish_snapshot(df: DataFrame, path: str, key: str) -> int:
    """Full-snapshot copy keyed by ``key``.

    The key is checked on the written copy, which reads one column instead of running the plan again;
    a repeated key raises, so the caller never points readers at that folder.
    """
    rows = write_counted(df, path)
    spark = df.sparkSession
    published = spark.read.schema(df.schema).parquet(path)
    if not duplicate_keys(published, key).isEmpty():
        raise ValueError(f"duplicate {key} in snapshot {path}")
    return rows


def typed(rows: DataFrame, ddl: str) -> DataFrame:
    """Text columns as the types of a DDL schema; ISO text becomes a date."""
    return rows.select(*[
        (F.to_date(f.name, "yyyy-MM-dd") if f.dataType == T.DateType() else F.col(f.name).cast(f.dataType)).alias(f.name)
        for f in T.StructType.fromDDL(ddl).fields])


def optional_table(spark: SparkSession, name: str, schema) -> DataFrame:
    """The named table, or an empty relation of the expected schema when it has not been built yet."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], df.schema)


def upsert_by_key(stored: DataFrame, incoming: DataFrame, key: str, content: str, derived: str, touched: str,
                  now: Column) -> DataFrame:
    """Insert or update by key.

    A changed ``content`` clears the ``derived`` column (it has to be computed again) and moves
    ``touched`` forward; unchanged content keeps both.
    """
    s, i = stored.alias("s"), incoming.alias("i")
    joined = s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full_outer")
    is_stored, is_incoming = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    changed = is_incoming & ~F.col(f"s.{content}").eqNullSafe(F.col(f"i.{content}"))
    out = []
    for name in stored.columns:
        if name == key:
            c = F.coalesce(F.col(f"s.{key}"), F.col(f"i.{key}"))
        elif name == derived:
            c = F.when(is_stored & ~changed, F.col(f"s.{name}"))
        elif name == touched:
            c = F.when(is_stored & ~changed, F.col(f"s.{name}")).otherwise(now)
        else:
            c = F.when(is_incoming, F.col(f"i.{name}")).otherwise(F.col(f"s.{name}"))
        out.append(c.alias(name))
    return joined.select(*out)
