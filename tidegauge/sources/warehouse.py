"""Stored tables as Parquet folders: appends that keep the keys, reads, audits.

Spark enforces no constraint. A writer rejects what is stored already (left anti join on the
keys) and doubles within its own input; audits list what breaks a rule all the same."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import TABLES, conform


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The stored rows; none where nothing was ever written."""
    path = f"{root.rstrip('/')}/{table}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], TABLES[table].schema)
    return spark.read.schema(TABLES[table].schema).parquet(path)


def without_doubles(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row for each value of the keys (the least row); rows with a null in them stay."""
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = df.filter(whole).groupBy(*keys).agg(F.min(F.struct(*[c for c in df.columns if c not in keys])).alias("_rest"))
    rest = [F.col(c) if c in keys else F.col(f"_rest.{c}").alias(c) for c in df.columns]
    return first.select(*rest).unionByName(df.filter(~whole))


def new_rows(df: DataFrame, stored: DataFrame, table: str) -> DataFrame:
    """The rows of df that break no key: neither stored yet nor doubled in df."""
    spec = TABLES[table]
    for keys in (spec.key, *spec.unique):
        df = without_doubles(df, keys).join(stored.select(*keys), list(keys), "left_anti").select(*df.columns)
    return df


def append(df: DataFrame, root: str, table: str, now: Column) -> None:
    """Appends the rows of df that break no key."""
    spark = df.sparkSession
    new_rows(conform(df, table, now), read(spark, root, table), table).write.mode("append").parquet(f"{root.rstrip('/')}/{table}")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, value, n): every doubled key, missing value and dangling reference."""
    found = []
    for name, df in tables.items():
        spec = TABLES[name]
        for keys in (spec.key, *spec.unique):
            value = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
            n = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(value.alias("value")).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(n.select(F.lit(name).alias("table_name"), F.lit("unique " + ",".join(keys)).alias("rule"), "value", "n"))
        nulls = [F.when(F.col(c).isNull(), F.lit(c)) for c in spec.required]
        missing = df.select(F.explode(F.array_compact(F.array(*nulls))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
        found.append(missing.select(F.lit(name).alias("table_name"), F.lit("not null").alias("rule"), "value", "n"))
        for column, other in spec.references.items():
            if other in tables:
                keys = tables[other].select(F.col("id").alias(column)).distinct()
                lost = df.filter(F.col(column).isNotNull()).join(keys, column, "left_anti").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
                found.append(lost.select(F.lit(name).alias("table_name"), F.lit(f"{column} in {other}").alias("rule"), "value", "n"))
    return reduce(DataFrame.unionByName, found)
