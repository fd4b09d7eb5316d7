"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset a local session gets a folder of its own
    beside its warehouse; on a cluster there is no place to guess, so it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tidemark-tables"


#: Most rows, and about the most bytes, of a batch that Python works on at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of the batches that go to Python to BATCH_ROWS and BATCH_BYTES, unless they are lower.

    Results are computed after an operator returns, so the limits stay; every operator with Python sets them, so memory
    does not depend on which one ran before.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none holds much more than BATCH_BYTES or more than BATCH_ROWS rows, however the session
    sets Arrow's batches."""
    for b in batches:
        parts = max(-(-b.num_rows // BATCH_ROWS), min(b.num_rows, -(-b.nbytes // BATCH_BYTES)), 1)
        rows = -(-b.num_rows // parts)
        for k in range(0, b.num_rows, max(1, rows)):
            yield b.slice(k, rows)
    pa.default_memory_pool().release_unused()  # the worker waits for other tasks, and must not hold what this one took


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more."""
    if path := getattr(df, "_written_to", None):
        _delete(df.sparkSession, path)


#: Tables written in each scratch() that is open, the innermost last.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that materialize() writes inside are deleted at its end, but for those given to the function it yields."""
    made: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._written_to)
        return df

    _SCRATCH.append(made)
    try:
        yield keep
    finally:
        _SCRATCH.remove(made)
        for path in made:
            if path not in kept:
                _delete(spark, path)
            elif _SCRATCH:
                _SCRATCH[-1].append(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Array of words; null text has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once per row, not once per use inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(value: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of MD5; DuckDB computes the same one."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def distributed_rank(df: DataFrame, group: list[str], order: list[Column], label: str) -> DataFrame:
    """Adds rank_in_group (1-based, by `order`) without ever bringing a group into one task.

    Rows are range-partitioned by (group, order), so a hot group spreads over many partitions; each partition
    numbers its own rows and a table of a row for each (partition, group) carries the offsets.
    """
    keys = [F.col(g) for g in group]
    parts = shuffle_parts(df.sparkSession)
    ranged = materialize(df.repartitionByRange(parts, *keys, *order).withColumn("__pid", F.spark_partition_id()), label)
    before = Window.partitionBy(*group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("__pid", *group)
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy("__pid", *group).orderBy(*order))
    return (
        ranged.withColumn("__local", local)
        .join(offsets, ["__pid", *group])
        .withColumn("rank_in_group", F.col("__local") + F.col("__before"))
        .drop("__pid", "__local", "__before")
    )


def column(name: str) -> Column:
    """The column of exactly this name, also where it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, or name with marks before it where df has a column called so."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def row_keys(docs: DataFrame, id_col: str, text_col: str, key: str = "key") -> tuple[DataFrame, DataFrame | None]:
    """(docs with a bigint key, key -> id). Rows share a key only if both their id and their text are equal; keys are in
    the order of the ids, null last.

    Where ids repeat or are null the key is the rank of (id, 128 bits of the text); else it is the id itself, and there
    is no second table. key must be no column of docs; other columns may have any name.
    """
    id_ = column(id_col).cast("long")
    seen = docs.select(id_.alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if seen.where("n > 1 or id is null").isEmpty():
        return docs.withColumn(key, id_), None
    parts = [fresh(docs, f"__rk_{x}") for x in ("null", "id", "a", "b")]
    digest = F.md5(F.coalesce(F.concat(F.lit("t"), column(text_col).cast("string")), F.lit("")).cast("binary"))
    keyed = docs.withColumns(dict(zip(parts, [id_.isNull().cast("int"), F.coalesce(id_, F.lit(0)), F.substring(digest, 1, 16), F.substring(digest, 17, 16)], strict=True)))
    ranks = distributed_rank(keyed.select(*parts).distinct(), [], [F.col(p) for p in parts], "row-keys").select(*parts, F.col("rank_in_group").cast("long").alias(key))
    ranks = materialize(ranks, "row-keys")
    return keyed.join(ranks, parts).select(*map(column, docs.columns), key), ranks.select(key, F.when(F.col(parts[0]) == 0, F.col(parts[1])).alias("id"))
