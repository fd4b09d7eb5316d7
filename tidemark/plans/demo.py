"""The driver's tables read as entries, logs, graph text and session records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import DAY
from ..schema import KINDS, LOG

BASE = 1_700_000_000_000
NOW = BASE + 400 * DAY
#: After every entry, whatever the table holds: what the SQL of the graph calls active was never made invalid.
LAST = (1 << 63) - 1
#: Moments in the month of the events table.
T1, T2 = 1_704_067_200_000 + 10 * DAY, 1_704_067_200_000 + 20 * DAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (i % 5 + 1).cast("int"))
    made = i * 3_600_000 + BASE
    newer = F.when(i % 11 == 0, F.array(F.concat(F.lit("superseded-by:m-"), (i + 1).cast("string")))).otherwise(F.array().cast("array<string>"))
    return d.select(
        F.concat(F.lit("m-"), i.cast("string")).alias("id"), kind.alias("kind"), F.col("text").alias("content"), F.concat(F.array("lang", "source"), newer).alias("tags"), F.when(i % 2 == 0, "explicit").otherwise("auto").alias("source"),
        F.lit(None).cast("string").alias("session_id"), F.when(i % 3 > 0, F.concat(F.lit("w"), (i % 3).cast("string"))).alias("workspace"), made.alias("created_at"), made.alias("updated_at"), (i % 7).alias("access_count"),
        F.when(i % 7 > 0, made + DAY).alias("last_access_at"),
    )


ENTRIES_SQL = f"""entries AS (
  SELECT 'm-' || doc_id AS id, ['decision', 'fact', 'preference', 'instruction', 'generic'][(doc_id % 5 + 1)::INT] AS kind, text AS content,
         list_concat([lang, source], CASE WHEN doc_id % 11 = 0 THEN ['superseded-by:m-' || (doc_id + 1)] ELSE []::VARCHAR[] END) AS tags,
         CASE WHEN doc_id % 2 = 0 THEN 'explicit' ELSE 'auto' END AS source,
         CASE WHEN doc_id % 3 > 0 THEN 'w' || (doc_id % 3) END AS workspace,
         doc_id * 3600000 + {BASE} AS created_at, doc_id * 3600000 + {BASE} AS updated_at, doc_id % 7 AS access_count,
         CASE WHEN doc_id % 7 > 0 THEN doc_id * 3600000 + {BASE} + {DAY} END AS last_access_at,
         doc_id % 11 = 0 AS superseded
  FROM documents)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as operations on their users: errors delete, views only move the accesses, the others write."""
    e = table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    gone = F.col("event_type") == "error"
    heat = F.col("event_type") == "view"
    cols = {
        "seq": F.col("event_id"), "op": F.when(gone, "T").otherwise("E"), "id": F.concat(F.lit("u"), F.col("user_id").cast("string")), "kind": F.lit("fact"),
        "content": F.concat(F.lit("bought for "), (F.floor(F.col("value") / 50)).cast("string")), "tags": F.array(F.lit("event")), "source": F.lit("auto"), "created_at": F.lit(BASE).cast("long"),
        "updated_at": F.when(heat, ms - 1000).otherwise(ms), "access_count": F.when(heat, 1).otherwise(0).cast("long"), "last_access_at": F.when(heat, ms), "at": F.when(gone, ms),
    }
    rows = e.select(*[v.alias(k) for k, v in cols.items()])
    for f in LOG.fields:
        if f.name not in cols:
            rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    blank = [c for c in ("kind", "content", "tags", "source", "created_at", "updated_at", "access_count", "last_access_at")]
    return rows.withColumns({c: F.when(F.col("op") == "E", F.col(c)) for c in blank}).select(*LOG.fieldNames())


LOG_SQL = f"""log AS (
  SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'T' ELSE 'E' END AS op, 'u' || user_id AS id,
         CASE WHEN event_type <> 'error' THEN 'bought for ' || floor(value / 50)::BIGINT END AS content,
         CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) - 1000 WHEN event_type <> 'error' THEN (epoch_us(ts) // 1000) END AS updated_at,
         CASE WHEN event_type = 'view' THEN 1 WHEN event_type <> 'error' THEN 0 END AS access_count,
         CASE WHEN event_type = 'view' THEN (epoch_us(ts) // 1000) END AS last_access_at, CASE WHEN event_type = 'error' THEN (epoch_us(ts) // 1000) END AS at_ms,
         {BASE} AS created_at FROM events)"""


def relation_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers belong to nations, nations are part of regions: one entry each; every seventh customer's is
    superseded."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    low = lambda x: F.lower(F.replace(F.col(x), F.lit("#"), F.lit("")))
    one = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("id"), F.concat(low("c_name"), F.lit(" belongs to "), low("n_name")).alias("content"), F.col("c_custkey").alias("k"))
    two = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit("n-"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(low("n_name"), F.lit(" is part of "), low("r_name")).alias("content"), F.col("n_nationkey").cast("long").alias("k"))
    old = F.when((F.col("k") % 7 == 0) & F.col("id").startswith("c-"), F.array(F.lit("superseded-by:x"))).otherwise(F.array().cast("array<string>"))
    made = F.col("k") * 60_000 + BASE
    return one.unionByName(two).select("id", F.lit("fact").alias("kind"), "content", old.alias("tags"), F.lit("auto").alias("source"), F.lit(None).cast("string").alias("workspace"), made.alias("created_at"), made.alias("updated_at"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("long").alias("last_access_at"))


EDGES_SQL = f"""facts AS (
  SELECT 'c-' || c_custkey AS id, replace(lower(c_name), '#', '') AS s, 'belongs to' AS r, lower(n_name) AS o, c_custkey * 60000 + {BASE} AS t, c_custkey % 7 = 0 AS bad
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'n-' || n_nationkey, lower(n_name), 'part of', lower(r_name), n_nationkey * 60000 + {BASE}, false FROM nation JOIN region ON n_regionkey = r_regionkey),
edges AS (
  SELECT src, relation, dst, max(t) AS occurred_at, max(CASE WHEN bad THEN t END) AS invalid_at, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT id, s AS src, r AS relation, o AS dst, t, bad FROM facts UNION ALL SELECT id, o, '~' || r, s, t, bad FROM facts) GROUP BY ALL)"""
