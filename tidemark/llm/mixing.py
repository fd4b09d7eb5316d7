"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, distributed_rank, fresh, materialize, row_keys, table, unit_hash, word_count

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all sizes, and the most often a source or document is repeated.
BUDGET, MAX_REPEAT, SEED = 1.5, 2.0, "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, max_repeat=MAX_REPEAT) -> DataFrame:
    """One row per source: src, no_src, source_size, target.

    Water filling in closed form. Sources stand in order of cap / weight; each computes the level the budget would
    give if exactly those before it were capped; the first that stays under its cap sets the level for all after it.
    The windows without a partition run over one row per source.
    """
    by_name = Window.orderBy("no_src", "src")
    src = (
        sizes.groupBy("src", "no_src")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "no_src", "src")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = (
        src.withColumn("total", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("rest", F.col("total") - F.col("capped_before"))
        .withColumn("is_capped", F.col("weight") * F.col("rest") / F.col("weight_from") >= F.col("cap"))
        .withColumn("level", F.first(F.when(~F.col("is_capped"), F.struct("rest", "weight_from")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.when(F.col("is_capped"), F.col("cap")).otherwise(F.col("weight") * F.col("level.rest") / F.col("level.weight_from"))
    return src.select("src", "no_src", "source_size", target.alias("target"))


def systematic_copies(rate: Column, rank: Column, offset: Column, max_repeat: float) -> Column:
    """Integer boundaries that the rank-th document's stretch of the prefix sum of expected copies crosses."""
    crossed = F.floor(rate * rank + offset) - F.floor(rate * (rank - 1) + offset)
    return F.least(crossed, F.lit(int(max_repeat))).cast("long")


def plan_mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, budget=BUDGET, max_repeat=MAX_REPEAT, seed=SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken, one row per input row.

    Size is the number of words; null text has size 0; null source is a source of its own, last in order. Within a
    source every document expects target / source_size copies; documents stand by falling size, then id, so that
    rounding errors of neighbours cancel, and the prefix sum of expected copies plus one offset per source (a hash of
    seed and source) decides how often each is emitted. Reruns agree. Rows that repeat count separately; an empty
    table gives no rows; a source without words has target 0. Sources of any size spread over all tasks. Very long
    texts count whole; columns but the three named are not read.
    """
    sizes = materialize(
        docs.select(
            column(id_col).alias("doc_id"),
            F.coalesce(column(source_col).cast("string"), F.lit("")).alias("src"),
            column(source_col).isNull().cast("int").alias("no_src"),
            word_count(column(text_col)).alias("size"),
        ),
        "mix-sizes",
    )
    ranked = distributed_rank(sizes, ["no_src", "src"], [F.col("size").desc(), F.col("doc_id").asc_nulls_first()], "mix-ranked")
    offset = unit_hash(F.concat(F.lit(f"{seed}|"), F.col("src"), F.lit("|"), F.col("no_src").cast("string")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = systematic_copies(rate, F.col("rank_in_group"), offset, max_repeat)
    return (
        ranked.join(source_targets(sizes, weights, budget, max_repeat), ["no_src", "src"])
        .withColumn("copies", copies)
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, id_col="doc_id", text_col="text", copy_col="copy", **options) -> DataFrame:
    """The mix itself: each input row once per copy taken, with copy_col numbering the copies from 1.

    Rows are matched to the plan by id and text, so rows that share an id, or have none, each follow their own plan;
    rows equal in both are emitted as often as the first of them in the plan. Other columns may have any name; one
    called copy_col is replaced.
    """
    key, copies = (fresh(docs, x) for x in ("__row", "__copies"))
    keyed, ids = row_keys(docs, id_col, text_col, key)
    plan = plan_mix(keyed, key, text_col, **options)
    if ids is not None:
        plan = plan.groupBy("doc_id").agg(F.max("copies").alias("copies"))
    plan = plan.where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").cast("int").alias(copies))
    return keyed.join(plan, key).withColumn(copy_col, F.explode(F.sequence(F.lit(1), F.col(copies)))).drop(key, copies)


def op2_mix(spark, sf_dir: str) -> DataFrame:
    return plan_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP2_SQL = r"""
WITH sizes AS (
  SELECT doc_id, coalesce(source, '') AS src, CASE WHEN source IS NULL THEN 1 ELSE 0 END AS no_src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
src AS (
  SELECT src, no_src, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY no_src, src) - 1) % 3 + 1)::INT] AS weight
  FROM sizes GROUP BY src, no_src),
caps AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total FROM src),
levels AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, no_src, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest,
         sum(weight) OVER (ORDER BY cap / weight, no_src, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM caps),
flagged AS (SELECT *, weight * rest / weight_from >= cap AS is_capped FROM levels),
lv AS (SELECT rest AS r, weight_from AS w FROM flagged WHERE NOT is_capped ORDER BY cap / weight, no_src, src LIMIT 1),
targets AS (
  SELECT src, no_src, source_size,
         CASE WHEN is_capped THEN cap ELSE weight * lv.r / lv.w END AS target FROM flagged LEFT JOIN lv ON true),
ranked AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1|' || s.src || '|' || s.no_src), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY s.no_src, s.src ORDER BY size DESC, doc_id) AS k
  FROM sizes s JOIN targets t USING (src, no_src))
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2) * size)::BIGINT AS taken,
       least(floor(rate * k + u) - floor(rate * (k - 1) + u), 2)::BIGINT AS copies
FROM ranked
"""
