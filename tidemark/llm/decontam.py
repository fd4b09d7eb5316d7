"""Benchmark decontamination by winnowing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, bind, column, materialize, table

#: What parts words: all of ASCII but letters and digits.
NO_TOKEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a window; words in a fingerprinted gram; grams in a winnowing window. GRAM + SPAN - 1 == WINDOW, so every
#: shared window of WINDOW words holds the same fingerprint on both sides.
WINDOW, GRAM, SPAN = 8, 4, 5
#: Most rows (of 8 to 60 bytes) of a counted table that is broadcast; larger ones are shuffled.
BROADCAST_ROWS = 200_000
MIN_ITEMS = 2


def ascii_lower(word: Column) -> Column:
    """Lower-cases A-Z alone; only words that any lower-casing changes take the slower way."""
    return F.when(word == F.lower(word), word).otherwise(F.translate(word, ASCII_UPPER, ASCII_LOWER))


def tokens(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, NO_TOKEN), ""), F.array().cast("array<string>"))


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(ascii_lower(w)))


def _grams(h: Column, n: int) -> Column:
    """Hashes of n consecutive words, from each position on that has them."""
    return F.when(F.size(h) < n, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    )


def _fingerprints(h: Column) -> Column:
    """Distinct minima of the gram hashes over every SPAN grams in a row; none for fewer than WINDOW words."""
    least = lambda g: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(g) - SPAN), lambda i: F.least(*[F.get(g, i + k) for k in range(SPAN)])))
    return F.when(F.size(h) < WINDOW, F.array().cast("array<bigint>")).otherwise(bind(_grams(h, GRAM), least))


def _short_keys(h: Column, sizes: list[int]) -> Column:
    """Hashes of the runs of n words, for the lengths n of items shorter than a window; they stand beside the
    fingerprints, so n goes into the hash."""
    sized = lambda n: F.transform(_grams(h, n), lambda x: F.xxhash64(F.lit(n), x))
    return F.array_distinct(F.concat(*[sized(n) for n in sizes]))


def _windows(h: Column, sizes: list[int]) -> Column:
    """(n, key, start) of every run of n words, for each n in sizes."""

    def runs(n: int) -> Column:
        return F.transform(_grams(h, n), lambda x, i: F.struct(F.lit(n).alias("n"), x.alias("key"), i.cast("int").alias("start"))).cast("array<struct<n:int,key:bigint,start:int>>")

    return F.concat(*[runs(n) for n in sizes])


def _hit_windows(h: Column, hits: Column, sizes: list[int]) -> Column:
    """(n, key, start) of the windows to compare: those of WINDOW words that hold a gram among the hits, and runs of a
    short item's length that are a hit themselves."""

    def around(flags: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.coalesce(*[F.when(F.get(flags, i + k), F.lit(True)) for k in range(SPAN)], F.lit(False)))
        return F.transform(starts, lambda i: F.struct(F.lit(WINDOW).alias("n"), F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]).alias("key"), i.cast("int").alias("start")))

    none = F.array().cast("array<struct<n:int,key:bigint,start:int>>")
    whole = F.when(F.size(h) >= WINDOW, bind(F.transform(_grams(h, GRAM), lambda x: F.array_contains(hits, x)), around)).otherwise(none)

    def runs(n: int) -> Column:
        return F.filter(_windows(h, [n]), lambda w: F.array_contains(hits, F.xxhash64(F.lit(n), w["key"])))

    return F.concat(whole, *map(runs, sizes))


def _side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if counted to be within the limit."""
    return F.broadcast(df) if df.count() <= limit else df


def decontaminate(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", min_items=MIN_ITEMS) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, n_items, items (sorted ids as strings), contaminated; a row per input row.

    First, winnowed fingerprints of the training texts meet those of the test items; a document that shares none
    shares no window. Then the hits are extended: wherever a document holds a fingerprint that met one, the windows of
    WINDOW words around it are compared with the items' windows by a 64-bit hash. Items of fewer than WINDOW words are
    one window and are looked up whole.

    Columns but those named are not read, so extra ones can't clash; very long texts are read whole. Null or wordless texts have no words and no hits; an item without words or id occurs nowhere; an empty benchmark
    leaves every document clean. Rows that repeat each get the same answer; rows that share an id but not a text are
    judged each by its own text. What is gathered for a document is bounded by its own words.
    """
    bench = materialize(items.select(column(item_col).cast("string").alias("item_id"), _hashes(column(item_text_col)).alias("h")).where("item_id is not null and size(h) > 0"), "bench")
    sizes = sorted(r["n"] for r in bench.where(F.size("h") < WINDOW).select(F.size("h").alias("n")).distinct().collect())  # at most 1 to WINDOW - 1
    prints = lambda h: F.concat(_fingerprints(h), _short_keys(h, sizes)) if sizes else _fingerprints(h)
    # the short runs of longer items widen the first sieve only
    marks = bench.select(F.explode(bind(F.col("h"), prints)).alias("fp")).distinct().withColumn("hit", F.lit(1))

    hashed = docs.select(
        F.monotonically_increasing_id().alias("row"), column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_key"), bind(_hashes(column(text_col)), lambda h: F.struct(F.size(h).cast("long").alias("n"), prints(h).alias("fps"))).alias("m")
    )
    rows = hashed.select("row", "doc_id", "text_key", F.col("m.n").alias("n_words"), F.explode_outer("m.fps").alias("fp"))
    seen = materialize(rows.join(_side(marks), "fp", "left").groupBy("row", "doc_id", "text_key", "n_words").agg(F.collect_set(F.when(F.col("hit") == 1, F.col("fp"))).alias("hits")), "seen")

    hit_docs = seen.where("size(hits) > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "hits").dropDuplicates(["__id", "__key"])
    again = docs.select(column(id_col).alias("doc_id"), F.xxhash64(column(text_col)).alias("text_key"), column(text_col).alias("__text"))
    again = again.join(_side(hit_docs), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")))
    lengths = [*sizes, WINDOW]
    item_windows = bench.select("item_id", F.size("h").alias("len"), F.explode(bind(F.col("h"), lambda h: _windows(h, lengths))).alias("w"))
    item_windows = item_windows.where((F.col("w.n") == WINDOW) | (F.col("w.n") == F.col("len"))).select("item_id", "w.n", "w.key").distinct()
    doc_windows = again.select("doc_id", "text_key", F.explode(bind(_hashes(F.col("__text")), lambda h: _hit_windows(h, F.col("hits"), sizes))).alias("w")).select("doc_id", "text_key", "w.n", "w.key", "w.start")
    found = doc_windows.join(_side(item_windows), ["n", "key"])

    per_start = found.groupBy("doc_id", "text_key", "start").agg(F.max("n").alias("n"), F.collect_set("item_id").alias("ids"))
    spans = F.array_sort(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n")),
        lambda a: a["n"].cast("long"),
    )
    per_doc = (
        per_start.groupBy("doc_id", "text_key")
        .agg(spans.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
        .select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), covered.alias("__hit"), "items")
    )
    items_of = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    return seen.join(per_doc, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key")), "left").select(
        "doc_id",
        "text_key",
        "n_words",
        F.coalesce("__hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        items_of.alias("items"),
        (F.size(items_of) >= min_items).alias("contaminated"),
    )


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(8, len(w)) AS n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
