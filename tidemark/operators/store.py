"""Writing to the log, maintenance of it, and the summaries of what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.score import DAY, heat, significance
from ..functions.text import clean_tags, content_hash, js_trim
from ..plans.tables import ranked
from ..schema import ENTRY_COLUMNS, KINDS, LAYER, LOG, SOURCES, is_superseded
from ..sources.log import live, snapshot

MIN_LINES, LIVE_SHARE = 64, 2


def _append(rows: DataFrame, start: int, order: list) -> DataFrame:
    """rows as log lines numbered from start in the given order, without one task that sees them all."""
    numbered = ranked(rows, [], [F.col(c) for c in order], "seq").withColumn("seq", F.col("seq") + (start - 1))
    missing = {f.name: F.lit(None).cast(f.dataType) for f in LOG.fields if f.name not in numbered.columns}
    return numbered.withColumns(missing).select(*LOG.fieldNames())


def next_seq(log: DataFrame) -> int:
    return int(log.agg(F.coalesce(F.max("seq"), F.lit(-1))).first()[0]) + 1


def upsert(log: DataFrame, entries: DataFrame, order: list | None = None) -> DataFrame:
    """Log lines that write the entries after all lines of the log; later lines win."""
    return _append(entries.select(*ENTRY_COLUMNS, F.lit("E").alias("op")), next_seq(log), order or ["id"])


def remove(log: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Tombstones of the given ids (column id) that stand."""
    there = ids.select("id").distinct().join(live(log).select("id"), "id", "left_semi")
    return _append(there.select("id", F.lit("T").alias("op"), F.lit(now).cast("long").alias("at")), next_seq(log), ["id"])


def insert_new(log: DataFrame, entries: DataFrame) -> DataFrame:
    """Log lines of the entries whose id does not stand; ids repeated among them all go in."""
    return upsert(log, entries.join(live(log).select("id"), "id", "left_anti"))


def compact(log: DataFrame) -> DataFrame:
    """The log with one line per standing entry, in their order."""
    return _append(live(log).select(*ENTRY_COLUMNS, "ord", F.lit("E").alias("op")).drop("at"), 0, ["created_at", "ord"])


def export_all(log: DataFrame) -> DataFrame:
    """Standing entries as a snapshot lists them, ready to be inserted elsewhere."""
    return snapshot(live(log)).select(*ENTRY_COLUMNS)


def verify_compact(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: entries that compaction lost, made up or changed, all 0 if it kept what stands."""
    pick = lambda log, name: live(log).select("id", F.struct(*ENTRY_COLUMNS).alias(name))
    both = pick(before, "was").join(pick(after, "now"), "id", "full_outer")
    return both.agg(F.count_if(F.col("now").isNull()).alias("lost"), F.count_if(F.col("was").isNull()).alias("made"), F.count_if(F.col("was").isNotNull() & F.col("now").isNotNull() & (F.col("was") != F.col("now"))).alias("changed"))


def needs_compaction(lines: int, entries: int) -> bool:
    return lines >= MIN_LINES and lines > LIVE_SHARE * entries


def heat_rows(hits: DataFrame, now: int) -> DataFrame:
    """Entries as a recall leaves them: one more access, now; updated_at stays. One row per id."""
    return hits.select(*ENTRY_COLUMNS).dropDuplicates(["id"]).withColumns({"access_count": F.col("access_count") + 1, "last_access_at": F.lit(now).cast("long")})


def make_entries(candidates: DataFrame, now: int, max_chars: int = 1000, prefix: str = "", suffix=None, keep: list | None = None) -> DataFrame:
    """Entries of candidates (kind, content, tags, source; others optional). The id hashes the whole trimmed text, the
    content is cut; suffix (8 characters) tells equal texts apart. keep: columns of the candidates to take over, such as
    an id they have already."""
    text = js_trim(F.col("content"))
    parts = ([F.lit(prefix)] if prefix else []) + [content_hash(text)] + ([suffix] if suffix is not None else [])
    has = lambda c, kind: F.col(c) if c in candidates.columns else F.lit(None).cast(kind)
    id_ = [] if "id" in (keep or ()) else [F.concat_ws("-", *parts).alias("id")]
    return candidates.select(
        *(keep or ()), *id_, "kind", F.substring(text, 1, max_chars).alias("content"), clean_tags(F.col("tags")).alias("tags"), "source", has("session_id", "string").alias("session_id"), has("workspace", "string").alias("workspace"),
        F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("long").alias("last_access_at"),
    )


def expired(entries: DataFrame, now: int, ttl_days: float) -> DataFrame:
    """Entries untouched for longer than ttl_days; none if it is 0 or less."""
    touched = F.greatest(F.col("updated_at"), F.coalesce("last_access_at", F.lit(0)), F.col("created_at"))
    return entries.where(F.lit(ttl_days > 0) & (F.lit(now) - touched > ttl_days * DAY))


def value_of(now: int):
    """What eviction weighs: significance times heat."""
    return significance(F.col("kind"), F.col("source")) * heat(F.col("access_count"), F.col("last_access_at"), now)


def evict(entries: DataFrame, most: int, now: int) -> DataFrame:
    """Entries to drop so that at most `most` stay: superseded ones first, then the least valued, then by id;
    instructions never. The count is one small aggregate; the rest is a distributed sort with a limit."""
    over = entries.count() - most
    if most <= 0 or over <= 0:
        return entries.limit(0)
    pool = entries.where("kind <> 'instruction'").withColumn("value", value_of(now)).withColumn("gone", is_superseded(F.col("tags")))
    return pool.orderBy(F.desc("gone"), "value", "id").limit(over).drop("gone")


def prune(entries: DataFrame, now: int, ttl_days: float = 0, most: int = 0) -> DataFrame:
    """id, reason (expired, evicted) of what one round of pruning removes; what is both is expired."""
    old = expired(entries, now, ttl_days).select("id", F.lit("expired").alias("reason"))
    return old.unionByName(evict(entries, most, now).join(old, "id", "left_anti").select("id", F.lit("evicted").alias("reason")))


def layer_counts(entries: DataFrame) -> DataFrame:
    """One row: distilled entries of either layer."""
    layer = lambda name: F.count_if(F.exists("tags", lambda t: t == LAYER + name)).alias(name)
    return entries.agg(layer("abstract"), layer("procedural"))


def summarize(entries: DataFrame) -> DataFrame:
    """total, a count for each kind and source, oldest and newest created_at, superseded."""
    return entries.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in KINDS],
        *[F.count_if(F.col("source") == s).alias(f"source_{s}") for s in SOURCES],
        F.min("created_at").alias("oldest_at"),
        F.max("created_at").alias("newest_at"),
        F.count_if(is_superseded(F.col("tags"))).alias("superseded"),
    )


def hot_cold(entries: DataFrame, now: int) -> DataFrame:
    """hot: not superseded, and accessed or written within 7 days; the others are cold."""
    fresh = F.greatest("created_at", "updated_at") >= now - 7 * DAY
    hot = ~is_superseded(F.col("tags")) & ((F.col("access_count") > 0) | fresh)
    return entries.agg(F.count_if(hot).alias("hot"), F.count_if(~hot).alias("cold"))


def fingerprint(entries: DataFrame) -> DataFrame:
    """One hash over the ids, contents and tags of all entries, for telling whether an index still fits; order does
    not matter, and neither do accesses. Hashes of rows are summed, so no list of them is gathered."""
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct("id", "content", "tags")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return entries.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(row), F.lit(0)).cast("string")), 256).alias("fingerprint"))


def workspace_filter(entries: DataFrame, workspace: str | None, strict: bool = False) -> DataFrame:
    """Entries of a workspace and shared ones. An empty name filters nothing, and an entry's empty name counts as
    shared unless strict."""
    if not workspace:
        return entries
    shared = F.col("workspace").isNull() | (F.lit(not strict) & (F.col("workspace") == ""))
    return entries.where(shared | (F.col("workspace") == workspace))


