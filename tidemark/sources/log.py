"""The log: reading it, and what it says of any moment."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import diff_title
from ..plans.tables import ranked
from ..schema import ENTRY_COLUMNS, KINDS, LOG, SOURCES, SUPERSEDED_BY

#: Buckets a timeline shows.
TIMELINE_CAP = 31


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def read_entry(value: object) -> dict | None:
    """The entry in a parsed line, unknown fields dropped; None where a field is missing or of the wrong type."""
    if not isinstance(value, dict):
        return None
    text = lambda k: isinstance(value.get(k), str)
    tags = value.get("tags")
    ok = (
        all(map(text, ("id", "kind", "content")))
        and value["kind"] in KINDS
        and isinstance(tags, list)
        and all(isinstance(t, str) for t in tags)
        and value.get("source") in SOURCES
        and all(_number(value.get(k)) for k in ("createdAt", "updatedAt", "accessCount"))
        and all(k not in value or text(k) for k in ("sessionId", "workspace"))
        and ("lastAccessAt" not in value or _number(value["lastAccessAt"]))
    )
    if not ok:
        return None
    whole = lambda k: int(value[k]) if k in value else None
    return {
        "id": value["id"], "kind": value["kind"], "content": value["content"], "tags": tags, "source": value["source"],
        "session_id": value.get("sessionId"), "workspace": value.get("workspace"),
        "created_at": whole("createdAt"), "updated_at": whole("updatedAt"), "access_count": whole("accessCount"), "last_access_at": whole("lastAccessAt"),
    }


def parse_lines(lines: DataFrame) -> DataFrame:
    """lines: seq, value. The log they hold: entries, tombstones and lines that can't be read; blank lines and key
    records are skipped. The strict checks need the JSON types, so parsing runs in Arrow batches."""

    def run(batches):
        for pdf in batches:
            rows = []
            for seq, raw in zip(pdf["seq"], pdf["value"], strict=True):
                line = (raw or "").strip()
                if not line:
                    continue
                row = dict.fromkeys(LOG.fieldNames()) | {"seq": seq}
                try:
                    value = json.loads(line)
                except ValueError:
                    value = None
                if isinstance(value, dict) and "__kdf__" in value:
                    continue
                if isinstance(value, dict) and isinstance(value.get("__tombstone__"), str):
                    rows.append(row | {"op": "T", "id": value["__tombstone__"], "at": int(value["at"]) if _number(value.get("at")) else None})
                    continue
                entry = read_entry(value)
                rows.append(row | (entry | {"op": "E"} if entry else {"op": "X", "raw": line}))
            out = pd.DataFrame(rows, columns=LOG.fieldNames())
            yield out.astype({f.name: "Int64" for f in LOG.fields if isinstance(f.dataType, T.LongType)})

    return lines.select("seq", "value").mapInPandas(run, LOG)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log in a file of JSON lines; its order is the order of the lines. A file of any size is read in splits, whose
    offsets give the order; lines are then numbered without a task that sees them all."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"), F.monotonically_increasing_id().alias("nth")]
    lines = spark.read.option("lineSep", "\n").text(path).select("value", *place)
    return parse_lines(ranked(lines, [], [F.col("file"), F.col("offset"), F.col("nth")], "seq").select((F.col("seq") - 1).alias("seq"), "value"))


def corrupt_lines(log: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Lines that can't be read and are not among the known ones."""
    lines = log.where("op = 'X'").select(F.col("raw").alias("line")).distinct()
    return lines if known is None else lines.join(known.select("line").distinct(), "line", "left_anti")


def _last_per_id(log: DataFrame) -> DataFrame:
    """The last operation of each id; ord is where the id entered after its last deletion, which orders ties."""
    ops = log.where("op <> 'X'")
    whole = Window.partitionBy("id")
    gone = F.max(F.when(F.col("op") == "T", F.col("seq"))).over(whole)
    entered = F.min(F.when((F.col("op") == "E") & (F.col("seq") > F.coalesce(F.col("__gone"), F.lit(-1))), F.col("seq"))).over(whole)
    last = F.max("seq").over(whole)
    return ops.withColumn("__gone", gone).withColumn("ord", entered).withColumn("__last", last).where("seq = __last and op = 'E'").drop("__gone", "__last")


def live(log: DataFrame) -> DataFrame:
    """Entries that stand now, with ord. A later line wins over an earlier one, whatever their times."""
    return _last_per_id(log).select(*ENTRY_COLUMNS, "ord")


def as_of(log: DataFrame, t: int) -> DataFrame:
    """Entries that stood at time t: of the lines written by then, the last of each id.

    A line written after t, by its update or its last access, is skipped whole; a tombstone without a time always
    holds.
    """
    entry = (F.col("op") == "E") & (F.col("updated_at") <= t) & (F.col("last_access_at").isNull() | (F.col("last_access_at") <= t))
    tomb = (F.col("op") == "T") & (F.col("at").isNull() | (F.col("at") <= t))
    return live(log.where(entry | tomb))


def snapshot(entries: DataFrame) -> DataFrame:
    return entries.orderBy("created_at", "ord")


def events(log: DataFrame) -> DataFrame:
    """Every operation with its meaning: added, updated, heat, removed, pre_removed (no time known) or null."""
    w = Window.partitionBy("id").orderBy("seq")
    state = F.struct("content", "kind", "tags")
    before, before_op = F.lag(state).over(w), F.lag("op").over(w)
    kind = (
        F.when(F.col("op") == "T", F.when(before_op == "E", F.when(F.col("at").isNull(), "pre_removed").otherwise("removed")))
        .when(before_op.isNull() | (before_op == "T"), "added")
        .when(~before.eqNullSafe(state), "updated")
        .otherwise("heat")
    )
    moment = F.when(F.col("op") == "T", F.col("at")).otherwise(F.greatest("updated_at", "last_access_at"))
    return log.where("op <> 'X'").select("seq", "id", kind.alias("event"), F.date_format(F.timestamp_millis(moment), "yyyy-MM-dd").alias("day"))


def timeline(log: DataFrame, cap: int = TIMELINE_CAP) -> DataFrame:
    """day, added, removed, updated, heat, total of the last `cap` days that saw an event (UTC).

    total never falls below 0: with S the running sum of added - removed from minus the removals of unknown time, it
    is S - min(0, the least S so far). The windows run over one row per day.
    """
    counted = lambda e: F.count_if(F.col("event") == e)
    seen = events(log)
    days = seen.where("event is not null and event <> 'pre_removed'").groupBy("day").agg(*[counted(e).alias(e) for e in ("added", "removed", "updated", "heat")])
    before = seen.agg(counted("pre_removed").alias("before"))
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    summed = days.crossJoin(F.broadcast(before)).withColumn("s", F.sum(F.col("added") - F.col("removed")).over(w) - F.col("before"))
    total = F.col("s") - F.least(F.lit(0), F.min("s").over(w))
    newest = F.row_number().over(Window.orderBy(F.desc("day")))
    return summed.withColumn("total", total).withColumn("n", newest).where(F.col("n") <= cap).select("day", "added", "removed", "updated", "heat", "total")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change_type (added, removed, changed), id, kind, title, change between two snapshots.

    change of a changed entry: superseded or restored by its tags, else content (content, kind or workspace differ),
    tags, heat (only accesses differ) or other.
    """
    a = before.select("id", F.struct(*ENTRY_COLUMNS).alias("a"))
    b = after.select("id", F.struct(*ENTRY_COLUMNS).alias("b"))
    both = a.join(b, "id", "full_outer")
    marked = lambda side: F.exists(F.col(f"{side}.tags"), lambda t: t.startswith(SUPERSEDED_BY))
    differs = lambda *cols: ~F.struct(*[F.col(f"a.{c}") for c in cols]).eqNullSafe(F.struct(*[F.col(f"b.{c}") for c in cols]))
    change = (
        F.when(marked("b") & ~marked("a"), "superseded")
        .when(marked("a") & ~marked("b"), "restored")
        .when(differs("content", "kind", "workspace"), "content")
        .when(differs("tags"), "tags")
        .when(differs("access_count", "last_access_at"), "heat")
        .otherwise("other")
    )
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    side = F.coalesce("b", "a")
    return (
        both.withColumn("change_type", kind)
        .where("change_type is not null")
        .select("change_type", "id", side["kind"].alias("kind"), diff_title(side["content"]).alias("title"), F.when(F.col("change_type") == "changed", change).alias("change"))
    )


def log_stats(log: DataFrame) -> DataFrame:
    """lines, corrupt, tombstones, entries, revision (largest seq) and duplicate_ratio = lines / entries - 1."""
    lines = log.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("op") == "X").alias("corrupt"), F.count_if(F.col("op") == "T").alias("tombstones"), F.max("seq").alias("revision"))
    return lines.crossJoin(F.broadcast(live(log).agg(F.count(F.lit(1)).alias("entries")))).withColumn(
        "duplicate_ratio", F.when(F.col("entries") > 0, F.col("lines") / F.col("entries") - 1).otherwise(0.0)
    )
