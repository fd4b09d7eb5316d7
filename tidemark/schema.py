"""Entries, the log, and the relations that entries carry in their tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("decision", "fact", "preference", "instruction", "generic")
SOURCES = ("auto", "explicit")

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("source", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("workspace", T.StringType()),
        T.StructField("created_at", T.LongType()),
        T.StructField("updated_at", T.LongType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("last_access_at", T.LongType()),
    ]
)
ENTRY_COLUMNS = ENTRY.fieldNames()
#: seq: position in the log; op: E entry, T tombstone, X line that can't be read; at: time of a tombstone, if known.
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("op", T.StringType()), *ENTRY.fields, T.StructField("at", T.LongType()), T.StructField("raw", T.StringType())])

# What the relation tags begin with.
SUPERSEDE, SUPERSEDED_BY, CONFLICTS_WITH, CONFLICT_OF = "supersede:", "superseded-by:", "conflicts-with:", "conflict-of:"
LAYER, DISTILLED_FROM, THEME = "distilled-layer:", "distilled-from:", "distilled-theme:"


def _after(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the tags that have it, in tag order."""
    return F.transform(F.filter(tags, lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 1 << 30))


def superseded_by(tags: Column) -> Column:
    return _after(tags, SUPERSEDED_BY)


def is_superseded(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.startswith(SUPERSEDED_BY)), F.lit(False))


def supersede_target(tags: Column) -> Column:
    return F.get(_after(tags, SUPERSEDE), F.lit(0))


def conflict_peers(tags: Column) -> Column:
    both = F.filter(tags, lambda t: t.startswith(CONFLICTS_WITH) | t.startswith(CONFLICT_OF))
    return F.array_distinct(F.transform(both, lambda t: F.regexp_extract(t, "^[^:]*:(.*)$", 1)))


def is_conflicted(tags: Column) -> Column:
    return F.size(conflict_peers(tags)) > 0


def is_distilled(tags: Column) -> Column:
    return F.coalesce(F.exists(tags, lambda t: t.startswith(LAYER)), F.lit(False))


def distill_layer(tags: Column) -> Column:
    return F.get(_after(tags, LAYER), F.lit(0))


def distill_theme(tags: Column) -> Column:
    return F.get(_after(tags, THEME), F.lit(0))


def distilled_from(tags: Column) -> Column:
    return F.split(F.get(_after(tags, DISTILLED_FROM), F.lit(0)), ",")


def with_protocol(entries: DataFrame) -> DataFrame:
    """entries with the relations in their tags as columns."""
    t = F.col("tags")
    return entries.withColumns(
        {
            "supersede_target": supersede_target(t),
            "superseded_by": superseded_by(t),
            "is_superseded": is_superseded(t),
            "conflict_peers": conflict_peers(t),
            "distill_layer": distill_layer(t),
            "distill_theme": distill_theme(t),
            "distilled_from": distilled_from(t),
        }
    )
