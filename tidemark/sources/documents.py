"""Documents and session records as candidates for entries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.signals import infer_kind, infer_speaker_kind, is_sensitive
from ..functions.text import content_hash, js_trim, label_tag, nfkc_lower

MIN_CHARS, MAX_CHARS = 8, 1000


def split_document(docs: DataFrame) -> DataFrame:
    """docs: label, text. label, block_no, block: headings and list items are blocks of their own, other lines join to
    a paragraph up to a blank line, a rule or such an item; list items that are only a link are left out."""
    lines = docs.select("label", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", js_trim(F.col("raw")))
    line = F.col("line")
    kind = (
        F.when((line == "") | line.rlike(r"^-{3,}\s*$"), "break")
        .when(line.rlike(r"^#+\s"), "head")
        .when(line.rlike(r"^[-*+]\s"), "item")
        .when(line.rlike(r"^\d+\.\s"), "number")
        .otherwise("plain")
    )
    body = F.when(F.col("k") == "head", js_trim(F.regexp_replace(line, r"^#+\s*", ""))).when(F.col("k") == "item", F.regexp_replace(line, r"^[-*+]\s+", "")).when(F.col("k") == "number", F.regexp_replace(line, r"^\d+\.\s+", "")).otherwise(line)
    w = Window.partitionBy("label").orderBy("pos")
    marked = lines.withColumn("k", kind).withColumn("body", body)
    starts = (F.col("k") != "plain") | (F.lag("k").over(w).isNull()) | (F.lag("k").over(w) != "plain")
    island = marked.withColumn("grp", F.sum(starts.cast("int")).over(w)).where("k <> 'break'")
    island = island.where(~((F.col("k") == "item") & F.col("body").rlike(r"^\[[^\]]+\]\([^)]+\)\s*$")))
    joined = island.groupBy("label", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("ls"))
    block = js_trim(F.array_join(F.transform("ls", lambda x: x["body"]), " "))
    return joined.select("label", (F.row_number().over(Window.partitionBy("label").orderBy("grp")) - 1).alias("block_no"), block.alias("block"))


#: What JavaScript's trim() takes off.
BLANKS = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def join_blocks(value: object) -> str:
    """Text of nested content: texts one after the other, a blank only between two ASCII word characters."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        out = ""
        for x in value:
            piece = join_blocks(x)
            word = lambda c: c.isascii() and (c.isalnum() or c == "_")
            out += (" " if out and piece and word(out[-1]) and word(piece[0]) else "") + piece
        return out.strip()
    if isinstance(value, dict):
        if value.get("type") == "text" and isinstance(value.get("text"), str):
            return value["text"]
        if value.get("type") == "tool-result":
            return join_blocks(value.get("content"))
    return ""


def session_text(lines: DataFrame) -> DataFrame:
    """lines: label, line_no, line. label, line_no, status (text, corrupt, unhandled), is_user, text of session records;
    a record without text but blanks is unhandled. Nesting has no bound, so parsing runs in Arrow batches."""
    out = T.StructType([T.StructField("label", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("status", T.StringType()), T.StructField("is_user", T.BooleanType()), T.StructField("text", T.StringType())])

    def run(batches):
        for pdf in batches:
            rows = []
            for label, no, line in zip(pdf["label"], pdf["line_no"], pdf["line"], strict=True):
                try:
                    x = json.loads(line)
                except (ValueError, TypeError):
                    rows.append((label, no, "corrupt", None, None))
                    continue
                data = x.get("data") if isinstance(x, dict) and isinstance(x.get("data"), dict) else {}
                kind = x.get("type") if isinstance(x, dict) else None
                said = data.get("content")
                if kind == "assistant/message" and isinstance(data.get("message"), dict) and data["message"].get("content") is not None:
                    said = data["message"]["content"]
                text = join_blocks(said).strip(BLANKS) if kind in ("user/message", "assistant/message") else ""
                rows.append((label, no, "text", kind == "user/message", text) if text else (label, no, "unhandled", None, None))
            yield pd.DataFrame(rows, columns=out.fieldNames())

    return lines.select("label", "line_no", "line").mapInPandas(run, out)


def plan_import(blocks: DataFrame, sessions: DataFrame | None, existing: DataFrame, now: int, max_chars: int = MAX_CHARS, nfkc: bool = True) -> tuple[DataFrame, DataFrame]:
    """(entries, stats). blocks: label, block_no, block; sessions: rows of session_text(); existing: content_hash.

    Candidates go by their order, documents first: texts seen before in this import are dropped silently, short and
    sensitive ones and those already stored are counted; the others become entries with a reproducible id.
    """
    cols = ("part", "label", "ord", "text", "kind", "tags")
    found = blocks.select(F.lit(0).alias("part"), "label", F.col("block_no").cast("long").alias("ord"), F.col("block").alias("text"), infer_kind(F.col("block")).alias("kind"), F.array(F.lit("imported"), label_tag(F.col("label"))).alias("tags"))
    if sessions is not None:
        spoken = sessions.where("status = 'text'")
        found = found.unionByName(spoken.select(F.lit(1).alias("part"), "label", F.col("line_no").alias("ord"), "text", infer_speaker_kind(F.col("text"), F.col("is_user")).alias("kind"), F.array(F.lit("imported"), F.lit("session"), label_tag(F.col("label"))).alias("tags")))
    found = found.select(*cols).withColumn("key", js_trim(F.col("text"))).withColumn("content", F.substring("key", 1, max_chars))
    first = F.row_number().over(Window.partitionBy("key").orderBy("part", "label", "ord"))
    norm = nfkc_lower(F.col("content")) if nfkc else F.lower("content")
    # a short text is counted each time, as its key is not kept
    judged = found.withColumn("n", first).withColumn("short", F.length("content") < MIN_CHARS).where("short or n = 1").withColumn("hash", content_hash(F.col("content")))
    judged = judged.withColumn("sensitive", ~F.col("short") & is_sensitive(norm)).join(existing.select("content_hash", F.lit(True).alias("stored")).distinct(), F.col("hash") == F.col("content_hash"), "left")
    status = F.when(F.col("short"), "short").when(F.col("sensitive"), "sensitive").when(F.col("stored"), "duplicate").otherwise("imported")
    judged = judged.withColumn("status", status)
    entries = judged.where("status = 'imported'").select(
        F.concat(F.lit("imp-"), F.substring(F.sha2("key", 256), 1, 16)).alias("id"), "kind", "content", F.array_distinct(F.filter("tags", lambda t: t != "")).alias("tags"), F.lit("auto").alias("source"),
        F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("workspace"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"), F.lit(0).cast("long").alias("access_count"), F.lit(None).cast("long").alias("last_access_at"),
    )
    stats = judged.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("imported", "short", "sensitive", "duplicate")])
    return entries, stats


def strip_tags(html: Column) -> Column:
    return js_trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"\s+", " "))
