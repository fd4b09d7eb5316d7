"""Repeated byte strings by a cover of the suffixes.

A cover is a set of text positions such that any two equal strings of `length` bytes hold positions of it at equal
offsets: the property of a difference cover. This one is chosen by content (the least 32-byte tuple of each window, a
synchronizing set) and not by the residues of positions; it has 0.5 % of all positions, where a difference cover that
serves 400 bytes has 5 % at least. Sampled tuples are named by their hashes and counted; names that occur once end
there. The windows around the positions of one name are brought together, sorted by the hashes of their whole `length`
bytes, and neighbours in that order are compared. Names are not ranks, nothing recurses on them and no complete suffix
array is merged: the README gives the figures.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, scratch, small_batches, table
from .repeats import copy_classes, finish, in_bitmap, is_first, keyed, mark_repeats, runs_of, side, with_copies

LENGTH, TUPLE = 400, 32
#: Bytes of text hashed at a time; at most 2 ** POS_BITS, as positions share a word with tuple hashes.
SEGMENT, POS_BITS = 1 << 20, 21
#: Suffixes of one name that one task sorts (each of at most 2 * LENGTH bytes); beyond, windows are counted by Spark.
HOT = 50_000
BASE = 0x5851F42D4C957F2D
_RANDOM = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, SEGMENT + 1024)
        for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            seq = np.full(size, b, np.uint64)
            seq[0] = 1
            _POWERS[name] = np.multiply.accumulate(seq)
    return _POWERS["up"], _POWERS["down"]


def rolling(data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all strings of `size` bytes in data."""
    n = len(data)
    up, down = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64) if sums is None else sums
    np.cumsum(_RANDOM[data] * up[:n], out=sums[1:])
    return finish((sums[size:] - sums[:-size]) * down[: n - size + 1])


def cover(body: bytes, length: int = LENGTH, tuple_size: int = TUPLE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(names, lo, hi): names of the covered positions, and the first and last start of the windows each serves.

    Every window of `length` bytes is served by its least tuple, by hash and then by place; equal windows by equal
    names at equal offsets. Yields once per segment of the text.
    """
    n, width = len(body), length - tuple_size + 1
    low = np.uint64((1 << POS_BITS) - 1)
    for start in range(0, n - length + 1, SEGMENT):
        data = np.frombuffer(body, np.uint8, min(SEGMENT + length - 1, n - start), start)
        names = rolling(data, tuple_size)
        packed = (names & ~low) | np.arange(len(names), dtype=np.uint64)
        windows = len(data) - length + 1
        padded = np.full(-(-len(packed) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(packed)] = packed
        blocks = padded.reshape(-1, width)
        before = np.minimum.accumulate(blocks, axis=1).ravel()
        after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(after[:windows], before[width - 1 : width - 1 + windows]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], windows) - 1
        yield names[at[first]], first + start, last + start


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def _same_windows(bodies: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, flags of its windows that start in another place of these strings too."""
    hashes = []
    for i in range(0, len(bodies), 2048):
        part = bodies[i : i + 2048]
        joined = np.frombuffer(b"".join(part), np.uint8)
        rolled = rolling(joined, length)
        starts = np.cumsum([0, *map(len, part)])
        hashes += [rolled[s : s + len(b) - length + 1] for s, b in zip(starts, part, strict=False)]
    sizes = np.array([len(h) for h in hashes])
    flat = np.concatenate(hashes)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    same = np.concatenate([[False], ranked[1:] == ranked[:-1]])
    twice = np.empty(len(flat), bool)
    twice[order] = same | np.append(same[1:], False)
    return np.split(twice, np.cumsum(sizes)[:-1])


def repeated_spans(docs: DataFrame, bytes_: int, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, k1, lo, hi: starts lo to hi of windows that occur elsewhere; docs: doc_id, k1, body, distinct texts."""
    spark = docs.sparkSession

    def all_names() -> Callable[[bytes], np.ndarray]:
        none = [np.zeros(0, np.uint64)]
        return lambda body: np.concatenate(none + [n for n, _, _ in cover(body, length)])

    marks, hot_marks = (spark.sparkContext.broadcast(x) for x in mark_repeats(docs, all_names, bytes_, hot))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for doc, key, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for names, lo, hi in cover(body, length):
                    often = in_bitmap(hot_marks.value, names)
                    for i in np.flatnonzero(in_bitmap(marks.value, names)):
                        for col, v in zip(rows, (int(names[i : i + 1].view(np.int64)[0]), bool(often[i]), doc, key, int(lo[i]), body[lo[i] : hi[i] + length]), strict=True):
                            col.append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["name", "hot", "doc_id", "k1", "lo", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by name; whole groups of a name are compared, some thousand suffixes at a time."""

        def flush(names: list, docs_: list, keys: list, los: list, bodies: list) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            alone = {}
            for n in names:
                alone[n] = alone.get(n, 0) + 1
            keep = [i for i, n in enumerate(names) if alone[n] > 1]
            if keep:
                for i, twice in zip(keep, _same_windows([bodies[i] for i in keep], length), strict=True):
                    if twice.any():
                        for a, z in zip(*runs_of(twice), strict=True):
                            for col, v in zip(out, (docs_[i], keys[i], los[i] + int(a), los[i] + int(z)), strict=True):
                                col.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "k1", "lo", "hi"])

        held: list[list] = [[], [], [], [], []]
        for b in batches:
            for col, c in zip(held, b.columns, strict=True):
                col += c.to_pylist()
            cut = len(held[0])
            while cut and held[0][cut - 1] == held[0][-1]:
                cut -= 1
            if cut >= 4096 or (cut and len(held[0]) > 20_000):
                yield flush(*[c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held[0]:
            yield flush(*held)

    spans = "doc_id long, k1 long, lo long, hi long"
    row = ["name", "doc_id", "k1", "lo", "body"]
    sampled = docs.select("doc_id", "k1", "body").mapInArrow(suffixes, "name long, hot boolean, doc_id long, k1 long, lo long, body binary")
    if not hot_marks.value.any():
        return sampled.select(*row).repartition("name").sortWithinPartitions("name").mapInArrow(compare, spans)

    # names of more suffixes than a task sorts: their windows are hashed where they are and counted by partial sums
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, key, lo, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = rolling(np.frombuffer(body, np.uint8), length)
                n = len(h)
                yield pa.RecordBatch.from_arrays([_signed(h), pa.array([doc] * n, pa.int64()), pa.array([key] * n, pa.int64()), pa.array(np.arange(lo, lo + n), pa.int64())], ["h", "doc_id", "k1", "lo"])

    sampled = materialize(sampled, "suffixes")
    usual = sampled.where("not hot").select(*row).repartition("name").sortWithinPartitions("name").mapInArrow(compare, spans)
    wide = materialize(sampled.where("hot").select(*row[1:]).mapInArrow(windows, "h long, doc_id long, k1 long, lo long"), "hot-windows")
    again = materialize(wide.groupBy("h").count().where("count > 1").select("h"), "hot-again")
    return usual.unionByName(wide.join(side(again), "h").select("doc_id", "k1", "lo", F.col("lo").alias("hi")))


def _unite(lo: list[int], hi: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(zip(lo, hi, strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes), one row per input row.

    Null text is empty; texts under `length` bytes lose nothing; exact copies (repeated rows included) of longer texts
    lose all of theirs and are represented by one text in the search. Rows that share an id but not a text are kept
    apart by the text's key. Matches never cross documents. Equality of windows is that of 64-bit hashes under one
    name. Texts are hashed in segments, groups of one name larger than `hot` are counted by partial sums: no step
    gathers an unbounded group. Columns but the two named are not read; an empty table gives no rows.
    """
    base = keyed(docs, id_col, text_col)
    classes = copy_classes(base.select("doc_id", "k1", "k2").where(F.col("k1").isNotNull()))
    flagged = with_copies(base, classes)
    alone = flagged.where(is_first())
    bytes_ = base.agg(F.sum(F.length("body"))).first()[0] or 0
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        found = repeated_spans(alone.select("doc_id", "k1", "body"), bytes_, length, hot)
        spans = keep(materialize(found.groupBy("doc_id", "k1").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "spans"))
    keys = spans.select(F.col("doc_id").alias("__id"), F.col("k1").alias("__k"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("k1") == F.col("__k"))
    none = F.lit(None).cast("array<bigint>")
    rest = flagged.where("copies = 1")
    parts = side(keys)
    hit = rest.join(parts, on, "left_semi").join(spans.withColumnsRenamed({"doc_id": "__id", "k1": "__k"}), on).select("doc_id", "body", "copies", "lo", "hi")
    clean = rest.join(parts, on, "left_anti").select("doc_id", "body", "copies", none.alias("lo"), none.alias("hi"))
    copied = flagged.where("copies > 1").select("doc_id", "body", "copies", none.alias("lo"), none.alias("hi"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            out: list[list] = [[], [], [], []]
            for body, copies, lo, hi in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                gone = [(0, len(body))] if copies > 1 and len(body) >= length else _unite(lo or [], [z + length for z in hi or []])
                kept, at = [], 0
                for a, z in gone:
                    kept.append(body[at:a])
                    at = z
                kept.append(body[at:])
                for col, v in zip(out, (len(body), sum(z - a for a, z in gone), len(gone), b"".join(kept)), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return hit.unionByName(clean).unionByName(copied).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
b AS (SELECT doc_id, hx, length(hx) // 2 AS n FROM t),
w AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 800)) AS h FROM (SELECT doc_id, hx, unnest(range(0, n - 399)) AS i FROM b WHERE n >= 400)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
fresh AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS starts FROM again),
run AS (SELECT doc_id, i, sum(starts) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM fresh),
span AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM run GROUP BY doc_id, k),
part AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS pz FROM span),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(hx, 2 * pz + 1, 2 * (a - pz)), '' ORDER BY a) AS kept FROM part JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN gone USING (doc_id)
"""
