"""N-gram Jaccard join by token-combination prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, materialize, row_keys, scratch, small_batches, table
from .components import components
from .repeats import WordHashes, copy_classes, finish, gram_hashes, in_bitmap, is_first, keyed, mark_repeats, side, with_copies, word_hashes

NGRAM, PERCENT = 4, 85
#: Tokens in more sets than this are frequent and indexed in pairs, within this many groups by hash (more for large sets).
FREQUENT, GROUPS = 32, 32
#: Most sets, and about the most tokens, of a block; two blocks are compared at a time.
BLOCK, BLOCK_TOKENS = 1024, 400_000
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(body: bytes, cache: WordHashes, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; the whole sequence where there are fewer words."""
    w = word_hashes(body.translate(LOWER), cache)
    if len(w) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(w, n) if len(w) >= n else gram_hashes(w, len(w)) ^ np.uint64(len(w)))


def small_limits(percent: int = PERCENT, groups: int = GROUPS) -> tuple[int, int]:
    """Sets below the first size may have too few frequent tokens for pairs within groups; they and all sets that can
    link with one (up to the second size) index frequent tokens singly."""
    small = -(-(groups + 1) * 100 // percent)
    return small, (small - 1) * 100 // percent


def size_class(n: int, percent: int = PERCENT) -> int:
    """Sets that link are in one class or in neighbouring ones."""
    return math.floor(math.log(n) / math.log(100 / percent) + 1e-9)


def group_counts(n: int, percent: int = PERCENT, groups: int = GROUPS) -> list[int]:
    """The numbers of hash groups under which a set of n tokens indexes pairs: that of its size class and that of the
    next one, so that sets that link have one in common. It grows with the set, which keeps the pairs linear in it."""
    of_class = lambda c: max(groups, int((100 - percent) / 400 * (100 / percent) ** c))
    c = size_class(n, percent)
    return sorted({of_class(c), of_class(c + 1)})


def signatures(s: np.ndarray, shared: np.ndarray, frequent: np.ndarray, percent: int = PERCENT, groups: int = GROUPS) -> np.ndarray:
    """Signatures of a set; two sets that link share one.

    Tokens stand in a global order: those of one set only, rare ones, frequent ones, each by hash. The prefix is
    extended until the signatures it yields can't all be lost with the |s| - least overlap tokens that a linked set
    may lack: a rare token is a signature and is lost with itself; frequent tokens are indexed as pairs within a
    group, and g of them in a group are lost with g - 1. Tokens of no other set count, but need no index entry.
    """
    n = len(s)
    budget = n - (percent * n + 99) // 100 + 1
    two = in_bitmap(shared, s)
    alone = n - int(two.sum())
    if alone >= budget:
        return np.zeros(0, np.uint64)
    rest = s[two]
    often = in_bitmap(frequent, rest)
    rare = rest[~often][: budget - alone]
    need = budget - alone - len(rare)
    small, near_small = small_limits(percent, groups)
    out = [rare]
    if need > 0 and n <= near_small:
        out.append(finish(rest[often][:need] ^ np.uint64(0x1D872B41)))
    if need > 0 and n >= small:
        common = rest[often].tolist()
        for count in group_counts(n, percent, groups):
            pairs: list[int] = []
            held: dict[int, list[int]] = {}
            left = need
            for t in common:
                mates = held.setdefault((t >> 24) % count, [])
                if mates:
                    pairs += [(x * 0x9E3779B97F4A7C15 ^ t) + count & 0xFFFFFFFFFFFFFFFF for x in mates]
                    left -= 1
                mates.append(t)
                if left == 0:
                    break
            out.append(np.array(pairs, np.uint64))
    return np.unique(np.concatenate(out))


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Numbers of shared tokens of (left, right) sets; right None: of left with itself.

    They are exact: tokens of many of these sets are counted by a matrix product, the others by their few pairs.
    """
    own = right is None
    sets = left if own else [*left, *right]
    m, first = len(sets), len(left)
    owner = np.repeat(np.arange(m, dtype=np.int32), [len(x) for x in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(tokens)))
    width = m if own else m - first
    over = np.zeros((first, width), np.float32)
    for part in range(0, int((size > 24).sum()), 512):
        cols = np.flatnonzero(size > 24)[part : part + 512]
        x = np.zeros((m, len(cols)), np.float32)
        for c, k in enumerate(cols):
            x[owner[start[k] : start[k] + size[k]], c] = 1
        over += x[:first] @ (x if own else x[first:]).T
    for many in range(2, 25):
        at = start[size == many]
        if len(at):
            who = owner[at[:, None] + np.arange(many)]
            for a, b in combinations(range(many), 2):
                i, j = who[:, a], who[:, b]  # owners ascend within a token
                if not own:
                    across = (i < first) & (j >= first)
                    i, j = i[across], j[across] - first
                np.add.at(over, (i, j), 1)
                if own:
                    np.add.at(over, (j, i), 1)
    return over.astype(np.int32)


def linking(both: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which sets link, given shared tokens and whole sizes."""
    return (100 * both >= percent * (n_left + n_right - both)) & (both > 0)


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges (a, b): as many edges as tie the same nodes together."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for x, y in sorted(set(zip(a.tolist(), b.tolist(), strict=True))):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def block_units(members: DataFrame, contents: DataFrame, percent: int, block: int) -> DataFrame:
    """members: cluster, node, n, label, loose. unit, side (0 or 1), node, label, size, tokens: every two blocks of a
    cluster that may hold a link, but for those without a loose set.

    A block holds sets of one size class (linked sets are in one class or in neighbouring ones), at most `block` sets
    and BLOCK_TOKENS tokens or one set on average, dealt by a hash. A block alone is its own side 0.
    """
    sized = members.withColumn("class", F.floor(F.log("n") / F.lit(math.log(100 / percent)) + 1e-9).cast("int"))
    key = ["cluster", "class", "loose"]
    parts = sized.groupBy(*key).agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("int").alias("parts"))
    placed = materialize(sized.join(parts, key).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts", "n"), "blocks")
    one = placed.select("cluster", F.struct("class", "loose", "part").alias("b1")).distinct()
    two = one.withColumnRenamed("b1", "b2")
    meet = one.join(two, "cluster").where((F.col("b2") >= F.col("b1")) & (F.col("b2.class") <= F.col("b1.class") + 1) & (F.col("b1.loose") | F.col("b2.loose")))
    meet = meet.withColumn("unit", F.xxhash64("cluster", "b1", "b2"))
    sides = meet.select("cluster", "b1.*", "unit", F.lit(0).alias("side")).unionByName(meet.where("b1 <> b2").select("cluster", "b2.*", "unit", F.lit(1).alias("side")))
    return placed.join(sides, [*key, "part"]).join(contents, "node").select("unit", "side", "node", "label", "size", "tokens")


def _unit(held: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((nodes, labels) of either side, flags of linked pairs) of a unit; a set does not link with itself."""
    percent = held.column("percent")[0].as_py()
    side = held.column("side").to_numpy()
    parts = []
    for k in (0, 1):
        rows = held.filter(pa.array(side == k))
        parts.append((rows.column("node").to_numpy(), rows.column("label").to_numpy(), rows.column("size").to_numpy(), [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("tokens")]))
    own = not len(parts[1][0])
    a, b = parts[0], parts[0] if own else parts[1]
    linked = linking(overlaps(a[3], None if own else b[3]), a[2][:, None], b[2][None, :], percent)
    if own:
        np.fill_diagonal(linked, False)
    return a[:2], b[:2], linked


def link_sets(firsts: DataFrame, keep: Callable[[DataFrame], DataFrame], bytes_: int, ngram: int = NGRAM, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK, count: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sets: node, n; known: node, component, n_links of the sets that link), tables to keep. firsts: doc_id, body,
    distinct.

    1. Every set of a signature is compared with the least one of it. 2. Signatures whose sets are not in one component
    after that are open; their sets are compared across components, block by block. That finds all components. 3. If
    asked for, links are counted: within each component all sets are compared, block by block, and a row for each set
    and block is added up. The pairs themselves are never formed.
    """
    spark = firsts.sparkSession

    def tokens() -> Callable[[bytes], np.ndarray]:
        cache = WordHashes()
        return lambda body: shingles(body, cache, ngram)

    shared_bits, frequent_bits = (spark.sparkContext.broadcast(x) for x in mark_repeats(firsts, tokens, bytes_, frequent))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batched(batches):
            n, sigs = [], []
            for body in b.column(1):
                s = shingles(body.as_py(), cache, ngram)
                n.append(len(s))
                sigs.append(signatures(s, shared_bits.value, frequent_bits.value, percent).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["node", "n", "sigs"])

    indexed = keep(materialize(firsts.select("doc_id", "body").mapInArrow(index, "node long, n long, sigs array<long>"), "index"))
    sets = indexed.select("node", "n")
    posts = indexed.where(F.size("sigs") > 0).select(F.explode("sigs").alias("sig"), "node", "n")
    heads = materialize(posts.groupBy("sig").agg(F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("many")).where("many > 1"), "heads")
    held = materialize(posts.join(heads, "sig"), "posts")

    def contents_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for b in batched(batches):
            found = [shingles(body.as_py(), cache, ngram) for body in b.column(1)]
            two = [s[in_bitmap(shared_bits.value, s)].tobytes() for s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(two, pa.binary())], ["node", "size", "tokens"])

    nodes = side(held.select(F.col("node").alias("doc_id")).distinct())
    contents = materialize(firsts.select("doc_id", "body").join(nodes, "doc_id", "left_semi").mapInArrow(contents_, "node long, size long, tokens binary"), "contents")

    # 1. each set against the head of each of its signatures
    alike = F.least("n", "head.n") * 100 >= percent * F.greatest("n", "head.n")
    pairs = held.where((F.col("node") != F.col("head.node")) & alike).select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()
    of = lambda x: contents.select(F.col("node").alias(x), F.col("size").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_t"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            x, y = ([np.frombuffer(t.as_buffer(), np.uint64) for t in b.column(c)] for c in (4, 5))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(linking(both, b.column(2).to_numpy(), b.column(3).to_numpy(), percent)))

    links = materialize(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_n", "b_n", "a_t", "b_t").mapInArrow(compare, "a long, b long"), "links")
    first = components(links)

    # 2. what is open: signatures of three sets or more, not all in one component
    label = F.coalesce("component", "node")
    labelled = held.where("many > 2").join(side(first), "node", "left").select("sig", "node", "n", label.alias("label"))
    open_ = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("sig", "lo")
    rest = materialize(labelled.join(open_, "sig"), "open")
    joined = first
    if not rest.isEmpty():
        clusters = components(rest.select(F.col("label").alias("a"), F.col("lo").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("component").alias("cluster"))
        members = rest.select("node", "n", "label").distinct().join(side(clusters), "label")
        # most of a cluster may be one component already: its sets need no comparison with each other
        main = members.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
        members = members.join(main, "cluster").select("cluster", "node", "n", "label", (F.col("label") != F.col("main")).alias("loose"))

        def across(held: pa.Table) -> pa.Table:
            a, b, linked = _unit(held)
            i, j = np.nonzero(linked & (a[1][:, None] != b[1][None, :]))
            ties = forest(a[1][i], b[1][j])
            return pa.table({"a": pa.array([x for x, _ in ties], pa.int64()), "b": pa.array([y for _, y in ties], pa.int64())})

        units = block_units(members, contents, percent, block).withColumn("percent", F.lit(percent))
        more = materialize(units.groupBy("unit").applyInArrow(across, "a long, b long"), "ties")
        joined = components(links.unionByName(more))

    # 3. links of each set within its component
    known = materialize(joined.join(sets, "node"), "linked")
    if not count:
        return sets, keep(known).select("node", "component")
    size = known.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    sized = known.join(side(size), "component")
    members = sized.where("k > 2").select(F.col("component").alias("cluster"), "node", "n", F.lit(0).cast("long").alias("label"), F.lit(True).alias("loose"))

    def counted(held: pa.Table) -> pa.Table:
        a, b, linked = _unit(held)
        node, n = a[0], linked.sum(axis=1)
        if len(b[0]) and b[0] is not a[0]:
            node, n = np.concatenate([node, b[0]]), np.concatenate([n, linked.sum(axis=0)])
        return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(n, pa.int64())})

    units = block_units(members, contents, percent, block).withColumn("percent", F.lit(percent))
    many = units.groupBy("unit").applyInArrow(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("n_links"))
    counts = many.unionByName(sized.where("k = 2").select("node", F.lit(1).cast("long").alias("n_links")))
    return sets, keep(materialize(known.select("node", "component").join(counts, "node"), "counts"))


def jaccard_join(docs: DataFrame, id_col="doc_id", text_col="text", ngram: int = NGRAM, percent: int = PERCENT, frequent: int = FREQUENT, block: int = BLOCK, count: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, one row per input row.

    Sets of ngram-word shingles link when 100 * overlap >= percent * union. component_id is the smallest doc_id
    reachable by links; n_links counts the other distinct texts a document's text links to (null if `count` is off,
    which saves comparing all sets of a component). Texts without words (null, empty) link with nothing, not even each
    other: component_id is their own id. Rows with equal texts are one class, represented by the smallest id and never
    paired among themselves; a null id counts as largest. Rows that share an id, or have none, are joined each by its
    own text. Very long texts are one set like others. Columns but the two named are not read, so extra ones can't
    clash; an empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    numbered, ids = row_keys(texts, "doc_id", "text")
    base = keyed(numbered, "key", "text")
    flagged = with_copies(base, copy_classes(base.select("doc_id", "k1", "k2")))
    firsts = flagged.where(is_first())
    bytes_ = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    if ids is not None:  # rows that repeat have one key
        firsts = firsts.dropDuplicates(["doc_id"])
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession) as keep:
        sets, known = link_sets(firsts, keep, bytes_, ngram, percent, frequent, block, count)
    links = F.coalesce("n_links", F.lit(0).cast("long")) if count else F.lit(None).cast("long").alias("n_links")
    classes = sets.join(side(known), "node", "left").select(F.col("node").alias("first"), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"), links.alias("n_links"))
    rows = flagged.select("doc_id", F.coalesce("first", "doc_id").alias("first"))
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = rows.join(classes, "first").select("doc_id", "n_shingles", own.alias("component_id"), "n_links")
    if ids is None:
        return out
    of = lambda name: ids.select(F.col("key").alias(name), F.col("id").alias(f"{name}_id"))
    return out.join(of("doc_id"), "doc_id").join(of("component_id"), "component_id").select(F.col("doc_id_id").alias("doc_id"), "n_shingles", F.col("component_id_id").alias("component_id"), "n_links")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS reach FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach),
c AS (SELECT node, min(reach) AS component FROM r GROUP BY node),
k AS (SELECT e.a AS node, count(DISTINCT y.text) FILTER (y.text <> x.text) AS n_links FROM e JOIN documents x ON x.doc_id = e.a JOIN documents y ON y.doc_id = e.b GROUP BY e.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, d.doc_id)::BIGINT AS component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id LEFT JOIN k ON k.node = d.doc_id
"""
