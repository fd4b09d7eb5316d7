"""Quality classifier: a weak-label model over heuristic labellers trains a hashed linear scorer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, column, materialize, small_batches, table

#: Most labelled rows the word list of toxic language is learned from; most documents the scorer is fitted on.
LEXICON_DOCS, FIT_DOCS = 6000, 6000
#: Words of that list: least toxic documents (copies of one text count once), least part of all toxic ones, least share of toxic among the labelled documents that hold it, most words.
LEXICON_MIN, LEXICON_PART, LEXICON_SHARE, LEXICON_WORDS = 5, 0.01, 0.95, 400
#: Lengths of the word beginnings that stand in the list and the scorer beside whole words, as `begin*`.
BEGINNINGS = (5, 6, 7)
#: Slots of the scorer, the first of them for bias and statistics, L1 penalty, descent steps, and the score from which a document is rejected.
SLOTS, STAT_SLOTS, PENALTY, STEPS, REJECT = 1 << 18, 1 << 12, 1e-4, 400, 0.5
#: Words in fewer documents of the sample than this, or in more than this part of them, teach nothing.
RARE, COMMON = 3, 0.3
EM_ROUNDS = 100
SYMBOLS = "#*$%&|<>"
EDGES = re.compile(r"^\W+|\W+$")
#: The ASCII characters among those marks.
MARKS = "".join(c for c in map(chr, range(128)) if EDGES.match(c))


def _vote(bad: bool, good: bool = False) -> str:
    return "1" if bad else ("0" if good else "-")


def statistics(text: str) -> dict[str, float]:
    words = text.split()
    n = max(1, len(words))
    chars = max(1, sum(map(len, words)))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "n": len(words),
        "symbols": sum(map(text.count, SYMBOLS)) / chars,
        "upper": sum(map(str.isupper, words)) / n,
        "again": sum(map(eq, words, words[1:])) / n,
        "dup": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "bars": words.count("|") / n,
        "marks": (text.count("!") + text.count("?")) / n,
        "distinct": len(set(words)) / n,
        "sentences": sum(map(text.count, ".!?")) / n,
        "digits": sum(map(text.count, "0123456789")) / chars,
    }


def votes(s: dict[str, float], toxic: bool) -> str:
    """One character for each heuristic labeller: 1 bad, 0 good, - none."""
    n = s["n"]
    plain = s["symbols"] == 0 and s["upper"] < 0.3 and s["again"] < 0.1
    return "".join(
        (
            _vote(n == 0),
            _vote(s["symbols"] > 0.03),
            _vote(s["upper"] > 0.5 and n >= 5),
            _vote(s["again"] > 0.2 and n >= 5),
            _vote(s["dup"] > 0.5),
            _vote(s["bars"] > 0.1),
            _vote(s["marks"] > 0.4 and n >= 5),
            _vote(n >= 50 and s["distinct"] < 0.2),
            _vote(s["digits"] > 0.3),
            _vote(toxic),
            _vote(False, plain and 0.01 < s["sentences"] <= 1),
            _vote(False, plain and n >= 20 and s["distinct"] > 0.3 and s["dup"] < 0.1),
        )
    )


#: Place of the labeller of toxic language.
TOXIC = 9
LABELLERS = len(votes(statistics(""), False))


class WordReader:
    """Whether a text holds a listed word, and the slots of its words and word beginnings, marks around words off.

    lexicon: words, and beginnings as `begin*`. weighs: a byte for each slot, 0 if it is not to be returned; None for all. Words that say nothing are kept
    in a set that a text's words are cut by at once, what the others say in a table; both start anew when full.
    """

    def __init__(self, lexicon: frozenset[str], weighs: bytes | None = None, slots: bool = True, limit: int = 300_000):
        self.words, self.begins = lexicon, frozenset(x[:-1] for x in lexicon if x.endswith("*"))
        self.weighs, self.slots, self.limit = weighs, slots, limit
        self.dull: set[str] = set()
        self.said: dict[str, tuple[bool, tuple[int, ...]]] = {}
        self.begin_slots: dict[str, int] = {}

    def slot(self, form: str) -> int:
        """The form's slot, or -1 where it weighs nothing."""
        k = STAT_SLOTS + crc32(form.encode("utf-8", "replace")) % (SLOTS - STAT_SLOTS)
        return k if self.weighs is None or self.weighs[k] else -1

    def begin_slot(self, begin: str) -> int:
        k = self.begin_slots.get(begin)
        if k is None:
            k = self.begin_slots[begin] = self.slot(begin + "*")
        return k

    def read(self, word: str) -> tuple[bool, tuple[int, ...]] | None:
        w = word if word.isascii() or word.isalpha() else EDGES.sub("", word)
        begins = [w[:k] for k in BEGINNINGS if len(w) > k]
        listed = w in self.words or not self.begins.isdisjoint(begins)
        slots = tuple(k for k in (self.slot(w), *map(self.begin_slot, begins)) if k >= 0) if self.slots else ()
        if max(len(self.dull), len(self.said), len(self.begin_slots)) >= self.limit:
            for kept in (self.dull, self.said, self.begin_slots):
                kept.clear()
        if not listed and not slots:
            self.dull.add(word)
            return None
        out = self.said[word] = listed, slots
        return out

    def __call__(self, text: str) -> tuple[bool, set[int]]:
        if not self.slots and not self.words:
            return False, set()
        toxic, slots = False, set()
        for word in {w.strip(MARKS) for w in set(text.lower().split())} - self.dull:
            if says := self.said.get(word) or self.read(word):
                toxic = toxic or says[0]
                slots.update(says[1])
        return toxic, slots


def slots_of(word_slots: set[int], s: dict[str, float], voted: str) -> list[int]:
    """Slots of the words, the votes and the statistics, in steps."""
    out = set(word_slots)
    for name, x in s.items():
        if name != "n":
            step = 0 if x == 0 else 1 + min(9, int(x * 10)) if x >= 0.1 else (1 if x >= 0.03 else 0)
            out.add(1 + crc32(f"{name}:{step}".encode()) % (STAT_SLOTS - 1))
    out.update(1 + crc32(f"vote {k}:{v}".encode()) % (STAT_SLOTS - 1) for k, v in enumerate(voted))
    out.add(0)  # the bias
    return sorted(out)


def toxic_words(docs: DataFrame, labels: DataFrame, limit: int = LEXICON_DOCS) -> list[str]:
    """Words and word beginnings that nearly only documents labelled toxic hold, from at most `limit` labelled rows (by id hash)."""
    ids = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    least = max(LEXICON_MIN, LEXICON_PART * (ids.agg(F.sum("toxic")).first()[0] or 0))
    held = docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).join(F.broadcast(ids), "doc_id")  # `limit` rows of two numbers at most
    words = F.array_distinct(F.transform(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")))
    forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, *[F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit("*"))).otherwise(w) for k in BEGINNINGS]))))
    found = held.select("copy", "toxic", F.explode(forms).alias("w")).where("w <> ''").groupBy("w").agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("toxic") == 1, F.col("copy"))).alias("texts"))
    top = found.where((F.col("texts") >= least) & (F.col("t") >= LEXICON_SHARE * F.col("n"))).orderBy(F.desc("texts"), "w").limit(LEXICON_WORDS)
    return sorted(r["w"] for r in top.collect())


def fit_label_model(patterns: list[tuple[str, int]]) -> dict[str, float]:
    """Posterior of bad for each vote pattern, by expectation-maximisation over (pattern, documents) counts.

    A document is good, junk or toxic; given that, each labeller has its own chance of each vote (bad, good, none),
    and labellers vote independently. The last character is the gold label where there is one (g, j, t); rows that
    have it keep it and so anchor the classes. The others start from the votes: the labeller of toxic language first,
    then any other vote for bad.
    """
    if not patterns:
        return {}
    code = {"1": 0, "0": 1, "-": 2}
    x = np.array([[code[c] for c in p[:-1]] for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    gold = np.array(["gjt".find(p[-1]) for p, _ in patterns])
    known = gold >= 0
    start = np.where(x[:, TOXIC] == 0, 2, np.where((x == 0).any(axis=1), 1, 0))
    post = np.full((len(x), 3), 0.05)
    post[np.arange(len(x)), np.where(known, gold, start)] = 0.9
    for _ in range(EM_ROUNDS):
        w = n[:, None] * post
        logs = np.log((w.sum(axis=0) + 0.5) / (w.sum() + 1.5)) + np.zeros_like(post)
        for j in range(x.shape[1]):
            for side in range(3):
                chance = np.bincount(x[:, j], weights=w[:, side], minlength=3) + 0.5
                logs[:, side] += np.log(chance / chance.sum())[x[:, j]]
        new = np.exp(logs - logs.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        new[known] = post[known]
        moved = np.abs(new - post).max()
        post = new
        if moved < 1e-6:
            break
    return {p: float(1 - v) for (p, _), v in zip(patterns, post[:, 0], strict=True)}


def fit_scorer(at: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Weights of a logistic scorer with an L1 penalty, by accelerated proximal descent. at: the slots of all rows, one
    after the other; sizes: how many each row has. Rows are summed in parts, so little is held beside them."""
    w, rows = np.zeros(SLOTS), len(sizes)
    if not rows:
        return w
    in_docs = np.bincount(at, minlength=SLOTS)
    teaches = (in_docs >= RARE) & (in_docs <= COMMON * rows)
    teaches[:STAT_SLOTS] = True
    used = np.flatnonzero(teaches & (in_docs > 0))
    place = np.full(SLOTS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    ends = np.cumsum(sizes)
    parts = []  # (first row, places, row of each place) of some hundred rows
    for first in range(0, rows, 500):
        last = min(rows, first + 500)
        own = place[at[ends[first] - sizes[first] : ends[last - 1]]]
        row = np.repeat(np.arange(last - first, dtype=np.int32), sizes[first:last])
        parts.append((first, own[own >= 0], row[own >= 0]))
    x, y, t = np.zeros(len(used)), np.zeros(len(used)), 1.0
    step = 4 * rows / sum(len(own) for _, own, _ in parts)  # the mean squared norm of a row bounds the curvature
    bias_free = used == 0
    for _ in range(STEPS):
        grad = np.zeros(len(used))
        for first, own, row in parts:
            want = target[first : first + 500]
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=y[own], minlength=len(want)), -30, 30)))
            grad += np.bincount(own, weights=(p - want)[row], minlength=len(used))
        new = y - step * grad / rows
        new = np.where(bias_free, new, np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    w[used] = x
    return w


def score_of(slots: list[int], weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[slots].sum(), -30, 30))))


def classify(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", fit_docs=FIT_DOCS, carry: str | None = None) -> DataFrame:
    """doc_id, votes, p_bad (posterior of the label model), score, kept and the bigint column carry, if given; one row
    per input row.

    Labellers vote on every document; their accuracies are estimated over the vote patterns of the whole corpus,
    anchored by the labels (quality 0 or toxic 1: bad) where they exist. The posteriors then train the scorer on about
    fit_docs documents chosen by a hash of the id; it scores every document. Null and empty texts are rejected: they
    hold nothing to train on. Empty tables give no rows; without labels the heuristics stand alone. Labels that
    repeat count once, the worst first; rows that repeat are judged alike. Very long texts are read whole, in time
    linear in their length. Columns but those named are not read, so extra ones can't clash.
    """
    small_batches(docs.sparkSession)
    columns = [column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text")]
    base, more = docs.select(*columns), [carry] if carry else []
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    lexicon = frozenset(toxic_words(base, labels))

    def voting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader(lexicon, slots=False)
        for b in batched(batches):
            out = [votes(statistics(t or ""), read(t or "")[0]) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "votes"])

    gold = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.when(F.max("toxic") == 1, "t").when(F.min("quality") == 0, "j").when(F.min("quality") == 1, "g").alias("gold")
    )
    voted = materialize(base.mapInArrow(voting, "doc_id long, votes string"), "votes")
    counted = voted.join(gold, "doc_id", "left").groupBy(F.concat("votes", F.coalesce("gold", F.lit("-"))).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    patterns = sorted((r["p"], r["n"]) for r in counted.collect())  # 3 ** (LABELLERS + 1) rows at most, in practice some hundred
    posterior = fit_label_model(patterns)

    def sampling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = WordReader(lexicon)
        for b in batched(batches):
            voted, slots = [], []
            for t in b.column(1).to_pylist():
                s = statistics(t or "")
                toxic, of_words = read(t or "")
                voted.append(votes(s, toxic))
                slots.append(slots_of(of_words, s, voted[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(voted, pa.string()), pa.array(slots, pa.list_(pa.int32()))], ["doc_id", "h", "votes", "slots"])

    # the texts are read where they are; what they came to is ordered by hash and cut, so reruns choose the same
    part = min(1.0, fit_docs / max(1, voted.count()))
    chosen = base.select("doc_id", "text", F.xxhash64("doc_id").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(part * (1 << 20)) + 1))
    taken = chosen.mapInArrow(sampling, "doc_id long, h long, votes string, slots array<int>").orderBy("h", "votes", "slots").limit(2 * fit_docs)
    sampled = taken.join(gold, "doc_id", "left").toArrow().sort_by([("doc_id", "ascending"), ("votes", "ascending")])
    # a pattern with a label unseen so far falls back to the one without
    seen = zip(sampled.column("votes").to_pylist(), sampled.column("gold").to_pylist(), strict=True)
    target = np.array([posterior.get(v + (g or "-"), posterior.get(v + "-", 0.5)) for v, g in seen])
    slots = sampled.column("slots").combine_chunks()
    del sampled
    weights = fit_scorer(slots.flatten().to_numpy(), slots.value_lengths().to_numpy(), target).astype(np.float32)
    del slots
    pa.default_memory_pool().release_unused()
    used = np.flatnonzero(weights)
    sparse = (used.astype(np.int32), weights[used])

    def scoring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(SLOTS, dtype=np.float32)
        w[sparse[0]] = sparse[1]
        read = WordReader(lexicon, (w != 0).tobytes())  # most slots weigh nothing, so most words have none to add
        for b in batched(batches):
            out = []
            for t in b.column(1).to_pylist():
                s = statistics(t or "")
                toxic, of_words = read(t or "")
                v = votes(s, toxic)
                score = score_of(slots_of(of_words, s, v), w)
                out.append((v, posterior.get(v + "-", 0.5), score, bool(s["n"]) and score < REJECT))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))), *b.columns[2:]], ["doc_id", "votes", "p_bad", "score", "kept", *more])

    return docs.select(*columns, *(column(c).cast("long").alias(c) for c in more)).mapInArrow(scoring, ", ".join(["doc_id long, votes string, p_bad double, score double, kept boolean", *(f"{c} long" for c in more)]))


def op8_quality_model(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
