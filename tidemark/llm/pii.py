"""Personal data by base patterns and a skip-chain conditional random field."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, column, small_batches, table

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Only texts with one of these can hold a span of any kind.
ANY = re.compile(r"[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# digit runs are taken whole: a match can't begin or end a part inside one
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens the field labels: runs without white space that hold a digit or an @.
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
#: Tokens as near as this many characters share a chain edge; tokens whose key is equal, a skip edge.
NEAR, MIN_KEY = 40, 7
#: Messages are passed until none moves by more than STILL (ROUNDS only ends a field that oscillates); beliefs above
#: SURE add spans. Chain edges weigh no more than CHAIN.
ROUNDS, STILL, SURE, CHAIN = 2000, 1e-4, 0.9, 1.0
#: About how many texts with a token, chosen by a hash of the text, the field is trained on (never more than twice as
#: many); texts of more tokens than FIT_TOKENS do not teach, copies of one count up to FIT_COPIES times. Everything else
#: reads all texts.
FIT_TEXTS, FIT_TOKENS, FIT_COPIES = 4000, 500, 32
#: Slots of the features, least tokens that must have a feature, descent steps, what a key's tie weighs before training,
#: the most a token's own features say against a label, and the precision of the features' prior.
SLOTS, RARE, STEPS, TIE, DOUBT, RIDGE = 1 << 15, 3, 300, 3.5, 4.0, 0.1
WORD_BEFORE, WORD_AFTER = re.compile(r"([^\W\d_]+)[\W_]*$"), re.compile(r"[\W_]*([^\W\d_]+)")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost non-overlapping per kind, by kind and start; failing matches are dropped."""
    out: list[tuple[str, int, int]] = []
    if not ANY.search(text):
        return out
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def _core(token: str) -> tuple[int, int]:
    """Offsets of the token without punctuation around it."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] == "+"):
        a += 1
    while b > a and not token[b - 1].isalnum():
        b -= 1
    return a, b


def _key(token: str) -> str:
    """What repeated or similar tokens share: the digits of a number, else the lower-cased letters and digits."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in token)
    key = digits if not letters else "".join(c for c in token.lower() if c.isalnum())
    return key if len(key) >= MIN_KEY else ""


def _shape(token: str) -> str:
    """A coarse shape, the unary feature: parts by kind of character, digit count in steps, checks that hold."""
    n = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    kind = "d" if not letters else ("x" if n * 2 < len(token) else "m")
    check = "L" if kind == "d" and 16 <= n <= 19 and luhn("".join(c for c in token if "0" <= c <= "9")) else ""
    return f"{kind}{min(n, 20) if kind == 'd' else min(n // 4, 3)}@{min(token.count('@'), 2)}.{min(token.count('.'), 4)}-{min(token.count('-'), 3)}{'+' if '+' in token else ''}{check}"


def tokens_of(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str, int]]:
    """(start, end, shape, key, label) of each token; label is 1 + the kind of the base span it touches, or 0.

    The parts of one span are one token, so a number written with blanks is compared whole.
    """
    holes = sorted((a, b, 1 + KINDS.index(k)) for k, a, b in spans)
    merged: list[list[int]] = []
    for a, b, k in holes:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, pos, i = [], 0, 0
    while True:
        m = TOKEN.search(text, pos)
        while i < len(merged) and merged[i][1] <= pos:
            i += 1
        if i < len(merged) and (not m or merged[i][0] < m.end()):
            a, b, k = merged[i]
            piece = text[a:b]
            out.append((a, b, _shape(piece.replace(" ", "")), _key(piece), k))
            pos = b
            i += 1
            continue
        if not m:
            return out
        a, b = _core(m[0])
        if b > a:
            piece = m[0][a:b]
            out.append((m.start() + a, m.start() + b, _shape(piece), _key(piece), 0))
        pos = m.end()


def chain_of(tokens: list[tuple[int, int, str, str, int]]) -> list[tuple[int, int]]:
    """(i, j) of neighbours that are near each other."""
    return [(j - 1, j) for j in range(1, len(tokens)) if tokens[j][0] - tokens[j - 1][1] <= NEAR]


def occurrences(tokens: list[tuple[int, int, str, str, int]]) -> list[list[int]]:
    """The tokens of each key that recurs. Similar: numbers that agree in their last ten digits, as with and without a
    country code."""
    held: dict[str, list[int]] = defaultdict(list)
    for j, (_, _, _, key, _) in enumerate(tokens):
        if key:
            held[key[-10:] if key.isdigit() and len(key) <= 15 else key].append(j)
    return [x for x in held.values() if len(x) > 1]


def features_of(text: str, tokens: list[tuple[int, int, str, str, int]]) -> list[list[int]]:
    """Feature slots of each token: its shape, the parts of the shape, and the words before and after it."""
    out = []
    for a, b, shape, _, _ in tokens:
        parts = re.split(r"(?=[@.\-+L])", shape)
        found = [f"shape {shape}", f"kind {shape[0]}", *(f"part {k} {x}" for k, x in enumerate(parts))]
        if m := WORD_BEFORE.search(text, max(0, a - 40), a):
            found.append(f"before {m[1].lower()}")
        if m := WORD_AFTER.match(text, b, b + 40):
            found.append(f"after {m[1].lower()}")
        out.append(sorted({crc32(x.encode()) % SLOTS for x in found}))
    return out


def evidence_of(tokens: list[tuple[int, int, str, str, int]]) -> tuple[list[int], list[int], list[int]]:
    """(visible, before, tied) for training: the label of a token, -1 if hidden; the visible label of its neighbour
    before it on the chain, and of the other occurrences of its key, -1 if there is none or they differ.

    Base spans are the labels. A token without one whose key has one elsewhere is hidden: that the base patterns miss it
    says nothing.
    """
    visible, tied = [t[4] for t in tokens], [-1] * len(tokens)
    for held in occurrences(tokens):
        shown = {visible[i] for i in held} - {0}
        if shown:
            for i in held:
                visible[i] = visible[i] or -1
        for i in held:
            others = {visible[j] for j in held if j != i and visible[j] >= 0} if len(held) < 50 else (shown or {0})
            tied[i] = next(iter(others)) if len(others) == 1 else -1
    before = [-1] * len(tokens)
    for i, j in chain_of(tokens):
        before[j] = visible[i]
    return visible, before, tied


def train_field(rows: list[tuple[list[list[int]], list[int], list[int], list[int]]], weights: list[int] | None = None) -> dict:
    """Potentials that maximise the pseudo-likelihood of the visible labels, each given its features, its neighbours and
    its key, with Gaussian priors; rows: (features, visible, before, tied) of a text.

    unary: slot -> weight by label; chain, skip: log-potentials by pair of labels. The prior of a skip edge ties equal
    labels (TIE), all others are centred at 0, so a corpus too small to teach keeps the ties and no opinion on shapes.
    """
    n = len(LABELS)
    y = np.array([v for r in rows for v in r[1]], np.int64)
    before, tied = (np.array([v for r in rows for v in r[k]], np.int64) for k in (2, 3))
    weight = np.repeat(np.ones(len(rows)) if weights is None else np.asarray(weights, float), [len(r[1]) for r in rows])
    sizes = [len(f) for r in rows for f in r[0]]
    slots = np.array([x for r in rows for f in r[0] for x in f], np.int64)
    token = np.repeat(np.arange(len(y)), sizes)
    keep = (y >= 0)[token] if len(y) else np.zeros(0, bool)
    slots, token = slots[keep], token[keep]
    often = np.bincount(slots, minlength=SLOTS) >= RARE
    used, at = np.unique(slots[often[slots]], return_inverse=True)
    token = token[often[slots]]
    # an edge is learned from both of its ends
    after = np.full(len(y), -1, np.int64)
    has = np.flatnonzero(before >= 0)
    after[has - 1] = y[has]
    known = np.flatnonzero(y >= 0)
    target = np.eye(n)[y[known]]
    prior = np.where(np.eye(n, dtype=bool), TIE, -TIE)
    w, chain, skip = np.zeros((len(used), n)), np.zeros((n, n)), prior.copy()
    seen = [np.full_like(x, 1e-8) for x in (w, chain, skip)]
    for _ in range(STEPS if len(known) else 0):
        logits = np.zeros((len(y), n))
        for k in range(n):
            logits[:, k] = np.bincount(token, weights=w[at, k], minlength=len(y))
        for near, table_ in ((before, chain), (after, chain), (tied, skip)):
            logits[near >= 0] += table_[near[near >= 0]]
        logits = logits[known]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        miss = np.zeros((len(y), n))
        miss[known] = (target - p) * weight[known, None]
        grads = [np.stack([np.bincount(at, weights=miss[token, k], minlength=len(used)) for k in range(n)], axis=1) - RIDGE * w, -chain, prior - skip]
        for near, g in ((before, 1), (after, 1), (tied, 2)):
            np.add.at(grads[g], near[near >= 0], miss[near >= 0])
        grads[1], grads[2] = ((g + g.T) / 2 for g in grads[1:])
        for x, g, s in zip((w, chain, skip), grads, seen, strict=True):
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    unary = np.zeros((SLOTS, n), np.float32)
    unary[used] = w
    return {"unary": unary, "chain": np.clip(chain, -CHAIN, CHAIN), "skip": skip}


def fit_field(texts: DataFrame, fit_texts: int = FIT_TEXTS) -> dict:
    """The field, trained on a bounded sample of the texts (column text); reruns choose the same."""
    rows = texts.where(F.col("text").rlike("[0-9@]"))
    part = min(1.0, fit_texts / max(1, rows.count()))
    slot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    kind = "h long, copies long, features array<array<int>>, visible array<int>, before array<int>, tied array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batched(batches):
            out: list[list] = [[], [], [], [], [], []]
            for h, copies, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = tokens_of(text, base_spans(text))
                if 0 < len(tokens) <= FIT_TOKENS:
                    for col, v in zip(out, (h, min(copies, FIT_COPIES), features_of(text, tokens), *evidence_of(tokens)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.list_(pa.int32()))), *(pa.array(c, pa.list_(pa.int32())) for c in out[3:])], ["h", "copies", "features", "visible", "before", "tied"])

    sample = rows.where(slot < int(part * (1 << 20)) + 1).groupBy(F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    found = sample.mapInArrow(run, kind).orderBy("h").limit(2 * fit_texts).toArrow()  # 2 * fit_texts texts of FIT_TOKENS tokens at most
    return train_field(list(zip(*(c.to_pylist() for c in found.columns[2:]), strict=True)), found.column("copies").to_pylist())


def crf_labels(tokens: list[tuple[int, int, str, str, int]], features: list[list[int]], field: dict) -> list[int]:
    """Labels by loopy belief propagation; base labels are observed. Only beliefs above SURE label a token.

    All occurrences of a key are tied to one variable of the key, a star, so edges grow with the tokens. A base match
    of any occurrence shows the key's label; where matches of one key differ, messages decide. Without recurring keys
    each chain edge moves a label's log-odds by 2 * CHAIN at most, so a text where no token comes within that of SURE
    keeps its base labels, which is what the field would say.
    """
    labels = [t[4] for t in tokens]
    n, keys = len(tokens), occurrences(tokens)
    unary = np.stack([field["unary"][f].sum(axis=0) for f in features]).astype(np.float64) if n else np.zeros((0, len(LABELS)))
    unary -= unary.max(axis=1, keepdims=True)
    unary -= np.log(np.exp(unary).sum(axis=1, keepdims=True))
    # what the base patterns never match may still be personal data they miss, so its odds are bounded
    unary = np.maximum(unary, -DOUBT)
    most = np.log(SURE / (1 - SURE)) - 4 * CHAIN
    if not keys and all(k or u[1:].max() - u[0] < most for k, u in zip(labels, unary, strict=True)):
        return labels
    shown = [{labels[i] for i in held} - {0} for held in keys]
    known = labels + [next(iter(x)) if len(x) == 1 else 0 for x in shown]
    unary = np.concatenate([unary, np.zeros((len(keys), len(LABELS)))])
    for i, k in enumerate(known):
        if k:
            unary[i] = -1e6  # no number of neighbours outvotes what is observed
            unary[i, k] = 0.0
    edges = [(i, j, "chain") for i, j in chain_of(tokens)] + [(i, n + h, "skip") for h, held in enumerate(keys) for i in held]
    belief = unary.copy()
    if edges:
        src = np.array([i for i, _, _ in edges] + [j for _, j, _ in edges])
        dst = np.array([j for _, j, _ in edges] + [i for i, _, _ in edges])
        m = len(edges)
        pot = np.stack([field[kind] for _, _, kind in edges] * 2)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, len(LABELS)))
        for _ in range(ROUNDS):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            x = (belief[src] - msg[back])[:, :, None] + pot
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - msg).max()
            msg = 0.5 * msg + 0.5 * new
            if moved < STILL:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    return [k or (int(p[i].argmax()) if p[i].max() >= SURE else 0) for i, k in enumerate(labels)]


def find_spans(text: str | None, field: dict) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind and start."""
    text = text or ""
    if not ANY.search(text):
        return [], []
    base = base_spans(text)
    tokens = tokens_of(text, base)
    added = [(KINDS[k - 1], t[0], t[1]) for t, k in zip(tokens, crf_labels(tokens, features_of(text, tokens), field), strict=True) if k and not t[4]]
    return base, sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets, as [EMAIL]."""
    if not text or not spans:
        return text
    out, pos = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= pos:
            out += [text[pos:a], f"[{k.upper()}]"]
        pos = max(pos, b)
    return "".join([*out, text[pos:]])


def detect(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (digest), spans (digest), redacted; one row per input row.

    Null and empty texts have no spans; a null text stays null when redacted. Offsets count code points. Rows that
    repeat are searched alike; an empty table gives no rows; columns but the two named are not read, so extra ones
    can't clash. Texts are searched whole, in time linear in their length but for message passing, whose rounds each
    take time linear in the tokens of one document.
    """
    small_batches(docs.sparkSession)
    base = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).cast("string").alias("text"))
    field = docs.sparkSession.sparkContext.broadcast(fit_field(base.select("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches):
            texts = batch.column(1).to_pylist()
            found = [find_spans(t, field.value) for t in texts]
            counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in KINDS]
            digests = [pa.array([digest(x[c]) for x in found], pa.string()) for c in (0, 1)]
            cleaned = pa.array([redact(t, x[1]) for t, x in zip(texts, found, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, *digests, cleaned], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "redacted"])

    return base.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base string, spans string, redacted string")


def redact_column(docs: DataFrame, text_col="text", chars_col="n_chars") -> DataFrame:
    """docs with personal data in text_col replaced, all other columns as they are; chars_col, if there, is recounted.

    Null texts stay null. Columns and their order stay.
    """
    small_batches(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs.select(column(text_col).cast("string").alias("text"))))

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, find_spans(t, field.value)[1]) if isinstance(t, str) else None)

    out = docs.withColumn(text_col, cleaned(column(text_col)))
    if chars_col in docs.columns:
        out = out.withColumn(chars_col, F.when(column(text_col).isNotNull(), F.length(column(text_col)).cast(docs.schema[chars_col].dataType)).otherwise(column(chars_col)))
    return out


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
