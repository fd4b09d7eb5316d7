"""Quality rules: a learned decision list over text statistics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, column, materialize, table

#: Base rules: fewer words than this, or over half of them in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Statistics the rules may test, as (name, expression over the counts).
STATS = {
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
}
#: Thresholds tried for a statistic: this many quantiles of the labelled rows.
CUTS = 64
#: Most rules, most conditions in a rule, least rows a rule must cover, least precision it must keep on the pruning rows.
MAX_RULES, MAX_CONDITIONS, MIN_COVER, MIN_PRECISION = 12, 3, 3, 0.9


@dataclass(frozen=True)
class Condition:
    stat: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.stat) > self.cut if self.above else F.col(self.stat) <= self.cut

    def __str__(self) -> str:
        return f"{self.stat} {'>' if self.above else '<='} {self.cut:.6g}"


def rule_column(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _words(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""), F.array().cast("array<string>"))


def _repeat_words(h: Column) -> Column:
    """Words in 3-word windows that occur twice or more, from the word hashes."""

    def over(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.cast("int").alias("p"))))
        starts = bind(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: equals(s, x, i - 1) | equals(s, x, i + 1)), lambda x: x["p"])))
        return bind(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x))

    def equals(s: Column, x: Column, at: Column) -> Column:
        return F.coalesce(x["g"] == F.get(s, at)["g"], F.lit(False))

    grams = F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
    # texts without a repeated window, the common case, need no sorting
    count = bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(over(g)))
    return F.when(F.size(h) < 3, F.lit(0)).otherwise(count)


def text_stats(docs: DataFrame, text_col="text") -> DataFrame:
    """docs with a struct column `stats`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (the base) and
    n_lines, n_upper, n_marks, n_digits. Null text counts as empty: all are 0. Each text is read whole."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    less = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
    # `[\x20\x09-\x0D]` is what rlike finds around a word
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def build(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            less("#*$%&|<>").alias("n_symbols"),
            bind(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("lines"),
            bind(h, _repeat_words).cast("long").alias("n_repeat_words"),
            less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
            less("!?").alias("n_marks"),
            less("0123456789").alias("n_digits"),
        )

    s = docs.withColumn("__s", bind(_words(text), build))
    return s.withColumn(
        "stats",
        F.struct(*[F.col(f"__s.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols")], F.col("__s.lines.dup").alias("n_dup_lines"), F.col("__s.n_repeat_words").alias("n_repeat_words"), F.col("__s.lines.n").alias("n_lines"), *[F.col(f"__s.{c}").alias(c) for c in ("n_upper", "n_marks", "n_digits")]),
    ).drop("__s")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(v).cast("double") for k, v in STATS.items()})


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, list[tuple[int, int, int]]]:
    """For each statistic, (bin, bad, good) of the rows, where bin counts the cuts below the value: one small job."""
    bins = F.array(*[F.struct(F.lit(k).alias("stat"), F.size(_below(cut, k)).alias("bin")) for k, cut in cuts.items() if cut])
    got = rows.select("bad", F.explode(bins).alias("b")).groupBy("b.stat", "b.bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).collect()  # statistics x (CUTS + 1) rows at most
    out: dict[str, list[tuple[int, int, int]]] = {k: [] for k in cuts}
    for r in got:
        out[r["stat"]].append((r["bin"], r["bad"], r["good"]))
    return out


def _below(cut: list[float], stat: str) -> Column:
    return F.filter(F.array(*[F.lit(c) for c in cut]), lambda c: c < F.col(stat))


def _best_condition(counts: dict, cuts: dict, bad: int, good: int) -> tuple[float, Condition | None]:
    """The condition with the most FOIL gain over rows with these totals."""
    best: tuple[float, Condition | None] = (0.0, None)
    base = math.log2(bad / (bad + good)) if bad else 0.0
    for stat in sorted(counts):
        for j, cut in enumerate(cuts[stat]):
            up = [sum(x[1 + side] for x in counts[stat] if x[0] > j) for side in (0, 1)]  # value > cuts[j]
            for above, (p, n) in ((True, up), (False, (bad - up[0], good - up[1]))):
                if p >= MIN_COVER:
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(stat, above, cut))
    return best


def _widest(rows: DataFrame, c: Condition) -> Condition:
    """The same split with its cut halfway between the nearest good row outside and the nearest bad row inside."""
    x = F.col(c.stat)
    inside, outside = c.column() & (F.col("bad") == 1), ~c.column() & (F.col("bad") == 0)
    a, b = rows.agg(F.min(F.when(inside, x)) if c.above else F.max(F.when(inside, x)), F.max(F.when(outside, x)) if c.above else F.min(F.when(outside, x))).first()
    return c if a is None or b is None else Condition(c.stat, c.above, (a + b) / 2)


def learn_rules(labelled: DataFrame) -> list[list[Condition]]:
    """An ordered list of rules that reject, learned from all labelled rows (columns: STATS, bad 0/1, fold 0..2).

    Sequential covering: a rule grows on folds 0 and 1 by the condition of most FOIL gain until it covers no good row;
    pruning then drops final conditions while (bad - good) / (bad + good) on fold 2 does not fall; rows it covers go,
    and the next rule grows. Learning stops at the first rule whose precision on the pruning rows is under
    MIN_PRECISION, or when no bad rows remain. Without labelled bad rows there are no rules. Ties go to the first
    statistic by name and the lowest threshold; a chosen cut then moves to the middle of the gap it lies in. Only counts per (statistic, bin) come to the driver.
    """
    rows = materialize(labelled.select("bad", "fold", *STATS), "rules")
    quantiles = rows.select(*[F.percentile_approx(k, [i / CUTS for i in range(1, CUTS)], 10_000).alias(k) for k in STATS]).first()
    cuts = {k: sorted({float(x) for x in quantiles[k] or []}) for k in STATS}
    rules: list[list[Condition]] = []
    left = rows
    totals = lambda df: tuple(int(x or 0) for x in df.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first())
    while len(rules) < MAX_RULES:
        grow, rule = left.where("fold < 2"), []
        bad, good = totals(grow)
        while bad >= MIN_COVER and good and len(rule) < MAX_CONDITIONS:
            _, found = _best_condition(_counts(grow, cuts), cuts, bad, good)
            if found is None:
                break
            found = _widest(grow, found)
            rule.append(found)
            grow = grow.where(found.column())
            bad, good = totals(grow)
        if not rule:
            break
        held = left.where("fold = 2")
        firsts = held.agg(*[f(F.when(rule_column(rule[: k + 1]), v)).alias(f"{n}{k}") for k in range(len(rule)) for n, f, v in (("b", F.sum, F.col("bad")), ("g", F.sum, 1 - F.col("bad")))]).first()
        worth = []
        for k in range(len(rule)):
            p, n = int(firsts[f"b{k}"] or 0), int(firsts[f"g{k}"] or 0)
            worth.append(((p - n) / (p + n) if p + n else -1.0, p, n))
        keep = max(range(len(rule)), key=lambda k: (worth[k][0], -k))
        _, p, n = worth[keep]
        if p + n == 0 or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[: keep + 1])
        left = left.where(~rule_column(rule[: keep + 1]))
    return rules


def decision(rules: list[list[Condition]]) -> Column:
    """0 where no rule fires, else the number of the first that does, as one CASE in rule order."""
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(rule_column(rule), k) if out is None else out.when(rule_column(rule), k)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, list[list[Condition]]]:
    """(judged, rules). judged: doc_id, the counts, base_failed, rule (0: none) and kept, one row per input row.

    labels (doc_id, quality 0/1) may cover any part of the documents; labels for an id twice count once, worst first;
    null labels do not count. Documents the base rules fail neither teach nor reach the learned list. Null or empty
    texts fail the base rules. Rows that repeat are judged alike; very long texts are read whole. Columns but the two
    named are not read, so extra ones can't clash; an empty table gives no rows and no rules.
    """
    read = docs.select(column(id_col).alias("doc_id"), column(text_col).cast("string").alias("text"))
    counted = materialize(text_stats(read).select("doc_id", "stats.*"), "stats")
    bad = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).cast("int").alias("bad"))
    judged = with_stats(counted.withColumn("base_failed", base_failed()))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold")
    rules = learn_rules(judged.where("not base_failed").join(bad, "doc_id").select("bad", fold, *STATS))
    rule = F.when(F.col("base_failed"), 0).otherwise(decision(rules))
    return judged.withColumn("rule", rule).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged, _ = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
