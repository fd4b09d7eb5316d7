"""Text as column expressions: tokens, character features, hashes, sizes, similarity. All of it stays in the JVM but
NFKC, which Spark lacks; it runs once, at ingestion."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# English function words that are no tokens.
STOP_WORDS = (
    "the a an is are was were be been being of to and or for with in on at by from as it its this that these those "
    "he she they we you your his her their have has had do does did not no but so if then than too very can will just "
    "should would could"
).split()

# Code-point ranges that count as CJK.
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{f900}-\x{faff}\x{20000}-\x{2ffff}]"

# Seeds of the 16 minhash dimensions.
MINHASH_SEEDS = (
    0x9E3779B9, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0xD5A3C3AA, 0x9E6C8F1B, 0x3C6EF372,
    0x21F0AAAD, 0x9FF1C4A3, 0x9C9F9A3B, 0x2B0E93B0, 0x51F0A8DD, 0x7F5F9E5D, 0x5B0F3D5B, 0x45DF27B3,
)

#: JavaScript's white space, which also is what its trim() strips.
JS_SPACE = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


@F.pandas_udf(T.StringType())
def nfkc_lower(text: pd.Series) -> pd.Series:
    """NFKC, then lower case; null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).lower() if isinstance(x, str) else None)


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{JS_SPACE}+|{JS_SPACE}+$", "")


def _words(norm: Column) -> Column:
    found = F.regexp_extract_all(norm, F.lit("[a-z0-9_]+"), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def _cjk_grams(norm: Column) -> Column:
    runs = F.regexp_extract_all(norm, F.lit(f"{CJK}+"), F.lit(0))
    two = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: r.substr(i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(two(r))))


def tokenize(norm: Column) -> Column:
    """Tokens of normalised text: Latin words of two characters or more that are no stop words, then CJK 2-grams."""
    return F.coalesce(F.concat(_words(norm), _cjk_grams(norm)), F.array().cast("array<string>"))


def token_set(norm: Column) -> Column:
    return F.array_distinct(tokenize(norm))


def features_of(tokens: Column) -> Column:
    """Character features: of a Latin token of three characters or more its bounds and 3-grams, other tokens whole."""

    def parts(t: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: t.substr(i, F.lit(3)))
        return F.concat(F.array(F.concat(F.lit("^"), F.substring(t, 1, 2))), grams, F.array(F.concat(F.right(t, F.lit(2)), F.lit("$"))))

    return F.flatten(F.transform(tokens, lambda t: F.when(t.rlike("^[a-z0-9_]{3,}$"), parts(t)).otherwise(F.array(t))))


def fnv1a(text: Column, seed: int = 0) -> Column:
    """32-bit FNV-1a over characters (code units of the basic plane), as a bigint."""
    mask = F.lit(4294967295).cast("long")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit((2166136261 ^ seed) & 0xFFFFFFFF).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(mask))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def estimate_tokens(text: Column) -> Column:
    """Cost of a text: 1 for a CJK character, 0.25 for [A-Za-z0-9_], 0.5 for any other; rounded up, at least 1."""
    size = lambda x: F.length(x)
    cjk = size(text) - size(F.regexp_replace(text, CJK, ""))
    word = size(text) - size(F.regexp_replace(text, "[A-Za-z0-9_]", ""))
    quarter = cjk * 4 + word + (size(text) - cjk - word) * 2
    return F.greatest(F.lit(1).cast("long"), F.ceil(quarter / 4).cast("long"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def similarity(a: Column, b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """0 if either is empty; token-set Jaccard where one is over 300 characters; else 1 - edit distance / length."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = 1 - F.levenshtein(a, b) / longest
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).when(longest > 300, jaccard(tokens_a, tokens_b)).otherwise(edit)


def fuzzy_variants(word: str) -> list[str]:
    """Strings one deletion, adjacent swap, replacement or insertion away, a to z only."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
    out |= {a + c + b[1:] for a, b in cuts if b for c in letters if c != b[0]} | {a + c + b for a, b in cuts for c in letters}
    return sorted(out)


def diff_title(content: Column) -> Column:
    """First line that is not blank, white space collapsed, cut to 24 characters and an ellipsis."""
    lines = F.filter(F.split(content, "\n"), lambda x: js_trim(x) != "")
    first = js_trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), f"{JS_SPACE}+", " "))
    return F.when(F.length(first) > 24, F.concat(F.substring(first, 1, 24), F.lit("…"))).otherwise(first)


def label_tag(label: Column) -> Column:
    return F.regexp_extract(label, r"([^/\\]*)$", 1)


def theme_id(token: Column) -> Column:
    """31-polynomial hash of a token, unsigned 32 bits in base 36."""
    mask = F.lit(4294967295).cast("long")
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(mask))
    return F.lower(F.conv(h.cast("string"), 10, 36))


def clean_tags(tags: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tags, js_trim), lambda t: t != ""))
