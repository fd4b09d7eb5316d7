from pyspark.sql import functions as F

from tidemark.functions import signals as G
from tidemark.functions import text as X
from tidemark.operators.ranking import conflict_order, fnv, query_tokens


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_tokens_of_latin_and_cjk(spark):
    text = "The user_1 runs Node 20, 部署用 Redis 好"
    got = one(spark, X.tokenize(X.nfkc_lower(F.col("t"))), t=text)
    assert got == ["user_1", "runs", "node", "20", "redis", "部署", "署用", "好"] == query_tokens(text)


def test_features_and_hash(spark):
    assert one(spark, X.features_of(F.array(F.lit("deploy"), F.lit("部署"))), t="") == ["^de", "dep", "epl", "plo", "loy", "oy$", "部署"]
    assert one(spark, X.fnv1a(F.col("t")), t="deploy") == fnv("deploy")
    assert one(spark, X.estimate_tokens(F.col("t")), t="") == 1


def test_similarity(spark):
    sim = X.similarity(F.col("a"), F.col("b"), X.tokenize(F.col("a")), X.tokenize(F.col("b")))
    assert one(spark, sim, a="abcd", b="abce") == 0.75
    assert one(spark, sim, a="", b="abce") == 0.0


def test_titles_and_variants(spark):
    assert one(spark, X.diff_title(F.col("t")), t="\n \n  a \t b\nc") == "a b"
    assert one(spark, X.diff_title(F.col("t")), t="x" * 30) == "x" * 24 + "…"
    assert {"redi", "reids", "rediss", "xedis"} <= set(X.fuzzy_variants("redis"))


def test_sensitive(spark):
    yes = ["token = abc", "x akia" + "a" * 16, "éakia" + "a" * 16, "a" * 40, "http://u:p@h"]
    no = ["tokens abc", "xakia" + "a" * 16, "a" * 39, None, ""]
    rows = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, w boolean").select("t", "w", G.is_sensitive(F.col("t")).alias("g")).collect()
    assert all(r.g == r.w for r in rows), rows


def test_kinds_and_capture(spark):
    assert one(spark, G.infer_kind(F.col("t")), t="Never commit keys") == "instruction"
    assert one(spark, G.infer_speaker_kind(F.col("t"), F.lit(False)), t="I prefer tea") == "generic"
    user = G.capture_user(F.col("t"), F.lower("t"))
    assert one(spark, user, t="please remember to use pnpm").tags == ["explicit", "preference"]
    assert one(spark, user, t="we avoid it") is None and one(spark, user, t="never") is None
    assert one(spark, G.capture_tool(F.lit("run"), F.col("t"), F.col("t")), t="done in 3s").content == "run 执行结果: done in 3s"


def test_conflict_order():
    assert conflict_order([("old", 1, ["newer"]), ("other", 5, []), ("newer", 2, ["old"])]) == ["newer", "other", "old"]
    assert conflict_order([("a", 1, ["b"]), ("b", 1, [])]) == ["a", "b"] and conflict_order([("b", 2, ["a"]), ("a", 1, [])]) == ["b", "a"]
    # the widest pair of the first place goes first, and each hit moves once
    assert conflict_order([("a", 1, ["b", "c"]), ("b", 2, []), ("c", 3, ["b"])]) == ["c", "b", "a"]
