import os
import random

import pytest

import corpus_pipeline
from tidemark.llm import jaccard_join

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_each_stage_takes_all_its_predecessor_kept(spark, tmp_path):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = str(tmp_path / str(k))
        out.write.parquet(path)
        new = spark.read.parquet(path)
        if name != "mix":
            assert new.columns == COLUMNS and 0 < new.count() <= docs.count()
            assert new.join(docs, "doc_id", "left_anti").count() == 0
        docs = new
    assert docs.count() > 0


def test_empty_documents_pass_through(spark):
    if not os.path.isdir(SF):
        pytest.skip("no driver tables")
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_of_one_id_or_none_are_decided_apart(spark, tmp_path, monkeypatch):
    words = lambda k, n=40: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(None, words(1)), (None, words(2)), (None, None), (None, words(1)), (5, words(3)), (5, words(4) + " " + words(9, 10)), (6, words(3)), (7, words(9, 10) + " " + words(5))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, words(9, 10))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    want = sorted([(None, words(1)), (None, words(2)), (None, None), *texts[4:6], texts[7]], key=repr)
    assert left(corpus_pipeline.keep_distinct(spark, docs, str(tmp_path))) == want
    want = sorted([t for k, t in enumerate(texts) if k not in (5, 7)], key=repr)
    assert left(corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))) == want

    def judge(docs, labels, carry):
        return docs.selectExpr("doc_id", "text is not null and text not like 'w4%' as kept", carry)

    monkeypatch.setattr(corpus_pipeline.quality_model, "classify", judge)
    want = sorted([t for k, t in enumerate(texts) if k not in (2, 5)], key=repr)
    assert left(corpus_pipeline.keep_quality(spark, docs, str(tmp_path))) == want


def test_jaccard_join_links_rows_of_one_id_or_none(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, words(1)), (None, words(2)), (None, ""), (3, words(1) + " end"), (4, words(2) + " end"), (4, words(7))]
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=repr) == sorted([(None, 37, 3, 1), (None, 37, 4, 1), (None, 0, None, 0), (3, 38, 3, 1), (4, 38, 4, 1), (4, 37, 4, 0)], key=repr)


NAMES = ["__row", "__id", "__copies", "key", "first", "copies", "component", "Size", "rank", "a.b", "copy", "kept", "votes", "h", "hits", "spans"]


def test_columns_of_any_name_pass_through(spark, tmp_path):
    letter = lambda n: "abcdefghijklmnopqrstuvwxyz"[n % 26]
    words = lambda k: " ".join(letter(k) + letter(k // 26) + letter(i * 3) + letter(i * i) + letter(i) + ("." if i % 9 == 8 else "") for i in range(60)) + "."
    rows = [(i if i % 7 else (None if i % 2 else 14), words(i % 30) if i % 11 else None, "en", f"s{i % 3}" if i % 5 else None, 10, *[f"{n}{i}" for n in NAMES]) for i in range(60)] + [(99, words(50) * 300, "en", "s1", 1, *NAMES)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in NAMES)]))
    spark.createDataFrame([(1, words(3)), (2, None), (None, words(4))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / f"out{k}")
        out.write.parquet(path)
        new = spark.read.parquet(path)
        assert new.columns == docs.columns or name == "mix" and set(docs.columns) <= set(new.columns)
        assert new.count() > 0
        docs = new


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    """Of each group of documents that share 80 % of their five-word shingles the one with the smallest id stays."""
    rng = random.Random(8)
    base = [[f"v{rng.randrange(4000)}" for _ in range(rng.randrange(3, 90))] for _ in range(25)]
    texts = []
    for b in base:
        for _ in range(rng.randrange(1, 6)):
            t = list(b)
            for _ in range(rng.randrange(0, 3)):
                t[rng.randrange(len(t))] = f"n{rng.randrange(9999)}"
            texts.append(" ".join(t))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(str.split, texts)]
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = min(label[i], label[j])
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_distinct(spark, docs, str(tmp_path)).collect()) == sorted(set(label))
