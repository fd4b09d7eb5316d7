"""The memory over one log table, and the cascade of a batch against one that goes entry by entry."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.engine import Memory
from tidemark.errors import EngineError
from tidemark.functions.score import DAY
from tidemark.functions.signals import CONFLICT, OPPOSING
from tidemark.operators import cognition as C
from tidemark.operators.ranking import RecallOptions
from tidemark.streaming.capture import EVENT, read_events

T0 = 1_700_000_000_000
COLUMNS = "id string, kind string, content string, tags array<string>, source string, session_id string, workspace string, created_at long, updated_at long, access_count long, last_access_at long"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b):
    return 1 - distance(a, b) / max(len(a), len(b)) if a and b else 0.0


def one_by_one(candidates, library, now, window=DAY):
    seen, view, out = set(), [dict(e) for e in library], {}
    for c in candidates:
        low = c["content"].lower()
        opposing, doubt = (any(t in low for t in terms) for terms in (OPPOSING, CONFLICT))
        recent = [e for e in view if now - e["created_at"] <= window]
        dup = next((e for e in recent if e["content"] == c["content"]), None) or next((e for e in recent if abs(len(e["content"]) - len(c["content"])) <= 0.08 * max(len(e["content"]), len(c["content"])) + 1 and similar(e["content"], c["content"]) > 0.92), None)
        old = foe = None
        if opposing:
            old = max((e for e in recent if e["kind"] == c["kind"] and similar(e["content"], c["content"]) > 0.85), key=lambda e: similar(e["content"], c["content"]), default=None)
        elif doubt:
            pool = [e for e in view if now - e["created_at"] <= 30 * DAY and e["kind"] == c["kind"] and not any(t.startswith("supersede") for t in e["tags"])]
            foe = max((e for e in pool if similar(e["content"], c["content"]) > 0.55), key=lambda e: similar(e["content"], c["content"]), default=None)
        if c["content"].strip() in seen:
            out[c["id"]] = ("batch-duplicate", None)
            continue
        seen.add(c["content"].strip())
        if dup:
            out[c["id"]] = ("duplicate", dup["id"])
            continue
        tags = []
        if old:
            out[c["id"]] = ("superseded", old["id"])
            tags = [f"supersede:{old['id']}"]
            old["tags"].append(f"superseded-by:{c['id']}")
        elif foe:
            out[c["id"]] = ("conflict", foe["id"])
        else:
            out[c["id"]] = ("written", None)
        view.append({"id": c["id"], "kind": c["kind"], "content": c["content"], "tags": tags, "created_at": now})
    return out


def test_cascade_equals_entry_by_entry(spark):
    rng = random.Random(4)
    base = ["订单表使用 clickhouse 存储数据", "cache layer uses the redis cluster", "deploy gateway with nginx every week", "tests run on the small machine at night"]
    change = lambda t: t[: (k := rng.randrange(len(t)))] + rng.choice("xyz") + t[k + 1 :]
    library = [{"id": f"l{i}", "kind": ("fact", "decision")[i % 2], "content": change(t), "tags": [], "created_at": T0 - i * 1000 - (40 * DAY if i == 9 else 0)} for i, t in enumerate(base * 3)]
    texts = []
    for t in base * 6:
        word = rng.choice(["", "", "now use ", "no longer ", "改用"])
        texts.append(word + (change(t) if rng.random() < 0.7 else t))
    texts += texts[:3]
    candidates = [{"id": f"c{i:02}", "kind": rng.choice(("fact", "decision")), "content": t, "created_at": T0} for i, t in enumerate(texts)]
    row = lambda e: (e["id"], e["kind"], e["content"], [], "auto", None, None, e["created_at"], e["created_at"], 0, None)
    held = C.normalized(spark.createDataFrame(list(map(row, sorted(library, key=lambda e: (e["created_at"], e["id"])))), COLUMNS))
    new = C.normalized(spark.createDataFrame(list(map(row, candidates)), COLUMNS).withColumn("ord", F.substring("id", 2, 9).cast("long")))
    got = C.ingest(new, held, T0)
    want = one_by_one(candidates, sorted(library, key=lambda e: (e["created_at"], e["id"])), T0)
    assert {r.id: (r.status, r.target) for r in got.collect()} == want and len({s for s, _ in want.values()}) >= 4
    writes = {r.id: r.tags for r in C.ingest_writes(new, held, got, T0).collect()}
    for i, (status, target) in want.items():
        if status == "superseded":
            assert f"supersede:{target}" in writes[i] and f"superseded-by:{i}" in writes[target]
        if status == "conflict":
            assert f"conflicts-with:{target}" in writes[i] and f"conflict-of:{i}" in writes[target]
        assert (i in writes) == (status in ("written", "superseded", "conflict"))


def test_store_forget_recall_status(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/log", Config(supersede_mode="auto", conflict_mode="auto", graph_enabled=True, infer_enabled=True))
    first = m.store("订单表使用 clickhouse 存储", T0, "decision").first()
    assert m.store("订单表使用 clickhouse 存储", T0 + 5, "decision").first().id == first.id
    second = m.store("订单表现改用 clickhouse 存储", T0 + 10, "decision").first()
    m.store("gateway depends on nginx", T0 + 20, "fact")
    m.store("nginx requires openssl", T0 + 30, "fact")
    tags = {r.id: r.tags for r in m.entries().collect()}
    assert f"superseded-by:{second.id}" in tags[first.id] and f"supersede:{first.id}" in tags[second.id] and len(tags) == 4
    for bad, code in (("  ", "EMPTY_CONTENT"), ("token = abcdef", "SENSITIVE_CONTENT")):
        with pytest.raises(EngineError) as e:
            m.store(bad, T0)
        assert e.value.code == code
    hits = m.recall("gateway uses openssl", T0 + 40, RecallOptions(limit=5), explain=True).collect()
    assert hits[0].rank == 1 and {"gateway depends on nginx", "nginx requires openssl"} <= {r.content for r in hits}
    assert any(r.chains for r in hits) and all(r.why.base > 0 for r in hits)
    got = m.status(T0 + 50).first()
    assert got.total == 4 and got.superseded == 1 and got.hot == 3 and got.entries if "entries" in got.asDict() else got.total == 4
    assert {r.access_count for r in m.entries().collect()} == {0, 1}
    assert m.recall("nginx", T0 + 60, as_of=T0 + 1).count() == 0
    assert [(r.change_type, r.n) for r in m.diff(T0 + 15, T0 + 35).collect()] == [("added", 2), ("added", 2)]
    assert {r.side for r in m.graph_diff(T0 + 15, T0 + 35).collect()} == {"added"} and m.timeline().count() == 1
    lines = m.log().count()
    assert not any(m.compact().first()) and m.log().count() == 4 < lines
    assert m.forget(second.id, T0 + 70) and not m.forget(second.id, T0 + 71) and m.export().count() == 3
    with pytest.raises(EngineError) as e:
        m.forget("nothing", T0 + 72, strict=True)
    assert e.value.code == "NOT_FOUND"
    m.close()
    with pytest.raises(EngineError) as e:
        m.entries()
    assert e.value.code == "STORE_CLOSED"


def test_batches_and_pruning(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/log", Config(ttl_days=10, max_entries=2, auto_evict=True, conflict_mode="auto"))
    rows = [("a", 0, "fact", "cache uses redis cluster", []), ("b", 1, "fact", "cache uses redis cluster", []), ("c", 2, "fact", "cache no longer uses redis cluster", []), ("d", 3, "generic", "password: hunter2", [])]
    batch = spark.createDataFrame(rows, "id string, ord long, kind string, content string, tags array<string>")
    found = m.ingest(batch, T0)
    assert {r.id: (r.status, r.target) for r in found.collect()} == {"a": ("written", None), "b": ("batch-duplicate", None), "c": ("conflict", "a"), "d": ("sensitive", None)}
    by_two = Memory(spark, f"file://{tmp_path}/log2", Config(conflict_mode="auto")).ingest(batch, T0, most=2)
    assert {r.id: (r.status, r.target) for r in by_two.collect()} == {r.id: (r.status, r.target) for r in found.collect()}
    assert m.conflicts().first().n == 1 and m.counts["ingest_conflict"] == 1
    m.store("one more entry of interest", T0 + 9 * DAY, "decision")
    assert sorted((r.id[:1], r.reason) for r in m.prune(T0 + 9 * DAY).collect())[0][1] == "evicted" and m.entries().count() == 2
    assert {r.reason for r in m.prune(T0 + 30 * DAY).collect()} == {"expired"} and m.entries().count() == 0


def test_sources_fail_alone_and_streams_are_ingested(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Head\n\nThe gateway uses nginx and envoy.\n\nShort\n\nAlways run the tests before a release.")
    (tmp_path / "s.jsonl").write_text('{"type":"user/message","data":{"content":[{"type":"text","text":" I prefer tea over coffee "}]}}\nnot json\n{"type":"user/message","data":{"content":"   "}}')
    m = Memory(spark, f"file://{tmp_path}/log")
    told = m.import_sources(T0, (f"file://{tmp_path}/a.md", f"file://{tmp_path}/missing.md"), (f"file://{tmp_path}/s.jsonl",))
    assert [t["added"] > 0 for t in told] == [True, False, True] and told[1]["error"] and m.counts["errors"] == 1
    before = m.size()
    assert [t["added"] for t in m.import_sources(T0, (f"file://{tmp_path}/a.md",))] == [0] and m.size() == before
    rows = [(i, T0 // 1000 + i, "session", "user", None, False, None, t) for i, t in enumerate(["remember to test the gateway", "hello there you", "always use tabs in makefiles"])]
    events = spark.createDataFrame(rows, "event_seq long, s long, source string, role string, tool_name string, is_error boolean, workspace string, text string")
    events.select("event_seq", F.timestamp_seconds("s").alias("ts"), *[f.name for f in EVENT.fields[2:]]).write.parquet(str(tmp_path / "in"))
    m.capture(read_events(spark, str(tmp_path / "in")), str(tmp_path / "ck"), T0).awaitTermination(120)
    assert m.size() == before + 2 and m.get("ev-00000000000000000000").first().content == "remember to test the gateway"
    page = m.page("now", most=1)
    assert "there are more" in page and page == m.page("now", most=1) and "there are more" not in m.page("now")
