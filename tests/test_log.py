import json

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import store as ST
from tidemark.schema import ENTRY_COLUMNS
from tidemark.sources import crypto
from tidemark.sources import log as L

DAY, T0 = 86_400_000, 1_700_000_000_000


def line(id_, content, updated, tags=(), access=0, last=None, created=None, **more):
    x = {"id": id_, "kind": "fact", "content": content, "tags": list(tags), "source": "auto", "createdAt": T0 if created is None else created, "updatedAt": updated, "accessCount": access}
    return json.dumps(x | ({} if last is None else {"lastAccessAt": last}) | more)


def read(spark, lines):
    return L.parse_lines(spark.createDataFrame(list(enumerate(lines)), "seq long, value string")).cache()


def ids(df):
    return sorted(r.id for r in df.collect())


def test_strict_lines(spark):
    bad = ["garbage", "[1]", line("a", "x", T0, tags=[1]), line("a", "x", T0, kind="odd"), line("a", 3, T0), line("a", "x", True)]
    log = read(spark, [*bad, "", '{"__kdf__":"scrypt"}', line("ok", "x", T0, extra=1)])
    assert L.corrupt_lines(log).count() == len(set(bad)) and ids(L.live(log)) == ["ok"]


def test_staged_log(spark):
    log = read(
        spark,
        [
            line("e1", "部署用 Node 18", T0), line("e2", "缓存 使用 Redis", T0), line("e1", "部署用 Node 20", T0 + DAY), line("e2", "缓存 使用 Redis", T0 + 2 * DAY, tags=["superseded-by:e4"]),
            line("e4", "缓存 使用 Valkey", T0 + 2 * DAY), line("e3", "网关 使用 Nginx", T0 + 3 * DAY),
        ],
    )
    early, late = L.as_of(log, T0 + 1000), L.as_of(log, T0 + 3 * DAY + 1000)
    assert ids(early) == ["e1", "e2"] and ids(late) == ["e1", "e2", "e3", "e4"]
    got = {r.id: (r.change_type, r.change) for r in L.diff(early, late).collect()}
    assert got == {"e1": ("changed", "content"), "e2": ("changed", "superseded"), "e3": ("added", None), "e4": ("added", None)}


def test_heat_and_tombstones(spark):
    log = read(spark, [line("a", "x", T0), line("a", "x", T0, access=5, last=T0 + DAY), line("b", "y", T0), '{"__tombstone__":"b"}', '{"__tombstone__":"a","at":%d}' % (T0 + 2 * DAY), line("a", "z", T0 + 3 * DAY)])
    assert [r.access_count for r in L.as_of(log, T0 + 1000).collect()] == [0]
    assert [r.access_count for r in L.as_of(log, T0 + DAY + 1000).collect()] == [5]
    assert ids(L.as_of(log, T0 + 2 * DAY + 1)) == [] and ids(L.live(log)) == ["a"]


def test_timeline(spark):
    log = read(spark, [line("a", "1", T0), line("b", "1", T0), line("a", "2", T0 + DAY), line("b", "1", T0, access=1, last=T0 + DAY + 1000), line("c", "1", T0 + 2 * DAY)])
    got = [tuple(r)[1:] for r in L.timeline(log).orderBy("day").collect()]
    assert got == [(2, 0, 0, 0, 2), (0, 0, 1, 1, 2), (1, 0, 0, 0, 3)]
    assert len(L.timeline(log, 1).collect()) == 1 and L.timeline(log.limit(0)).count() == 0


def test_writes(spark):
    log = read(spark, [line("a", "1", T0), line("b", "1", T0), line("a", "2", T0 + 1)])
    gone = ST.remove(log, spark.createDataFrame([("a",), ("zz",)], "id string"), T0 + 5)
    assert [(r.seq, r.op, r.id) for r in gone.collect()] == [(3, "T", "a")]
    assert ids(L.live(log.unionByName(gone))) == ["b"]
    more = L.live(log).select(*ENTRY_COLUMNS).withColumn("id", F.concat("id", F.lit("2")))
    assert ST.insert_new(log, more.unionByName(L.live(log).select(*ENTRY_COLUMNS))).count() == 2
    assert [(r.seq, r.id, r.content) for r in ST.compact(log).orderBy("seq").collect()] == [(0, "a", "2"), (1, "b", "1")]
    assert ST.fingerprint(L.live(log)).first() == ST.fingerprint(ST.heat_rows(L.live(log), 9)).first()


def test_eviction_and_ttl(spark):
    log = read(spark, [line("a", "1", T0, tags=["superseded-by:b"]), line("b", "1", T0, access=3), line("i", "1", T0, kind="instruction"), line("c", "1", T0)])
    e = L.live(log)
    assert [r.id for r in ST.evict(e, 2, T0).collect()] == ["a", "c"] and ST.evict(e, 0, T0).count() == 0
    assert ST.expired(e, T0 + 11 * DAY, 10).count() == 4 and ST.expired(e, T0 + 11 * DAY, 0).count() == 0


def test_encryption(spark):
    key, other = crypto.derive_key("pass", b"salt" * 4, n=1024), crypto.derive_key("else", b"salt" * 4, n=1024)
    lines = spark.createDataFrame([(0, "é plain"), (1, "x" * 300)], "seq long, value string")
    sealed = crypto.encode_log(lines, key).cache()
    assert crypto.change_key(sealed, key, None).collect() == lines.collect()
    with pytest.raises(Exception, match="does not open"):
        crypto.change_key(sealed, other, None).collect()
    assert len({r.value for r in sealed.collect()} | {r.value for r in crypto.encode_log(lines, key).collect()}) > 2
    assert crypto.read_key_record(crypto.key_record(b"s"))["n"] == 16384 and crypto.read_key_record("{}") is None
    with pytest.raises(ValueError):
        crypto.read_key_record('{"__kdf__":"scrypt","salt":"","n":-1,"r":8,"p":1}')


def test_config():
    c = Config(default_recall_limit=1000, infer_max_hops=0, fusion_mode="odd").clamped()
    assert (c.default_recall_limit, c.infer_max_hops, c.fusion_mode) == (100, 1, "interpolate")


def test_log_file_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(line(f"id{i % 300}", f"text {i} " + "x" * 200, T0 + i) for i in range(3000)) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = L.read_log(spark, f"file://{path}").select("seq", "updated_at").orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.seq, r.updated_at) for r in rows] == [(i, T0 + i) for i in range(3000)]


def test_lines_that_a_key_does_not_open_are_not_lost(spark):
    lines = spark.createDataFrame([(0, "plain"), (1, None)], "seq long, value string")
    one, two = bytes(range(32)), bytes(range(1, 33))
    sealed = crypto.change_key(lines, None, one).cache()
    assert [r.value for r in crypto.change_key(sealed, one, None).orderBy("seq").collect()] == ["plain", None]
    with pytest.raises(Exception, match="does not open"):
        crypto.change_key(sealed, two, one).collect()
