import random

import pytest
from pyspark.sql import functions as F

from keelson.errors import CatalogueError
from keelson.functions.hashing import bits_per_key_for, filter_size, key_hashes
from keelson.operators import compaction, manifest, membership
from keelson.operators.config import EngineConfig
from keelson.operators.manifest import Manifest, RunMeta
from keelson.operators.prefix import running_sum
from keelson.operators.state import KeyedState, latest, live


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key binary")


def test_hashes_and_sizes():
    one, two = key_hashes([b"", b"apple", b"banana", b"cherry", b"test1"])
    assert one.tolist() == [14695981039346656037, 17819163333647859135, 13029959021517523088, 5968103895666186488, 2271358237066212092]
    assert two.tolist() == [11400714819323198485, 8286224158111972568, 6904756027667148943, 6904756027707766055, 8286224158131538340]
    assert filter_size(100, 10) == (1000, 7) and filter_size(1, 1) == (64, 1) and filter_size(10, 100)[1] == 30
    assert (bits_per_key_for(0.01), bits_per_key_for(0.001)) == (10, 15)


def test_membership(spark):
    member = membership.build(frame(spark, [b"apple", b"banana", b"cherry"]), 100, 10)
    assert member.count() == 21
    asked = frame(spark, [b"apple", b"banana", b"cherry", b"durian", b"elderberry"])
    answers = lambda m: {bytes(r["key"]): r["may_contain"] for r in membership.probe(asked, m).collect()}
    assert answers(member) == {b"apple": True, b"banana": True, b"cherry": True, b"durian": False, b"elderberry": False}
    data = membership.to_bytes(member)
    assert len(data) == 125 and answers(membership.from_bytes(spark, data, 7)) == answers(member)
    assert not any(answers(membership.build(frame(spark, [b"x"]).where("false"), 100, 10)).values())
    with pytest.raises(ValueError):
        membership.from_bytes(spark, b"", 7)


def test_false_positive_rate(spark):
    key = lambda a, b: spark.range(a, b).select(F.encode(F.format_string("key%06d", "id"), "UTF-8").alias("key"))
    member = membership.build(key(0, 1000), 1000, 10)
    assert membership.probe(key(0, 1000), member).where("not may_contain").count() == 0
    assert membership.probe(key(1000, 11000), member).where("may_contain").count() == 78


def run(number, level, low, high):
    return RunMeta(number, level, f"run-{number}", 1024, 10, low, high)


def test_catalogue(tmp_path):
    m = Manifest(3)
    assert (m.version, m.take_id(), m.take_wal_seq()) == (1, 1, 1) and m.next_id == 2
    m.add(0, run(1, 0, b"a", b"z"))
    m.add(9, run(2, 9, b"a", b"z"))
    assert m.version == 2 and m.level(9) == [] and len(m.level(0)) == 1
    with pytest.raises(ValueError):
        m.add(1, run(3, 0, b"a", b"b"))
    path = str(tmp_path / "MANIFEST")
    m.save(path)
    assert Manifest.load(path) == m
    for text, kind in (('{"version":1,"levels":[],"next_sstable_id":1,"wal_seq":1}', "corrupted"), ('{"version":1}', "serialization"), ("{", "serialization")):
        with pytest.raises(CatalogueError) as e:
            Manifest.from_json(text)
        assert e.value.kind == kind
    with pytest.raises(CatalogueError):
        Manifest.load(str(tmp_path / "none"))


def test_overlap_and_removal(spark):
    m = Manifest(5)
    one, two = run(1, 1, b"a", b"c"), run(2, 1, b"e", b"g")
    m.add(1, one)
    m.add(1, two)
    ids = lambda lo, hi: [r.id for r in m.overlapping(1, lo, hi)]
    assert ids(b"b", b"f") == [1, 2] and ids(b"a", b"b") == [1] and ids(b"x", b"z") == [] and ids(b"c", b"e") == [1, 2] and ids(b"d", b"d") == []
    probes = spark.createDataFrame([(b"c", b"e"), (b"d", b"d")], "lo binary, hi binary")
    assert manifest.overlaps(m.runs(spark), probes).count() == 2
    assert [r["id"] for r in manifest.without(m.runs(spark), m.runs(spark).where("id = 1")).collect()] == [2]
    m.remove([one])
    m.remove([])
    assert m.version == 5 and [r.id for r in m.level(1)] == [2]


def test_config(spark):
    c = EngineConfig()
    assert [c.max_level_size(k) for k in range(5)] == [12582912, 41943040, 419430400, 4194304000, 41943040000]
    assert [r[0] for r in spark.range(5).select(c.level_capacity(F.col("id"))).collect()] == [c.max_level_size(k) for k in range(5)]


def test_flush_merge_and_compaction(spark, tmp_path):
    m, config = Manifest(3), EngineConfig(l0_compaction_trigger=2)
    s = KeyedState(spark, 1 << 20)
    s.apply([(b"a", b"1"), (b"b", b"1"), (b"c", b"1")])
    compaction.flush(s.ops, m, str(tmp_path))
    before = s.ops
    s.apply([(b"b", None), (b"c", b"2"), (b"d", b"2")])
    compaction.flush(s.ops.join(before.select("seq"), "seq", "left_anti"), m, str(tmp_path))
    assert compaction.pick(m, config) == 0
    read = lambda: {bytes(r["key"]): r["seq"] for r in live(compaction.merge_read([spark.read.parquet(r.path) for k in range(3) for r in m.level(k)])).collect()}
    expected = {bytes(r["key"]): r["seq"] for r in live(latest(s.ops)).collect()}
    assert read() == expected
    out = compaction.compact(spark, m, config, str(tmp_path))
    assert [(r.level, r.num_entries) for r in out] == [(1, 3)] and m.level(0) == [] and read() == expected
    assert compaction.compact(spark, m, config, str(tmp_path)) == []
    out = compaction.compact(spark, m, config, str(tmp_path), level=1)
    version = m.version
    with pytest.raises(ValueError):
        compaction.compact(spark, m, config, str(tmp_path), level=2)
    assert (m.version, m.level(2)) == (version, out) and read() == expected
    with pytest.raises(ValueError):
        m.swap(out, [run(99, 7, b"a", b"b")])
    assert m.level(2) == out


def test_outputs_are_cut_and_one_run_goes_down(spark, tmp_path):
    m, config, path = Manifest(4), EngineConfig(target_file_size=2000), str(tmp_path)
    log = spark.range(1, 1001).select(F.col("id").alias("seq"), F.lit(1).cast("tinyint").alias("op"), F.encode(F.format_string("k%05d", "id"), "UTF-8").alias("key"), F.encode(F.lit("v" * 10), "UTF-8").alias("value"))
    compaction.flush(log.where("seq <= 500"), m, path)
    compaction.flush(log.where("seq > 400"), m, path)
    out = compaction.compact(spark, m, config, path, level=0)
    assert len(out) >= 6 and max(r.size for r in out) < 4000 and sum(r.num_entries for r in out) == 1000
    assert all(a.max_key < b.min_key for a, b in zip(out, out[1:])) and len({r.id for r in out}) == len(out)
    down = compaction.compact(spark, m, config, path, level=1)
    assert len(m.level(1)) == len(out) - 1 and sum(r.num_entries for r in down) == out[0].num_entries
    assert compaction.read(spark, m).count() == 1000
    # A key within the bounds of one run, and in no filter: no run is read for it.
    asked = frame(spark, [b"k00003", b"k00003", b"k00003x", b"zzz", None])
    chosen = {(bytes(r["key"]), r["run"]) for r in compaction.candidates(spark, m, asked).collect()}
    assert chosen == {(b"k00003", next(r.id for r in down if r.min_key <= b"k00003" <= r.max_key))}
    assert sorted(r["state"] for r in compaction.point_read(spark, m, asked).collect()) == ["absent"] * 3 + ["live"] * 2
    assert compaction.point_read(spark, Manifest(2), asked).where("state = 'absent'").count() == 5


def test_catalogue_on_a_shared_file_system(spark, tmp_path):
    m, path = Manifest(2), f"file://{tmp_path}/deep/MANIFEST"
    for k in range(2):
        m.add(0, run(k, 0, b"a", b"b"))
        m.save(path, spark)
        assert Manifest.load(path, spark) == m
    with pytest.raises(CatalogueError):
        Manifest.load(f"file://{tmp_path}/none", spark)


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(4)
    key = lambda: bytes(rng.choices(b"abc", k=rng.randint(0, 4)))
    runs = [(k, *sorted((key(), key()))) for k in range(300)]
    probes = [(k, key(), key()) for k in range(100)]
    got = manifest.overlaps(spark.createDataFrame(runs, "id int, min_key binary, max_key binary"), spark.createDataFrame(probes, "probe int, lo binary, hi binary"))
    want = sorted((r, p) for r, a, b in runs for p, lo, hi in probes if lo <= hi and b >= lo and a <= hi)
    assert sorted((r["id"], r["probe"]) for r in got.collect()) == want


def test_filter_tells_its_own_size(spark, monkeypatch):
    member = membership.build(frame(spark, [b"a", b"b"]), 5000, 20)
    asked = frame(spark, [b"a", b"b", b"q", None, b"a"])
    for limit in (membership.BITMAP, 10):
        monkeypatch.setattr(membership, "BITMAP", limit)
        assert sorted((r["key"] is None, r["may_contain"]) for r in membership.probe(asked, member).collect()) == [(False, False), (False, True), (False, True), (False, True), (True, False)]


def test_running_sums_over_levels(spark):
    df = spark.range(1000).select((F.col("id") * 37).alias("o"), (F.col("id") % 7).alias("n"))
    got = {r["o"]: r["s"] for r in running_sum(df, "o", "n", "s", width=8).collect()}
    total = 0
    for k in range(1000):
        total += k % 7
        assert got[k * 37] == total
