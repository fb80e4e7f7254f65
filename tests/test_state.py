import random

from keelson.operators import state
from keelson.operators.schema import OPLOG, violations
from keelson.operators.state import KeyedState


def make(spark, operations, max_size=100):
    s = KeyedState(spark, max_size)
    s.apply(operations)
    return s


def keys(df):
    return [bytes(r["key"]) for r in df.collect()]


def all_sizes(s):
    return [r["size"] for r in state.sizes(s.ops).orderBy("seq").collect()]


def test_put_get(spark):
    s = make(spark, [(b"key1", b"value1"), (b"key2", b"value2")])
    assert s.get(b"key1") == ("live", b"value1", 1)
    assert s.get(b"key2") == ("live", b"value2", 2)
    assert s.get(b"key3") == ("absent", None, None)


def test_delete_leaves_a_tombstone(spark):
    s = make(spark, [(b"key1", b"value1"), (b"key1", None)])
    assert s.get(b"key1") == ("tombstone", None, 2)
    assert all_sizes(s) == [34, 34]
    assert s.len() == 1 and not s.is_empty()


def test_overwrite(spark):
    s = make(spark, [(b"key1", b"value1"), (b"key1", b"value2")])
    assert s.get(b"key1")[1] == b"value2"
    assert all_sizes(s) == [34, 34]


def test_size_grows_and_fills(spark):
    assert all_sizes(make(spark, [(b"key1", b"value1"), (b"key2", b"value2")])) == [34, 68]
    s = make(spark, [(f"key{k}".encode(), f"value{k}_long_enough".encode()) for k in (1, 2, 3)])
    assert all_sizes(s) == [46, 92, 138]
    assert s.is_full() and not KeyedState(spark, 100).is_full()
    assert state.first_full(s.ops, 100).first()[0] == 3
    assert state.first_full(s.ops, 1000).first()[0] is None


def test_size_rules(spark):
    ten = b"0123456789"
    assert all_sizes(make(spark, [(b"k", ten), (b"k", b"ab"), (b"k", ten)])) == [35, 35, 43]
    assert all_sizes(make(spark, [(b"k", ten), (b"k", None), (b"k", b"abcd")])) == [35, 35, 39]
    s = make(spark, [(b"k", None), (b"k", b"ab"), (b"k", None)])
    assert all_sizes(s) == [25, 27, 27] and s.len() == 1 and s.seq_num() == 3


def test_empty_value_is_live(spark):
    assert make(spark, [(b"k", b"")]).get(b"k") == ("live", b"", 1)


def test_order_and_ranges(spark):
    s = make(spark, [(b"c", b"3"), (b"a", b"1"), (b"b", b"2")])
    assert keys(s.iter()) == [b"a", b"b", b"c"]
    s = make(spark, [(b"a", b"1"), (b"c", b"3"), (b"e", b"5"), (b"g", b"7"), (b"\xff", b"9")])
    assert keys(s.range(b"b", b"f")) == [b"c", b"e"]
    assert keys(s.range(b"c", b"e")) == [b"c"]
    assert keys(s.range(b"c", b"c")) == keys(s.range(b"f", b"b")) == []
    assert keys(s.iter())[-1] == b"\xff"


def test_random_operations_against_a_fold(spark):
    rng = random.Random(5)
    operations = [(bytes([rng.randrange(6)]) * rng.randrange(3), None if rng.random() < 0.3 else b"x" * rng.randrange(9)) for _ in range(400)]
    s = make(spark, operations)
    held, size, sizes = {}, 0, []
    for n, (k, v) in enumerate(operations, 1):
        if k not in held:
            size += len(k) + len(v or b"") + 24
        elif v is not None:
            size += max(0, len(v) - len(held[k][0] or b""))
        held[k] = (v, n)
        sizes.append(size)
    assert all_sizes(s) == sizes and s.size() == size
    got = {bytes(r["key"]): (None if r["value"] is None else bytes(r["value"]), r["seq"]) for r in s.iter().collect()}
    assert got == held
    at = {bytes(r["key"]): r["seq"] for r in state.snapshot(s.ops, 100).collect()}
    assert at == {k: max(n for n, (x, _) in enumerate(operations[:100], 1) if x == k) for k in {x for x, _ in operations[:100]}}


def test_empty_and_invalid(spark):
    s = KeyedState(spark, 10)
    assert s.is_empty() and s.len() == 0 and s.seq_num() == 0 and s.size() == 0
    assert state.counts(s.ops).first().asDict() == {"len": 0, "seq_num": 0, "live": 0, "tombstones": 0, "is_empty": True}
    bad = spark.createDataFrame([(1, 1, b"k", None), (2, 2, b"k", b"v"), (3, 3, b"k", None), (4, 1, b"k", b"")], OPLOG)
    assert sorted(r["seq"] for r in violations(bad).collect()) == [1, 2, 3]
