import random

import pytest
from pyspark.sql import functions as F

from keelson.errors import LogError
from keelson.functions.encoding import record
from keelson.operators.compaction import replay
from keelson.operators.schema import OPLOG
from keelson.sources import wal

GOLDEN = [
    (1, b"test_key", b"test_value", "9730d1d11b00000001080000000a000000746573745f6b6579746573745f76616c7565"),
    (2, b"test_key", None, "32560ff811000000020800000000000000746573745f6b6579"),
    (1, b"key1", b"value1", "4f07cf6f130000000104000000060000006b65793176616c756531"),
    (1, b"key2", b"value2", "684c2ec7130000000104000000060000006b65793276616c756532"),
    (2, b"key1", None, "fa7336610d0000000204000000000000006b657931"),
]
FILE = b"".join(bytes.fromhex(x[3]) for x in GOLDEN[2:])


def statuses(data):
    return [(r[4], r[2]) for r in wal.decode(data)]


def test_records_match_known_bytes(spark):
    ops = spark.createDataFrame([(k, op, key, value) for k, (op, key, value, _) in enumerate(GOLDEN, 1)], OPLOG)
    rows = ops.orderBy("seq").select(record(F.col("op"), F.col("key"), F.col("value")).alias("r")).collect()
    assert [bytes(r["r"]).hex() for r in rows] == [x[3] for x in GOLDEN]
    assert [wal.encode(*x[:3]).hex() for x in GOLDEN] == [x[3] for x in GOLDEN]
    assert spark.sql("select crc32('hello world') a, crc32('hello world!') b, crc32('') c").first() == (222957957, 62177901, 0)
    assert [r["offset"] for r in wal.offsets(ops).orderBy("seq").collect()] == [35, 60, 87, 114, 135]


def test_file_round_trip_and_truncate(spark, tmp_path):
    path = str(tmp_path / "log")
    log = wal.LogFile(path, create=True)
    for op, key, value, _ in GOLDEN[2:]:
        log.append(op, key, value)
    log.sync()
    assert log.offset() == 75
    log.close()
    rows = wal.read_log(spark, path).orderBy("pos").collect()
    assert [(r["op"], bytes(r["key"]), r["value"] and bytes(r["value"])) for r in rows] == [x[:3] for x in GOLDEN[2:]]
    again = wal.LogFile(path)
    assert again.offset() == 75
    again.truncate()
    assert again.offset() == 0
    again.append(1, b"a", b"")
    again.close()
    assert [r["value"] for r in wal.read_log(spark, path).collect()] == [b""]
    with pytest.raises(LogError):
        wal.LogFile(str(tmp_path / "missing"))


def test_damaged_logs(spark, tmp_path):
    whole = [("ok", b"key1"), ("ok", b"key2"), ("ok", b"key1")]
    assert statuses(FILE) == whole and statuses(b"") == []
    more = bytes.fromhex(GOLDEN[0][3])
    for n in (1, 2, 3):
        assert statuses(FILE + more[:n]) == whole
    for n in (4, 7, 8, 20):
        assert statuses(FILE + more[:n]) == [*whole, ("io", None)]
    assert statuses(bytes.fromhex("6cd5555c110000000103000000050000006b657976616c7565")) == [("corrupted", None)]
    assert "operation 9" in next(wal.decode(bytes.fromhex("2fef84d20a0000000901000000000000006b")))[5]
    middle = bytearray(FILE)
    middle[27 + 17] ^= 1
    assert statuses(bytes(middle)) == [whole[0], ("corrupted", None), whole[2]]
    assert statuses(FILE + bytes(8)) == [*whole, ("corrupted", None)]
    (tmp_path / "bad").write_bytes(bytes(middle))
    with pytest.raises(Exception, match="corrupted"):
        wal.read_log(spark, str(tmp_path / "bad"), fail_fast=True).collect()
    ops = replay(wal.read_log(spark, str(tmp_path / "bad")))
    assert sorted(r["seq"] for r in ops.collect()) == [1, 3]


def sent_to_driver(spark):
    """Bytes of all tasks' results so far."""
    context = spark._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).resultSize() for k in range(stages.size()))


def test_log_files_are_written_by_tasks(spark, tmp_path):
    noise = random.Random(5)
    ends = (b"\0", b"\n", b"\r", b"}", b"\x80", b"\xff")
    want = {k: noise.randbytes(1 << 18) + ends[k % len(ends)] for k in range(24)} | {24: b"", 25: b"\n", 26: bytes(range(256))}
    spark.createDataFrame(list(want.items()), "segment bigint, content binary").write.parquet(str(tmp_path / "segments"))
    rows = spark.read.parquet(str(tmp_path / "segments"))
    before = sent_to_driver(spark)
    wal.write_log(rows, str(tmp_path / "log"))
    assert sent_to_driver(spark) - before < 1 << 20
    assert {p.name: p.read_bytes() for p in (tmp_path / "log").iterdir() if p.name[0] != "."} == {f"{k:012d}.log": v for k, v in want.items()}
    for again in ([(3, b"x")], [(30, b"x"), (30, b"y")]):
        with pytest.raises(LogError):
            wal.write_log(spark.createDataFrame(again, "segment bigint, content binary"), str(tmp_path / "log"))
    assert sorted(p.name for p in (tmp_path / "log").iterdir() if p.name[0] != ".") == [f"{k:012d}.log" for k in want]
    assert (tmp_path / "log" / f"{3:012d}.log").read_bytes() == want[3]


def test_an_empty_log_is_no_file(spark, tmp_path):
    wal.write_log(wal.segments(spark.createDataFrame([], OPLOG)), str(tmp_path / "log"))
    assert list((tmp_path / "log").iterdir()) == [] and wal.read_log(spark, str(tmp_path / "log")).isEmpty()
