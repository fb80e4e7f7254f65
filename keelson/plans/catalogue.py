"""Queries over the driver's tables, and the SQL that they must equal.

`events` is the op log: sequence event_id + 1, key user_id:event_type, every fifth operation a
delete. `orders` and `pages` give sorted runs. Bytes are shown as hex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.functions.encoding import record, record_payload
from keelson.functions.hashing import bit_positions, bits_per_key, filter_size
from keelson.operators import blocks, compaction, manifest, membership, state
from keelson.operators.config import EngineConfig
from keelson.operators.manifest import Manifest, RunMeta
from keelson.operators.schema import utf8
from keelson.sources import tables, wal

#: Of the membership queries' filters, which are sized by their keys.
BITS_PER_KEY = 10
#: Bytes of an entry's value in the page queries, which pack whole texts; a page has room for several.
PIECE = 1024


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_id") % 5 == 0
    key = utf8(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type")))
    return e.select((F.col("event_id") + 1).alias("seq"), F.when(deleted, 2).otherwise(1).cast("tinyint").alias("op"), key.alias("key"), F.when(~deleted, utf8(F.col("props"))).alias("value"))


def shown(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.hex(n) for n in names})


def live_range(spark, sf_dir):
    return shown(state.live(state.latest(state.key_range(ops(spark, sf_dir), b"1", b"2"))), "key", "value")


def latest_version(spark, sf_dir):
    return shown(state.latest(ops(spark, sf_dir)), "key", "value")


def range_scan(spark, sf_dir):
    return shown(state.scan(state.latest(state.key_range(ops(spark, sf_dir), b"1", b"3"))), "key", "value")


def snapshot_read(spark, sf_dir):
    return shown(state.snapshot(ops(spark, sf_dir), 700), "key", "value")


def point_probes(spark):
    return spark.range(200).select(utf8(F.concat(F.col("id").cast("string"), F.lit(":click"))).alias("key"))


def point_get_tristate(spark, sf_dir):
    return shown(state.get_many(ops(spark, sf_dir), point_probes(spark)), "key", "value")


def state_counts(spark, sf_dir):
    return state.counts(ops(spark, sf_dir))


def size_running(spark, sf_dir):
    return state.sizes(ops(spark, sf_dir))


def first_full_seq(spark, sf_dir):
    return state.first_full(ops(spark, sf_dir), 20_000)


def log_offsets(spark, sf_dir):
    return wal.offsets(ops(spark, sf_dir))


def wal_payload_hex(spark, sf_dir):
    return ops(spark, sf_dir).select("seq", F.hex(record_payload(F.col("op"), F.col("key"), F.col("value"))).alias("payload"))


def wal_record_hex(spark, sf_dir):
    return ops(spark, sf_dir).select("seq", F.hex(record(F.col("op"), F.col("key"), F.col("value"))).alias("record"))


def wal_roundtrip(spark, sf_dir):
    rows = wal.decode_column(wal.segments(ops(spark, sf_dir), 1000), "segment", "content")
    return shown(rows.select((F.col("segment") * 1000 + F.col("pos") + 1).alias("seq"), F.col("op").cast("int").alias("op"), "key", "value", "status"), "key", "value")


def wal_replay(spark, sf_dir):
    rows = wal.decode_column(wal.segments(ops(spark, sf_dir), 1000), "segment", "content").withColumn("pos", F.col("segment") * 1000 + F.col("pos"))
    return shown(state.latest(compaction.replay(rows)), "key", "value")


def names(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", utf8(F.col("c_name")).alias("key"))


def bloom_positions(spark, sf_dir):
    keys = names(spark, sf_dir)
    bits, hashes = filter_size(keys.count(), BITS_PER_KEY)
    return keys.select("c_custkey", F.posexplode(bit_positions(F.col("key"), bits, hashes)).alias("i", "bit_pos"))


def bloom_probe(spark, sf_dir):
    """All keys against a filter of every other one."""
    keys = names(spark, sf_dir)
    half = keys.where("c_custkey % 2 = 0")
    return membership.probe(keys, membership.build(half, half.count(), BITS_PER_KEY)).select("c_custkey", "may_contain")


def bits_per_key_table(spark, sf_dir):
    rates = spark.createDataFrame([(x,) for x in (0.5, 0.1, 0.05, 0.01, 0.001, 0.0001)], "rate double")
    return rates.select("rate", bits_per_key(F.col("rate")).alias("bits"))


def order_runs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = utf8(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    return o.select(F.floor(F.col("o_custkey") / 100).alias("run"), key.alias("key"), utf8(F.col("o_orderstatus")).alias("value"))


def run_zone_map(spark, sf_dir):
    return shown(manifest.zone_map(order_runs(spark, sf_dir), "run"), "min_key", "max_key")


def catalogue(spark, sf_dir):
    return manifest.zone_map(order_runs(spark, sf_dir), "run").select(F.col("run").alias("id"), (F.col("run") % 3).cast("int").alias("level"), "size", "num_entries", "min_key", "max_key")


def run_overlap(spark, sf_dir):
    probes = spark.range(0, 20).select(F.col("id").alias("probe"), *(utf8(F.lpad((F.col("id") * 50 + d).cast("string"), 12, "0")).alias(n) for n, d in (("lo", 0), ("hi", 10))))
    return manifest.overlaps(catalogue(spark, sf_dir), probes).select("id", "level", "probe")


def level_listing(spark, sf_dir):
    return shown(catalogue(spark, sf_dir).where("level = 1"), "min_key", "max_key")


def run_removal(spark, sf_dir):
    runs = catalogue(spark, sf_dir)
    return shown(manifest.without(runs, runs.where("id % 4 = 0")), "min_key", "max_key")


def level_capacity(spark, sf_dir):
    levels = spark.range(5).select(F.col("id").alias("level"))
    return levels.select("level", EngineConfig().level_capacity(F.col("level")).alias("capacity"))


def piece_runs(spark, sf_dir):
    """Entries that hold the whole html of all pages: its bytes in numbered pieces; an empty html is one empty piece."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("__bytes", utf8("html"))
    last = F.greatest(F.floor((F.octet_length("__bytes") - 1) / PIECE), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(F.col("__bytes"), k * PIECE + 1, F.lit(PIECE)))
    rows = p.select("page_id", "url", F.posexplode(pieces).alias("piece", "value"))
    key = F.concat_ws("#", "url", F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lpad(F.col("piece").cast("string"), 9, "0"))
    return rows.select(F.floor(F.col("page_id") / 100).alias("run"), utf8(key).alias("key"), "value", "page_id", "piece")


def block_pack(spark, sf_dir):
    return shown(blocks.pack(piece_runs(spark, sf_dir)).drop("bytes"), "first_key", "last_key")


def block_scan(spark, sf_dir):
    """All entries of pages that were written to storage and read back."""
    path = tables.scratch(spark, "pages")
    blocks.write_pages(blocks.pack(piece_runs(spark, sf_dir)), path)
    return shown(blocks.unpack(spark.read.parquet(path)).select("run", "key", "value"), "key", "value")


def block_lookup(spark, sf_dir):
    """Every key of the table, and for each a key that is missing."""
    rows = piece_runs(spark, sf_dir)
    here = rows.select("run", "key")
    return shown(blocks.lookup(blocks.pack(rows), here.unionByName(here.withColumn("key", F.concat("key", F.lit(b"!"))))), "key", "value")


def merge_read(spark, sf_dir):
    rows = ops(spark, sf_dir)
    return shown(compaction.merge_read([state.latest(rows.where(F.col("seq") % 4 == k)) for k in range(4)]), "key", "value")


def parts_of_log(spark, sf_dir, number):
    """The log cut in so many parts."""
    rows = ops(spark, sf_dir)
    last = rows.agg(F.max("seq")).first()[0] or 0
    return [rows.where((F.col("seq") > last * k // number) & (F.col("seq") <= last * (k + 1) // number)) for k in range(number)]


def flushed(spark, label, parts):
    """A run for each part of a log, and where runs go."""
    path, m = tables.scratch(spark, label), Manifest.of(EngineConfig())
    for part in parts:
        compaction.flush(part, m, path)
    return m, path


def flush_compact_read(spark, sf_dir):
    """Runs flushed, merged down two levels and read together: what is live, whatever level it is on."""
    *early, late = parts_of_log(spark, sf_dir, 4)
    m, path = flushed(spark, "levels", early)
    config = EngineConfig(target_file_size=64 << 10)
    compaction.compact(spark, m, config, path)
    compaction.compact(spark, m, config, path, level=1)
    compaction.flush(late, m, path)
    return shown(state.live(compaction.read(spark, m)), "key", "value")


def compact_bottom(spark, sf_dir):
    """The runs that a merge into an empty level writes: in key order, without tombstones, no key twice."""
    m, path = flushed(spark, "bottom", parts_of_log(spark, sf_dir, 3))
    out = compaction.compact(spark, m, EngineConfig(target_file_size=64 << 10), path)
    return shown(spark.read.parquet(*(r.path for r in out)).select("key", "value", "seq"), "key", "value")


def point_read(spark, sf_dir):
    """Keys looked up in the runs that their bounds and filters leave."""
    m, _ = flushed(spark, "points", parts_of_log(spark, sf_dir, 3))
    return shown(compaction.point_read(spark, m, point_probes(spark)), "key", "value")


def manifest_roundtrip(spark, sf_dir):
    """A catalogue filled, saved, loaded, thinned out, saved and loaded again."""
    path, m = f"{tables.scratch(spark, 'catalogue')}/MANIFEST", Manifest(3)
    for r in catalogue(spark, sf_dir).orderBy("id").collect():
        m.add(r["level"], RunMeta(r["id"], r["level"], f"run-{r['id']}", r["size"], r["num_entries"], bytes(r["min_key"]), bytes(r["max_key"])))
    m.save(path, spark)
    m = Manifest.load(path, spark)
    m.remove([r for k in range(3) for r in m.level(k) if r.id % 4 == 0])
    m.save(path, spark)
    return shown(Manifest.load(path, spark).runs(spark).withColumn("version", F.lit(m.version)), "min_key", "max_key")


def log_file_replay(spark, sf_dir):
    """The log written as files, read back, checked and reduced."""
    path = tables.scratch(spark, "log")
    wal.write_log(wal.segments(ops(spark, sf_dir), 1000), path)
    rows = wal.read_log(spark, path, fail_fast=True)
    number = F.regexp_extract("path", r"(\d+)\.log$", 1).cast("bigint")
    return shown(state.latest(compaction.replay(rows.withColumn("pos", number * 1000 + F.col("pos")))), "key", "value")


_all = (live_range, latest_version, range_scan, snapshot_read, point_get_tristate, state_counts, size_running, first_full_seq, log_offsets, wal_payload_hex, wal_record_hex, wal_roundtrip, wal_replay, bloom_positions, bloom_probe, bits_per_key_table, run_zone_map, run_overlap, level_listing, run_removal, level_capacity, block_pack, block_scan, block_lookup, merge_read, flush_compact_read, compact_bottom, point_read, manifest_roundtrip, log_file_replay)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _all}

OPS = """ops AS (
  SELECT event_id + 1 AS seq, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS op,
         encode(user_id::VARCHAR || ':' || event_type) AS key,
         CASE WHEN event_id % 5 <> 0 THEN encode(props) END AS value
  FROM events)"""
LATEST = f"{OPS}, latest AS (SELECT key, arg_max_null(value, seq) AS value, max(seq) AS seq FROM ops GROUP BY key)"
SHOWN = "hex(key) AS key, hex(value) AS value"
LE = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"
KLEN, VLEN = (LE.format(f"printf('%08X', {x})") for x in ("octet_length(key)", "coalesce(octet_length(value), 0)"))
NAMES = """h AS (
  SELECT c_custkey, list_transform(string_split(c_name, ''), lambda x: ord(x)::HUGEINT) AS b FROM customer),
k AS (
  SELECT c_custkey,
    list_reduce(list_prepend(14695981039346656037::HUGEINT, b), lambda a, x: (xor(a, x) * 1099511628211) % 18446744073709551616) AS h1,
    list_reduce(list_prepend(11400714819323198485::HUGEINT, b), lambda a, x: ((a * 32) % 18446744073709551616 + a // 576460752303423488 + x) % 18446744073709551616) AS h2
  FROM h),
m AS (SELECT ceil(greatest({}, 64) / 8.0)::BIGINT * 8 AS bits FROM customer),
p AS (
  SELECT c_custkey, i::INT AS i, (((h1 + i * (CASE WHEN h2 = 0 THEN 1 ELSE h2 END)) % 18446744073709551616) % bits)::BIGINT AS bit_pos
  FROM k, m, range(7) AS r(i))"""
EVERY_KEY, EVEN_KEYS = (NAMES.format(n) for n in ("10 * count(*)", "10 * count(*) FILTER (c_custkey % 2 = 0)"))
RUNS = """runs AS (
  SELECT o_custkey // 100 AS run, encode(lpad(o_orderkey::VARCHAR, 12, '0')) AS key, encode(o_orderstatus) AS value FROM orders),
zones AS (
  SELECT run, count(*) AS num_entries, sum(octet_length(key) + octet_length(value))::BIGINT AS size, min(key) AS min_key, max(key) AS max_key
  FROM runs GROUP BY run),
cat AS (SELECT run AS id, (run % 3)::INT AS level, size, num_entries, min_key, max_key FROM zones)"""
BOUNDS = "hex(min_key) AS min_key, hex(max_key) AS max_key"
PAGES = f"""h AS (SELECT page_id, url, hex(encode(html)) AS x FROM pages),
rows AS (
  SELECT page_id // 100 AS run, encode(concat_ws('#', url, lpad(page_id::VARCHAR, 9, '0'), lpad(piece::VARCHAR, 9, '0'))) AS key, substr(x, (2 * {PIECE} * piece + 1)::BIGINT, 2 * {PIECE}) AS value
  FROM (SELECT *, unnest(range(greatest(1, (len(x) + 2 * {PIECE} - 1) // (2 * {PIECE})))) AS piece FROM h))"""
CRC = f"""steps AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) AS v FROM range(256) AS r(i)),
lookup AS (SELECT list(v ORDER BY i) AS t FROM steps),
payloads AS (SELECT seq, printf('%02X', op) || {KLEN} || {VLEN} || hex(key) || coalesce(hex(value), '') AS payload FROM ops),
sums AS (
  SELECT seq, payload, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(len(payload) // 2), lambda k: ('0x' || substr(payload, 2 * k + 1, 2))::BIGINT)),
    lambda a, x: xor(a // 256, t[(xor(a % 256, x) + 1)::BIGINT]))) AS crc
  FROM payloads, lookup)"""
SIZE = """d AS (
  SELECT *, row_number() OVER w AS rn, lag(octet_length(value)) OVER w AS pl FROM ops WINDOW w AS (PARTITION BY key ORDER BY seq)),
s AS (
  SELECT seq, sum(CASE WHEN rn = 1 THEN octet_length(key) + coalesce(octet_length(value), 0) + 24
                       ELSE greatest(0, coalesce(octet_length(value), 0) - coalesce(pl, 0)) END)
         OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS size FROM d)"""

POINTS = f"""WITH {LATEST}, probes AS (SELECT encode(i::VARCHAR || ':click') AS key FROM range(200) AS r(i))
SELECT hex(p.key) AS key, CASE WHEN l.seq IS NULL THEN 'absent' WHEN l.value IS NULL THEN 'tombstone' ELSE 'live' END AS state, hex(l.value) AS value, l.seq
FROM probes p LEFT JOIN latest l ON p.key = l.key"""

ORACLES: dict[str, str] = {
    "live_range": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest WHERE value IS NOT NULL AND key >= encode('1') AND key < encode('2')",
    "latest_version": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest",
    "range_scan": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest WHERE key >= encode('1') AND key < encode('3')",
    "snapshot_read": f"WITH {OPS} SELECT hex(key) AS key, hex(arg_max_null(value, seq)) AS value, max(seq) AS seq FROM ops WHERE seq <= 700 GROUP BY ops.key",
    "point_get_tristate": POINTS,
    "state_counts": f"WITH {LATEST} SELECT count(*) AS len, coalesce(max(seq), 0) AS seq_num, count(value) AS live, count(*) - count(value) AS tombstones, count(*) = 0 AS is_empty FROM latest",
    "size_running": f"WITH {OPS}, {SIZE} SELECT seq, size FROM s",
    "first_full_seq": f"WITH {OPS}, {SIZE} SELECT min(seq) AS first_full_seq FROM s WHERE size >= 20000",
    "log_offsets": f"WITH {OPS} SELECT seq, sum(17 + octet_length(key) + coalesce(octet_length(value), 0)) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS \"offset\" FROM ops",
    "wal_payload_hex": f"WITH {OPS} SELECT seq, printf('%02X', op) || {KLEN} || {VLEN} || hex(key) || coalesce(hex(value), '') AS payload FROM ops",
    "wal_record_hex": f"WITH {OPS}, {CRC} SELECT seq, {LE.format("printf('%08X', crc)")} || {LE.format("printf('%08X', len(payload) // 2)")} || payload AS record FROM sums",
    "wal_roundtrip": f"WITH {OPS} SELECT seq, op, {SHOWN}, 'ok' AS status FROM ops",
    "wal_replay": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest",
    "bloom_positions": f"WITH {EVERY_KEY} SELECT c_custkey, i, bit_pos FROM p",
    "bloom_probe": f"WITH {EVEN_KEYS}, s AS (SELECT DISTINCT bit_pos FROM p WHERE c_custkey % 2 = 0) SELECT c_custkey, bool_and(s.bit_pos IS NOT NULL) AS may_contain FROM p LEFT JOIN s ON p.bit_pos = s.bit_pos GROUP BY c_custkey",
    "bits_per_key_table": "SELECT rate::DOUBLE AS rate, ceil(-ln(rate::DOUBLE) / pow(ln(2::DOUBLE), 2))::BIGINT AS bits FROM (VALUES (0.5), (0.1), (0.05), (0.01), (0.001), (0.0001)) AS r(rate)",
    "run_zone_map": f"WITH {RUNS} SELECT run, num_entries, size, {BOUNDS} FROM zones",
    "run_overlap": f"""WITH {RUNS}, probes AS (
  SELECT i AS probe, encode(lpad((i * 50)::VARCHAR, 12, '0')) AS lo, encode(lpad((i * 50 + 10)::VARCHAR, 12, '0')) AS hi FROM range(20) AS r(i))
SELECT id, level, probe FROM cat JOIN probes ON NOT (max_key < lo OR min_key > hi)""",
    "level_listing": f"WITH {RUNS} SELECT id, level, size, num_entries, {BOUNDS} FROM cat WHERE level = 1",
    "run_removal": f"WITH {RUNS} SELECT id, level, size, num_entries, {BOUNDS} FROM cat WHERE NOT EXISTS (SELECT 1 FROM cat x WHERE x.id % 4 = 0 AND x.id = cat.id AND x.level = cat.level)",
    "level_capacity": "SELECT i AS level, (4194304 * CASE WHEN i = 0 THEN 3 ELSE pow(10, i) END)::BIGINT AS capacity FROM range(5) AS r(i)",
    "block_pack": f"""WITH RECURSIVE {PAGES},
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY key) AS rn, 8 + octet_length(key) + len(value) // 2 AS sz FROM rows),
f AS (
  SELECT run, rn, 0 AS block, sz AS used, 1 AS restarts, 1 AS since FROM n WHERE rn = 1
  UNION ALL
  SELECT n.run, n.rn, CASE WHEN f.used + sz + 4 * (f.restarts + 1) + 4 <= 4096 THEN block ELSE block + 1 END,
         CASE WHEN f.used + sz + 4 * (f.restarts + 1) + 4 <= 4096 THEN f.used + sz ELSE sz END,
         CASE WHEN f.used + sz + 4 * (f.restarts + 1) + 4 <= 4096 THEN f.restarts + (f.since = 16)::INT ELSE 1 END,
         CASE WHEN f.used + sz + 4 * (f.restarts + 1) + 4 <= 4096 AND f.since < 16 THEN f.since + 1 ELSE 1 END
  FROM f JOIN n ON n.run = f.run AND n.rn = f.rn + 1)
SELECT f.run, f.block::INT AS block, count(*) AS entries, max(f.restarts)::BIGINT AS restarts, (max(f.used) + 4 * max(f.restarts) + 4)::BIGINT AS size,
       hex(min(n.key)) AS first_key, hex(max(n.key)) AS last_key
FROM f JOIN n ON f.run = n.run AND f.rn = n.rn GROUP BY f.run, f.block""",
    "block_scan": f"WITH {PAGES} SELECT run, hex(key) AS key, value FROM rows",
    "block_lookup": f"""WITH {PAGES}
SELECT run, hex(key) AS key, true AS found, value FROM rows
UNION ALL SELECT run, hex(key) || '21', false, NULL FROM rows""",
    "merge_read": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest",
    "flush_compact_read": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest WHERE value IS NOT NULL",
    "point_read": POINTS,
    "manifest_roundtrip": f"WITH {RUNS} SELECT id, level, 'run-' || id AS path, size, num_entries, {BOUNDS}, ((SELECT count(*) FROM cat) + 2)::INT AS version FROM cat WHERE id % 4 <> 0",
    "log_file_replay": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest",
    "compact_bottom": f"WITH {LATEST} SELECT {SHOWN}, seq FROM latest WHERE value IS NOT NULL",
}
