"""Near-duplicate detection: fast similarity sketching, banding, exact verification, components.

A text's set is its distinct shingles of so many words. Its sketch has one value for each of
COORDINATES bins: in round after round all its shingles are hashed to a bin and a value, the least
value of the first round that reaches a bin stays, and after as many rounds as bins each further
round serves one bin, so every coordinate is filled. Equal sets become one node. Nodes that agree
in a band of the sketch are candidates.

No group emits its pairs. First each node is verified against one other of its buckets, the one
it shares most of them with as their least node; links found join nodes into components. Then only
buckets that still hold several components matter: nodes outside a bucket's largest component are
compared with the bucket's nodes of other components by sketch, in blocks of bounded size, and
likely ones, most alike first, on their sets of 32-bit hashes, until a link joins the components.
A pair is compared in one direction and in the first bucket that both share only. Only links leave
that step, to be verified on the full sets. A link between nodes of one component can't change the
result. A candidate pair is passed
over only if its sketches agree in so few coordinates that a link's chance is below 1e-8, or if the
sizes of the sets exclude it.

Links are verified on the full sets. Nulls: a row with a null id is linked with nothing, its
component is null and it is kept; a null text has an empty set. Equal ids share nothing but their
number. Empty tables give empty ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import atomic, digests, extended, own_names, Tables, text_bytes
from keelson.llm.textvec import U64, buffers, mix, slices, unique_sets, window_hashes, word_hashes

COORDINATES = 256
#: Bands have as many rows as keep the chance of missing a link at the threshold under this.
MISSED = 1e-4
#: Nodes of one block of a bucket, and the chance with which a link's sketches may agree too rarely to be verified.
BLOCK, UNLIKELY = 4096, 1e-8
#: Rows of a table that is broadcast.
FEW = 100_000
FULL = U64(0xFFFFFFFFFFFFFFFF)


def rows_of_band(percent: int) -> int:
    """Coordinates of a band: 8 at 85 percent, 6 at 80."""
    j = min(percent, 99) / 100
    return max(r for r in range(1, 33) if r == 1 or (1 - j**r) ** (COORDINATES // r) <= MISSED)


def least_agreement(percent: int) -> int:
    """Agreeing coordinates under which a pair isn't verified: 182 at 85 percent, 166 at 80."""
    j, sum_ = min(percent, 99) / 100, 0.0
    for k in range(COORDINATES + 1):
        sum_ += math.comb(COORDINATES, k) * j**k * (1 - j) ** (COORDINATES - k)
        if sum_ > UNLIKELY:
            return k
    return COORDINATES


def sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles as sorted hashes, and the places."""
    data, offs = buffers(column)
    h, first = word_hashes(data, offs)
    return unique_sets(*window_hashes(h, first, width))


def sketches(values: np.ndarray, place: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """(texts, t) sketch values; a text without shingles has FULL in all."""
    n = len(place) - 1
    out = np.full((n, t), FULL, U64)
    size = np.diff(place)
    active = np.flatnonzero(size)
    element = values
    owner = np.repeat(np.arange(len(active)), size[active])
    for k in range(2 * t):
        if not len(active):
            break
        h = mix(element + U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        fresh = np.full(len(active) * t, FULL, U64)
        at = (h >> U64(40)) % U64(t) if k < t else np.full(len(h), k - t, U64)
        np.minimum.at(fresh, owner * t + at.astype(np.int64), np.minimum(mix(h), FULL - U64(1)))
        have = out[active]
        have = np.where(have == FULL, fresh.reshape(-1, t), have)
        out[active] = have
        open_ = (have == FULL).any(axis=1)
        if not open_.all():
            stay = open_[owner]
            element, owner = element[stay], (np.cumsum(open_) - 1)[owner[stay]]
            active = active[open_]
    return out


def describe(df: DataFrame, id_col: str, text_col: str, width: int, rows: int) -> DataFrame:
    """(id, d1, d2, n, node, bands, sketch): hashes of the text; node is a hash of the whole set, null without shingles or id."""
    d1, d2 = digests(text_col)
    texts = df.select(F.col(id_col).alias("id"), d1.alias("d1"), d2.alias("d2"), text_bytes(text_col).alias("__bytes"))
    schema = extended(texts.drop("__bytes").schema, n="bigint", node="bigint", bands="array<bigint>", sketch="binary")
    bands = COORDINATES // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__bytes", 1 << 20):
            values, place = sets(b.column(3), width)
            size = np.diff(place)
            sketch = sketches(values, place)
            keys = np.full((len(size), bands), 0, U64) + np.arange(bands, dtype=U64)
            for r in range(rows):
                keys = mix(keys * U64(0x100000001B3) + sketch[:, : bands * rows].reshape(len(size), bands, rows)[:, :, r])
            raw = values.tobytes()
            node = [int.from_bytes(hashlib.blake2b(raw[8 * x : 8 * y], digest_size=8).digest(), "little", signed=True) for x, y in zip(place[:-1], place[1:], strict=True)]
            none = (size == 0) | np.asarray(b.column(0).is_null())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            low = np.ascontiguousarray((sketch & U64(0xFF)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(size), pa.array(np.array(node, np.int64), mask=none), lists, pa.array([x.tobytes() for x in low], pa.binary())], names=["id", "d1", "d2", "n", "node", "bands", "sketch"])

    return texts.mapInArrow(run, schema)


def full_sets(df: DataFrame, id_col: str, text_col: str, width: int, nodes: DataFrame) -> DataFrame:
    """(node, shingles, short) of nodes (node, label): from the texts of the rows whose ids are the labels.

    short: the same set as sorted 32-bit hashes.
    """
    wanted = nodes.select(F.col("label").alias("__label"), F.col("node").alias("__node"))
    texts = df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("__bytes")).join(wanted, F.col("id") == F.col("__label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__bytes", 2 << 20):
            values, place = sets(b.column(0), width)
            raw = values.tobytes()
            parts = [raw[8 * x : 8 * y] for x, y in zip(place[:-1], place[1:], strict=True)]
            own = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in parts]
            # An id that occurs with several texts: only the one of the node.
            keep = pa.array(np.array(own, np.int64) == np.asarray(b.column(1)))
            short = [np.unique(values[x:y].astype(np.uint32)).tobytes() for x, y in zip(place[:-1], place[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(parts, pa.binary()), pa.array(short, pa.binary())], names=["node", "shingles", "short"]).filter(keep)

    return texts.select("__bytes", "__node").mapInArrow(run, "node long, shingles binary, short binary")


def verified(pairs: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    one, other = (shingles.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in ("a", "b"))
    both = pairs.select("a", "b").join(one, "a").join(other, "b").select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = (np.frombuffer(z.as_buffer(), U64) for z in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                k = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[k] == small).sum())
                ok.append(100 * same >= percent * (len(p) + len(q) - same))
            yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def components(edges: DataFrame, tables: Tables, label: str) -> DataFrame:
    """(node, component): the least node reachable, by alternating large and small stars until nothing changes."""
    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-0")
    seen, k = None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if (state["n"], state["s"]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = (state["n"], state["s"])
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        k += 1
        now = tables.keep(small, f"{label}-{k}")


def links_of(mine: np.ndarray, size: int, sets_: list[np.ndarray], sizes: np.ndarray, component: np.ndarray, percent: int) -> list[tuple[int, bool]]:
    """Which of some sets, in their order, link with one, and whether for sure: the first of each component, and before it what is too close to tell.

    size, sizes: the sets' true numbers of elements, as 32-bit hashes may coincide.
    """
    found, done = [], set()
    for at in range(0, len(sets_), 64):
        some = [k for k in range(at, min(len(sets_), at + 64)) if component[k] not in done]
        if not some:
            continue
        place = np.cumsum([0, *(len(sets_[k]) for k in some)])
        every = np.concatenate([sets_[k] for k in some])
        same = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
        inter = np.add.reduceat(mine[same] == every, place[:-1])
        true = sizes[some]
        # Elements whose hashes coincide within a set are lost to the count; coincidences between sets add to it.
        lost = size - len(mine) + true - np.diff(place)
        union = size + true - inter
        maybe = 100 * (inter + lost) >= percent * (union - lost)
        sure = 100 * (inter - 1) >= percent * (union + 1)
        for k in np.flatnonzero(maybe):
            if component[some[k]] not in done:
                found.append((some[k], bool(sure[k])))
                if sure[k]:
                    done.add(component[some[k]])
    return found


def crossing(members: DataFrame, nodes: DataFrame, component: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that link: enough to join all components of a bucket that any of its candidate pairs would join."""
    known = members.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by = known.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    active = by.groupBy("bucket").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1")
    active = active.select("bucket", F.col("main.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("chunks"))
    rows = known.join(active, "bucket").join(nodes.select("node", "n", "sketch", "bands", "short"), "node")
    # A node's buckets of the bands before this one: pairs that share one of those meet there.
    rows = rows.withColumn("earlier", F.expr("slice(bands, 1, cast(array_position(bands, bucket) - 1 as int))")).withColumn("outside", F.col("component") != F.col("main"))
    spread = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    number = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    # With one block and one chunk, as nearly always, a bucket's rows go out once: who asks is also there.
    single = rows.where("blocks = 1 and chunks = 1").withColumns({"block": F.lit(0), "chunk": F.lit(0), "asks": F.col("outside"), "there": F.lit(True)})
    large = rows.where("blocks > 1 or chunks > 1")
    there = large.withColumns({"block": spread("blocks"), "chunk": number("chunks"), "asks": F.lit(False), "there": F.lit(True)})
    asking = large.where("outside").withColumns({"block": number("blocks"), "chunk": spread("chunks"), "asks": F.lit(True), "there": F.lit(False)})
    out = ["bucket", "block", "chunk", "asks", "there", "outside", "node", "component", "n", "sketch", "earlier", "short"]

    least = least_agreement(percent)

    def run(table: pa.Table) -> pa.Table:
        node, comp, n = (table.column(x).to_numpy() for x in ("node", "component", "n"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        short = [np.frombuffer(x, np.uint32) for x in table.column("short").to_pylist()]
        outside = table.column("outside").to_numpy()
        # All have as many, unless the keys of two bands coincide.
        earlier = table.column("earlier").to_pylist()
        same = min(map(len, earlier))
        earlier = np.array([x[:same] for x in earlier], np.int64).reshape(len(node), same)
        ask, have = (np.flatnonzero(table.column(x).to_numpy()) for x in ("asks", "there"))
        a, b = [], []
        # Components as they grow in this bucket; a link within one can't change anything.
        comp = np.unique(comp, return_inverse=True)[1]
        root = np.arange(len(comp))
        h_sketch, h_comp, h_n, h_earlier = sketch[have], comp[have], n[have], earlier[have]
        # Of two nodes that both ask, the greater one does.
        h_node = np.where(outside[have], node[have], np.iinfo(np.int64).min)
        for i in ask:
            fit = np.flatnonzero((root[h_comp] != root[comp[i]]) & (h_node < node[i]) & (100 * np.minimum(h_n, n[i]) >= percent * np.maximum(h_n, n[i])))
            fit = fit[~(h_earlier[fit] == earlier[i]).any(axis=1)]
            agree = (h_sketch[fit] == sketch[i]).sum(axis=1)
            likely = agree >= least
            fit = fit[likely][np.argsort(-agree[likely], kind="stable")]
            for k, sure in links_of(short[i], int(n[i]), [short[have[f]] for f in fit], h_n[fit], root[h_comp[fit]], percent):
                a.append(node[i])
                b.append(node[have[fit[k]]])
                if sure:
                    root[root == root[h_comp[fit[k]]]] = root[comp[i]]
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.maximum(x, y), "b": np.minimum(x, y)})

    every = single.select(out).unionByName(there.select(out)).unionByName(asking.select(out))
    return every.groupBy("bucket", "block", "chunk").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, tables: Tables | None = None, with_digests: bool = False) -> DataFrame:
    """(id, n_shingles, component_id, kept): links are 100 * intersection >= percent * union of shingle sets.

    component_id is the smallest id reachable over links, kept is true for it alone. with_digests adds
    d1 and d2, two hashes of the text, which tell rows of one id apart.
    """
    tables = tables or Tables(df.sparkSession, "neardup")
    rows = tables.keep(describe(df, id_col, text_col, width, rows_of_band(percent)), "rows")
    known = rows.where("node is not null")
    # One row for each different set; sums before the shuffle take care of sets that many rows share.
    nodes = tables.keep(known.groupBy("node").agg(F.min("id").alias("label")), "nodes")
    bands = known.select("node", F.explode("bands").alias("bucket")).distinct()
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    members = tables.keep(bands.join(shared.select("bucket", "least"), "bucket"), "members")
    candidate = members.select("node").distinct()
    # Copies fall together before the shuffle: a set that many rows share sends one row a task.
    detail = tables.keep(known.select("node", "n", "sketch", "bands").dropDuplicates(["node"]).join(candidate, "node", "left_semi"), "detail")
    shingles = tables.keep(full_sets(df, id_col, text_col, width, nodes.join(candidate, "node", "left_semi")), "shingles")
    star = members.where("node <> least").groupBy("node", "least").count().groupBy("node").agg(F.max(F.struct("count", "least")).alias("m")).select(F.col("node").alias("a"), F.col("m.least").alias("b"))
    links = tables.keep(verified(star, shingles, percent), "links-0")
    component = components(links, tables, "star")
    pairs = crossing(members.select("bucket", "node"), detail.join(shingles.select("node", "short"), "node"), component, percent)
    links = links.unionByName(tables.keep(verified(pairs, shingles, percent), "links-1"))
    component = components(links, tables, "all")
    grouped = nodes.join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("label").alias("component_id"))
    final = tables.keep(grouped.join(least, "component").select("node", "component_id"), "final")
    for name in ("shingles", "members", "detail"):
        tables.drop(name)
    more = ["d1", "d2"] if with_digests else []
    out = rows.select("id", F.col("n").alias("n_shingles"), "node", *more).join(final, "node", "left")
    component_id = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"), *more)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, tables: Tables | None = None) -> DataFrame:
    """df's rows and columns, which may have any names, but one row of each group of near-duplicates.

    The row of the smallest id stays; of several with this id and texts of this group the one of the least
    text hash, of equal ones the one of the least hash of the other columns. Rows without words or id all stay.
    """
    tables = tables or Tables(df.sparkSession, "dedup")
    docs, own = own_names(df)
    judged = tables.keep(near_duplicates(docs.select(own[id_col], own[text_col]), own[id_col], own[text_col], width, percent, with_digests=True).withColumnRenamed(own[id_col], "id"), "judged")
    # Rows that stay have their group's id, so nothing is gathered by group, however large one is.
    grouped = judged.where("id is not null and n_shingles > 0").groupBy("id", "d1", "d2", "kept").agg(F.count("*").alias("copies"))
    first = grouped.where("kept").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("first"))
    stay = grouped.where("kept").join(first, "id").withColumn("stays", F.struct("d1", "d2") == F.col("first")).drop("first")
    held = stay.unionByName(grouped.where("not kept").withColumn("stays", F.lit(False)))
    held = tables.keep(held.select(F.col("id").alias("__id"), F.col("d1").alias("__1"), F.col("d2").alias("__2"), "stays", "copies"), "held")
    d1, d2 = digests(own[text_col])
    rows = docs.withColumns({"__d1": d1, "__d2": d2})
    same = (F.col(own[id_col]) == F.col("__id")) & (F.col("__d1") == F.col("__1")) & (F.col("__d2") == F.col("__2"))
    several = held.where("stays and copies > 1")
    out = rows.join(held.where("not stays").unionByName(several), same, "left_anti")
    number = several.count()
    if number:
        nth = F.row_number().over(Window.partitionBy(own[id_col], "__d1", "__d2").orderBy(F.xxhash64(F.lit(0), *atomic(docs, list(own.values())))))
        once = rows.join(F.broadcast(several) if number <= FEW else several, same, "left_semi").withColumn("__nth", nth).where("__nth = 1").drop("__nth")
        out = out.unionByName(once)
    return out.select(*(F.col(o).alias(c) for c, o in own.items()))
