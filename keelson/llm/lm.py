"""Language model scores by deleted interpolation of word n-gram estimates.

P(w | u v) = a3 c(u v w)/c(u v) + a2 c(v w)/c(v) + a1 c(w)/N + a0/(V + 1). The weights depend on the
bucket of the frequency of the longest context that is known, and are learned by expectation-
maximisation on held-out counts: a seventh of the training texts is taken out of all counts and its tokens
are scored by what is left. Scores then use the counts of all training texts. V + 1 is the number
of different training tokens and one class for all others, so probabilities add up to 1.

Texts are packed where they are read into blocks of bounded size, which are written, compressed, as
a table bucketed by block. A block sends its distinct n-grams (sorted 64-bit hashes, with their
counts in its training texts) to ranges of the hash space, one message to each range that it has any
in; a range adds up what all blocks sent and answers each with the totals of just what it asked
for, in the same order. So there are never more messages than a block has n-grams, n-grams move once for
each block, not once for each occurrence, texts aren't shuffled, no table is broadcast, and memory
is bounded by blocks and ranges whatever the corpus. The answers are a table too; a block meets them
twice, for the held-out counts and for the scores. What the driver sees of the held-out counts is
bounded: numbers of tokens by (bucket, ratios in steps of half a power of two).

Pairs and longer n-grams are told apart by so many bits of their hash that at most about one in
2^24 shares them with another, at every size of the corpus; words by all 64.

Nulls: a null text is an empty one and has only its end token; a null id isn't learned from. Rows
are scored each for itself; repeated ones all count. Without training texts N = V = 0 and all
tokens have probability 1. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import extended, held_out, learned_from, remainder, Tables, text_bytes
from keelson.llm.textvec import U64, buffers, mix, slices, word_hashes

ORDER = 3
#: Hashes that stand for what is before a text and for its end.
BEGIN, END = U64(0x5555AAAA0F0F0001), U64(0x5555AAAA0F0F0002)
#: Text of a block; buckets of a context's frequency, of which the first ones are single numbers.
BLOCK, BUCKETS, SINGLE = 10 << 20, 24, 4
#: Steps of a power of two in which ratios are held, the one that stands for 0, and the bits of each.
STEPS, ZERO, WIDTH = 2, -500, 12


def pack(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes; sorted hashes shrink by their high bytes. Few are left as they are."""
    if len(values) < 32:
        return values.tobytes()
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    if n < 32:
        return np.frombuffer(data, kind)
    width = np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data, n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def grams(data: np.ndarray, offs: np.ndarray, bits: int = 64) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the hash of the n-gram that ends at each token; and the texts' places among the tokens."""
    h, first = word_hashes(data, offs)
    place = np.concatenate([[0], np.cumsum(np.diff(first) + 1)])
    own = np.full(place[-1], END, U64)
    word = np.ones(place[-1], bool)
    word[place[1:] - 1] = False
    own[word] = h
    low = U64((1 << 64) - (1 << (64 - bits)))
    orders, before = [own], own
    for _ in range(ORDER - 1):
        # The tokens before, one more each time.
        last = np.empty_like(before)
        last[1:] = before[:-1]
        last[place[:-1]] = BEGIN
        before = last
        orders.append(mix(orders[-1] * U64(0x9E3779B97F4A7C15) + mix(before)))
    return [own, *(x & low for x in orders[1:])], place


def block_of(row: pa.RecordBatch | pa.Table, k: int = 0) -> tuple[np.ndarray, np.ndarray, dict]:
    """A block's bytes, its texts' offsets and its other lists."""
    get = lambda name: row.column(row.schema.get_field_index(name))[k]
    offs = np.concatenate([[0], np.cumsum(np.asarray(get("lengths").values, np.int64))])
    raw = pa.Codec("zstd").decompress(get("texts").as_py(), int(offs[-1]), asbytes=True) if offs[-1] else b""
    lists = {n: np.asarray(get(n).values.to_numpy(zero_copy_only=False), bool) for n in ("learn", "held", "apart")}
    return np.frombuffer(raw, np.uint8), offs, lists | {"ids": get("ids").values}


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, ids, learn, held, apart, lengths, texts): the rows of each task, so many bytes of text together."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, parts, size
            t = pa.Table.from_batches(parts).combine_chunks()
            data, offs = buffers(t.column("bytes"))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            lists = [one(t.column(n).combine_chunks()) for n in ("id", "learn", "held", "apart")]
            text = pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)
            out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, one(pa.array(np.diff(offs))), pa.array([text], pa.binary())], names=["block", "ids", "learn", "held", "apart", "lengths", "texts"])
            number, parts, size = number + 1, [], 0
            return out

        for b in slices(batches, "bytes", min(block_bytes, 1 << 20)):
            n = b.column(b.schema.get_field_index("bytes")).nbytes
            if parts and size + n > block_bytes:
                yield block()
            parts.append(b)
            size += n
        if parts:
            yield block()

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, learn array<boolean>, held array<boolean>, apart array<boolean>, lengths array<long>, texts binary")


def bucketed(df: DataFrame, tables: Tables, column: str, number: int) -> DataFrame:
    """df as a table in the shared folder, bucketed by a column, so that joining on it doesn't shuffle it again."""
    name = f"keelson_{uuid.uuid4().hex}"
    df.write.bucketBy(number, column).format("parquet").option("compression", "zstd").option("path", f"{tables.root}/{name}").saveAsTable(name)
    table = df.sparkSession.table(name)
    # What is resolved keeps its files; nothing but the name goes.
    df.sparkSession.sql(f"DROP TABLE {name}")
    return table


def asked(batches: Iterator[pa.RecordBatch], ranges: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Each block's messages, one to each range for each order that it has n-grams in."""
    shift = U64(64 - (ranges.bit_length() - 1))
    for b in batches:
        for k in range(b.num_rows):
            data, offs, lists = block_of(b, k)
            orders, place = grams(data, offs, bits)
            counted, apart = (np.repeat(lists[x], np.diff(place)) for x in ("learn", "apart"))
            for order, h in enumerate(orders):
                distinct, inverse = np.unique(h, return_inverse=True)
                n, held = (np.bincount(inverse, x, minlength=len(distinct)).astype("<u4") for x in (counted, apart))
                part = (distinct >> shift).astype(np.int64) if ranges > 1 else np.zeros(len(distinct), np.int64)
                to = np.unique(part)
                edge = [*np.searchsorted(part, to).tolist(), len(part)]
                cells = [[pack(x[a:z]) for a, z in zip(edge[:-1], edge[1:], strict=True)] for x in (distinct, n, held)]
                columns = [pa.array(to + order * ranges), pa.array(np.full(len(to), b.column(0)[k].as_py(), np.int64)), pa.array(np.diff(edge), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "block", "size", "hashes", "counts", "held"])


def answered(table: pa.Table) -> pa.Table:
    """A range's totals, for each block in the order that it asked in; and once its different n-grams and its tokens."""
    size = table.column("size").to_numpy()
    read = lambda name, kind: np.concatenate([unpack(x, n, kind) for x, n in zip(table.column(name).to_pylist(), size.tolist(), strict=True)])
    distinct, inverse = np.unique(read("hashes", "<u8"), return_inverse=True)
    total, held = (np.bincount(inverse, read(x, "<u4"), minlength=len(distinct)).astype("<u8") for x in ("counts", "held"))
    place = np.concatenate([[0], np.cumsum(size)])
    cut = lambda x: pa.array([pack(x[inverse[a:b]]) for a, b in zip(place[:-1], place[1:], strict=True)], pa.binary())
    once = lambda x: pa.array(np.where(np.arange(len(size)) == 0, int(x), 0), pa.int64())
    return pa.table({"block": table.column("block"), "range": table.column("range"), "size": table.column("size"), "counts": cut(total), "held": cut(held), "different": once((total > 0).sum()), "all": once(total.sum()), "all_held": once(held.sum())})


def level(c: np.ndarray) -> np.ndarray:
    """The bucket of a frequency: small ones stand alone, others by powers of two."""
    return np.where(c <= SINGLE, c, np.minimum(BUCKETS - 1, SINGLE - 1 + np.log2(np.maximum(c, 1)).astype(np.int64)))


def contexts(counts: list[np.ndarray], first: np.ndarray, texts: int) -> list[np.ndarray]:
    """For each order from 2, the counts of the tokens before: as often as the n-gram that ends there; before a text, as there are texts."""
    out = []
    for c in counts[:-1]:
        x = np.empty_like(c)
        x[1:] = c[:-1]
        x[first] = texts
        out.append(x)
    return out


def estimates(counts: list[np.ndarray], first: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's bucket, by its longest known context, and its estimates from the highest order down."""
    before = contexts(counts, first, texts)
    by = np.zeros(len(counts[0]), np.int64)
    for order, c in enumerate(before):
        by = np.where(c > 0, order * BUCKETS + level(c), by)
    f = [counts[0] / max(n, 1)] + [c / np.maximum(b, 1) for c, b in zip(counts[1:], before, strict=True)]
    return by, np.stack(f[::-1], axis=1)


def binned(by: np.ndarray, f: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of tokens by bucket and quantised log2 ratios of their estimates to 1 / (V + 1)."""
    q = np.where(f > 0, np.round(STEPS * np.log2(np.maximum(f, 1e-300) * (v + 1.0))), ZERO).astype(np.int64) + (1 << WIDTH - 1)
    key = by
    for k in range(ORDER):
        key = key << WIDTH | q[:, k]
    return np.unique(key, return_counts=True)


def weights(keys: np.ndarray, hits: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights (highest order first, the uniform last) by bucket, by expectation-maximisation on the held-out counts."""
    number = (ORDER - 1) * BUCKETS
    allowed = np.ones((number, ORDER + 1), bool)
    for order in range(ORDER - 1):
        # Without a known context of some length, what needs it has no weight.
        allowed[order * BUCKETS : (order + 1) * BUCKETS, : ORDER - 2 - order] = False
    allowed[0, : ORDER - 1] = False
    out = start = allowed / allowed.sum(axis=1, keepdims=True)
    by = keys >> WIDTH * ORDER
    q = np.stack([(keys >> WIDTH * (ORDER - 1 - k) & (1 << WIDTH) - 1) - (1 << WIDTH - 1) for k in range(ORDER)], axis=1)
    f = np.concatenate([np.where(q <= ZERO, 0.0, 2.0 ** (q / STEPS)), np.ones((len(keys), 1))], axis=1)
    for _ in range(rounds):
        share = f * out[by]
        share *= (hits / share.sum(axis=1))[:, None]
        # One token's worth of the start weights keeps every class possible.
        new = np.stack([np.bincount(by, share[:, k], minlength=number) for k in range(ORDER + 1)], axis=1) + start
        new /= new.sum(axis=1, keepdims=True)
        change, out = np.abs(new - out).max(), new
        if change < 1e-7:
            break
    return out


def met(replies: pa.Table, rows: pa.Table, bits: int, ranges: int, apart: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, dict]:
    """The counts and the held-out counts of the n-grams of each order at a block's tokens; the texts' places; the block's lists.

    apart: only at the tokens of the texts that are set apart.
    """
    data, offs, lists = block_of(rows)
    orders, place = grams(data, offs, bits)
    sizes = np.diff(place)
    some = np.repeat(lists["apart"], sizes)
    replies = replies.sort_by("range")
    order_of = replies.column("range").to_numpy() // ranges
    total, held = [], []
    for order, h in enumerate(orders):
        if apart:
            at = np.searchsorted(np.unique(h), h[some])
        else:
            at = np.unique(h, return_inverse=True)[1]
        orders[order] = h = None
        own = replies.filter(pa.array(order_of == order))
        number = own.column("size").to_pylist()
        for name, out in (("counts", total), ("held", held)):
            out.append(np.concatenate([unpack(x, n, "<u8") for x, n in zip(own.column(name).to_pylist(), number, strict=True)]).astype(np.int64)[at])
    return total, held, np.concatenate([[0], np.cumsum(sizes[lists["apart"]])]) if apart else place, lists


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, block_bytes: int | None = None, tables: Tables | None = None) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row's whole text.

    block_bytes: text of a block; by default BLOCK, and less where that would leave cores without a block.
    """
    spark = df.sparkSession
    tables = tables or Tables(spark, "lm")
    apart = F.coalesce(remainder(id_col, modulus) == 3, F.lit(False))
    docs = df.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("bytes"), learned_from(id_col, modulus).alias("learn"), held_out(id_col, modulus).alias("held"), apart.alias("apart"))
    size = df.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("b")).first()["b"] or 0
    block_bytes = block_bytes or min(BLOCK, max(1 << 20, size // (2 * spark.sparkContext.defaultParallelism)))
    number = max(1, -(-size // block_bytes))
    ranges = 1 << max(0, (number - 1).bit_length())
    # 24 bits beyond the logarithm of the number of tokens, if they take four bytes each.
    bits = min(64, max(20, size.bit_length()) + 22)
    rows = bucketed(blocks(docs, block_bytes), tables, "block", min(10_000, max(8, number)))
    asks = rows.mapInArrow(lambda b: asked(b, ranges, bits), "range long, block long, size long, hashes binary, counts binary, held binary")
    replies = tables.keep(asks.groupBy("range").applyInArrow(answered, "block long, range long, size long, counts binary, held binary, different long, all long, all_held long"), "replies")
    words = replies.where(F.col("range") < ranges).agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("different", "all", "all_held"))).first()
    true = lambda x: F.coalesce(F.sum(F.size(F.filter(x, lambda y: y))), F.lit(0))
    texts = rows.agg(true("learn").alias("learn"), true("apart").alias("apart")).first()
    n, v = words["all"], words["different"]
    answers = replies.select("block", "range", "size", "counts", "held").groupBy("block")

    def held_counts(replies: pa.Table, table: pa.Table) -> pa.Table:
        total, held, place, _ = met(replies, table, bits, ranges, apart=True)
        by, f = estimates([t - h for t, h in zip(total, held, strict=True)], place[:-1], texts["learn"] - texts["apart"], n - words["all_held"])
        keys, hits = binned(by, f, v)
        return pa.table({"bin": pa.array(keys, pa.int64()), "hits": pa.array(hits, pa.int64())})

    bins = answers.cogroup(rows.groupBy("block")).applyInArrow(held_counts, "bin long, hits long").groupBy("bin").agg(F.sum("hits").alias("hits")).orderBy("bin").toPandas()
    shared = spark.sparkContext.broadcast(weights(bins["bin"].to_numpy(np.int64), bins["hits"].to_numpy(np.float64)))
    out = extended(df.select(F.col(id_col)).schema, held_out="boolean", n_tokens="bigint", n_known="bigint", train_tokens="bigint", base_score="double", score="double")

    def finish(replies: pa.Table, table: pa.Table) -> pa.Table:
        total, _, place, lists = met(replies, table, bits, ranges)
        by, f = estimates(total, place[:-1], texts["learn"], n)
        lam = shared.value[by]
        p = (f * lam[:, :-1]).sum(axis=1) + lam[:, -1] / (v + 1.0)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[place])
        base, own = sums(np.log10((total[0] + 1.0) / (n + v + 1.0))), sums(np.log10(p) if n else np.zeros(len(p)))
        each = np.diff(place)
        return pa.table([lists["ids"], pa.array(lists["held"]), pa.array(each), pa.array(sums(total[0] > 0)), pa.array(np.full(len(each), n, np.int64)), pa.array(base), pa.array(own)], names=[x.name for x in out])

    return answers.cogroup(rows.groupBy("block")).applyInArrow(finish, out)
