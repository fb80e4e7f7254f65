"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so a packing problem of any size is a histogram of at
most `capacity` counts. The driver solves that: best-fit decreasing gives the first incumbent, and bin
completion looks for fewer bins by branching over the undominated fillings around the longest length
left, least waste first; a branch ends where the bins it aims at can't afford its waste. The plan has a
few thousand kinds of filling at most (each use of one ends a length or a bin) with a few tens of
lengths in each, whatever the number of pieces, so it's broadcast. Pieces get their place by rank among
pieces of equal length; ranks come from small (length, bucket) groups and prefix sums, so a length
that a third of all pieces share is spread over all buckets.

Nulls: a null text is an empty one (its end id alone). Equal rows are packed each for itself. An
empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm import bpe
from keelson.llm.common import extended, Tables, text_bytes
from keelson.llm.textvec import buffers, slices

CAPACITY = 2048
#: A packing: (lengths of one sequence, in order; number of such sequences).
Plan = list[tuple[tuple[int, ...], int]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over counts of lengths; bins of equal contents are kept together."""
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], n: int, gap: int) -> None:
        if not by_gap[gap]:
            bisect.insort(gaps, gap)
        by_gap[gap].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                each = capacity // length
                if left >= each:
                    put((length,) * each, left // each, capacity - each * length)
                    left %= each
                else:
                    put((length,) * left, 1, capacity - left * length)
                    left = 0
                continue
            gap = gaps[k]
            pattern, n = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps.pop(k)
            each = min(gap // length, left)
            full = min(n, left // each)
            if full < n:
                put(pattern, n - full, gap)
            put(pattern + (length,) * each, full, gap - each * length)
            left -= full * each
    return [x for gap in by_gap for x in by_gap[gap]]


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A number of bins that no packing can do without (Martello and Toth's L2).

    Items beyond half the capacity need a bin each; of the others those of at least so much must fit beside
    them, and not beside those that leave less; the best such bound counts, and with 0 that of the total.
    """
    size, number = (np.zeros(capacity + 2, np.int64) for _ in range(2))
    for x, n in counts.items():
        size[x], number[x] = x * n, n
    size, number = np.cumsum(size), np.cumsum(number)  # of items up to each length
    half = capacity // 2
    k = np.arange(half + 1)
    beside = size[capacity - k] - size[half]
    room = (number[capacity - k] - number[half]) * capacity - beside
    small = size[half] - np.where(k > 0, size[k - 1], 0)
    return int((number[capacity] - number[half] + np.maximum(0, -((room - small) // capacity))).max())


def dominated(filling: tuple[int, ...], waste: int, free: int) -> bool:
    """Whether some of the items could give way to one longer item, or several to one as long, that still fits (Martello and Toth).

    free: the lengths of which an item is left beside the filling, as bits. All sets of items are looked at, as bits of their sums.
    """
    some, several = 0, 0
    for x in filling:
        several |= several << x | some << x
        some |= some << x | 1 << x
    longer, width = some << 1, 1
    while width < waste:
        step = min(width, waste - width)
        longer |= longer << step
        width += step
    return bool(free & several or waste and free & longer)


def reachable(lengths: list[int], counts: dict[int, int], capacity: int) -> list[int]:
    """For each number of lengths from the shortest, the sums that their items can make up, as bits."""
    out, every = [1], (1 << capacity + 1) - 1
    for x in lengths:
        bits, left, step = out[-1], min(counts[x], capacity // x), 1
        while left:
            step = min(step, left)
            bits |= bits << x * step & every
            left, step = left - step, step * 2
        out.append(bits)
    return out


class Search:
    """Bin completion: whether all items fit in so many bins, by depth-first search within a budget of steps.

    Each node fills the bin of the longest item left. Fillings come in falling order, least waste first;
    only undominated ones whose waste the bins can still afford are tried, each for as many bins as
    its counts allow, and on return for fewer. Bins that begin with the same item come in one order.
    """

    def __init__(self, counts: dict[int, int], capacity: int, budget: int):
        self.counts, self.capacity, self.budget = dict(counts), capacity, budget
        self.lengths = sorted(counts)
        self.top = len(self.lengths) - 1
        # The best packing met whose last bins, beyond a dead end, are best-fit; and how few items were.
        self.best: Plan | None = None
        self.loose = sum(counts.values())

    def complete(self, trail: list[list]) -> None:
        """At a dead end with fewer items left than at any before: pack them best-fit."""
        left = sum(self.counts.values())
        if left < self.loose:
            self.loose = left
            plan = [((n[1], *n[3][1]), n[4]) for n in trail if n[3] is not None and n[4]]
            plan += best_fit_decreasing({x: n for x, n in self.counts.items() if n}, self.capacity)
            if self.best is None or sum(n for _, n in plan) < sum(n for _, n in self.best):
                self.best = plan

    def around(self, longest: int) -> tuple[dict[int, int], list[int], list[int], int]:
        """What may go with an item: counts, lengths, the sums that the shorter ones of them make up, and the lengths as bits."""
        room = self.capacity - longest
        counts = {x: self.counts[x] - (x == longest) for x in self.lengths[: bisect.bisect_right(self.lengths, min(room, longest))]}
        here = [x for x, n in counts.items() if n]
        self.budget -= len(here)
        return counts, here, reachable(here, counts, room), sum(1 << x for x in here)

    def fillings(self, longest: int, most: int, after: tuple[int, tuple[int, ...]] | None) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(waste, other items) of undominated fillings that waste at most so much, later than `after`.

        Between two fillings only the stack is kept: the counts are again what they were, so the tables are made anew.
        """
        room = self.capacity - longest
        tables = self.around(longest)
        for waste in range(after[0] if after else 0, min(most, room) + 1):
            if not tables[2][-1] >> room - waste & 1:
                continue
            # (items so far, sum left, place of the longest that may follow)
            stack = [((), room - waste, len(tables[1]) - 1)]
            while stack:
                counts, here, sums, free = tables
                items, left, k = stack.pop()
                self.budget -= 1
                if self.budget <= 0:
                    return
                if not left:
                    used_up = sum(1 << x for x in set(items) if items.count(x) == counts[x])
                    late = after is None or (waste, tuple(-x for x in items)) > (after[0], tuple(-x for x in after[1]))
                    if late and not dominated(items, waste, free & ~used_up):
                        tables = counts = here = sums = free = None
                        yield waste, items
                        tables = self.around(longest)
                    continue
                # The longest length that may follow goes first; shorter ones only where they can make up the rest.
                k = min(k, bisect.bisect_right(here, left) - 1)
                if k < 0 or not sums[k + 1] >> left & 1:
                    continue
                x = here[k]
                stack.append((items, left, k - 1))
                if counts[x] > items.count(x):
                    stack.append(((*items, x), left - x, k))

    def run(self, bins: int) -> Plan | None:
        """A plan of so many bins or fewer; None if there is none, or if the budget is used up."""
        allowed = bins * self.capacity - sum(k * n for k, n in self.counts.items())
        if allowed < 0:
            return None
        # (fillings to come, item, waste allowed, filling in use, times, most)
        trail: list[list] = []

        def open_node(waste_left: int, before: tuple | None) -> bool:
            while self.lengths and not self.counts[self.lengths[self.top]]:
                if self.top == 0:
                    return False
                self.top -= 1
            longest = self.lengths[self.top]
            after = before[1] if before and before[0] == longest else None
            trail.append([self.fillings(longest, waste_left, after), longest, waste_left, None, 0, self.top])
            return True

        if not open_node(allowed, None):
            return []
        while trail:
            if self.budget <= 0:
                return None
            node = trail[-1]
            longest, waste_left = node[1], node[2]
            self.top = node[5]
            if node[3] is not None and node[4]:
                # Give one bin back; the filling may be of use fewer times.
                for x in (longest, *node[3][1]):
                    self.counts[x] += 1
                node[4] -= 1
            if node[3] is None or not node[4]:
                following = next(node[0], None)
                if following is None:
                    if node[3] is None:
                        self.complete(trail)
                    trail.pop()
                    continue
                waste, items = following
                need: dict[int, int] = defaultdict(int)
                for x in (longest, *items):
                    need[x] += 1
                times = min(self.counts[x] // n for x, n in need.items())
                if waste:
                    times = min(times, waste_left // waste)
                for x, n in need.items():
                    self.counts[x] -= n * times
                node[3], node[4] = following, times
            if not open_node(waste_left - node[3][0] * node[4], (longest, node[3])):
                return [((n[1], *n[3][1]), n[4]) for n in trail]
        return None


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, budget: int = 8_000_000) -> tuple[Plan, bool]:
    """A packing of a histogram of lengths, and whether it's proven that fewer bins don't do.

    Best-fit decreasing gives the first incumbent, least_bins() a number that excludes fewer. Between the two bin
    completion looks for better incumbents: first in the least number, then halfway between what is
    excluded and the incumbent. The budget of steps, of which each search gets an eighth of what is left,
    is the only bound. Where a search uses its share up its number of bins isn't excluded, so
    the result isn't called proven; it is always whole.
    """
    counts = {k: n for k, n in counts.items() if n}
    if not counts:
        return [], True
    number = lambda plan: sum(n for _, n in plan)
    incumbent = best_fit_decreasing(counts, capacity)
    bins = least = least_bins(counts, capacity)
    proven = True
    while least < number(incumbent):
        share = max(1, budget // 8)
        search = Search(counts, capacity, share)
        found = search.run(bins)
        budget -= share - max(0, search.budget)
        if found is None:
            proven = proven and search.budget > 0
            least = bins + 1
            found = search.best
        if found is not None and number(found) < number(incumbent):
            incumbent = found
        bins = (least + number(incumbent)) // 2
    return incumbent, proven


def segments(plan: Plan) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: ranks from `rank` on go to sequences from `sequence` on, `copies` to each, the first at `offset`."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for length in dict.fromkeys(filling):
            copies = filling.count(length)
            rows.append((length, used[length], sequence, copies, offset))
            used[length] += copies * times
            offset += copies * length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "copies", "offset"), table.T, strict=True))


def cut(size: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities at its end, the rest first."""
    first = size % capacity or capacity
    starts = [0, *range(first, size, capacity)]
    return [(a, min(b, size) - a) for a, b in zip(starts, [*starts[1:], size], strict=True)]


def pieces(df: DataFrame, paths: tuple, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and end id, cut where they exceed the capacity.

    with_ids adds the ids themselves, as little-endian unsigned 32-bit bytes.
    """
    schema = extended(df.select(F.col(id_col)).schema, piece="int", start="bigint", length="bigint", ids_crc32="bigint", **({"ids": "binary"} if with_ids else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__bytes", 4 << 20):
            data, offs = buffers(b.column(1))
            sizes, ids = bpe.encode(data, offs, paths)
            place = np.concatenate([[0], np.cumsum(sizes)])
            raw = memoryview(ids.astype("<u4").tobytes())
            end = int(end_id).to_bytes(4, "little")
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for k in range(len(sizes)):
                a, n = 4 * int(place[k]), int(sizes[k])
                for j, (s, m) in enumerate(cut(n + 1, capacity)):
                    part = raw[a + 4 * s : a + 4 * min(s + m, n)]
                    c = zlib.crc32(part)
                    if s + m > n:
                        c = zlib.crc32(end, c)
                    row.append(k), piece.append(j), start.append(s), length.append(m), crc.append(c)
                    if with_ids:
                        own.append(bytes(part) + (end if s + m > n else b""))
            columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.binary())] if with_ids else []), names=[f.name for f in schema])

    return df.select(F.col(id_col), text_bytes(text_col).alias("__bytes")).mapInArrow(run, schema)


def ranked(df: DataFrame, id_col: str, per_bucket: int = 20_000) -> DataFrame:
    """df with `rank`, from 0, among rows of equal length, without a window over a whole length.

    Rows fall into buckets by hash; a window ranks within (length, bucket), and each bucket's
    offset is the sum of the counts of those before it.
    """
    spark = df.sparkSession
    buckets = max(16, -(-df.count() // per_bucket), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col(id_col), "piece", "start", "ids_crc32"]
    spread = df.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = spread.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    local = spread.withColumn("local", F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order)))
    return local.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1).drop("before", "local", "bucket")


def pack(pieces_df: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY, tables: Tables | None = None) -> DataFrame:
    """The pieces with sequence_id and offset: gapless from 0 in each sequence."""
    spark = pieces_df.sparkSession
    tables = tables or Tables(spark, "packing")
    kept = tables.keep(pieces_df, "pieces")
    names = kept.columns
    counts = {r["length"]: r["count"] for r in kept.groupBy("length").count().collect()}
    plan = spark.sparkContext.broadcast(segments(bin_completion(counts, capacity)[0]))
    rows = ranked(kept, id_col)
    schema = extended(kept.schema, sequence_id="bigint", offset="bigint")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = plan.value
        key = (s["length"] << 44) + s["rank"]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(x))) for x in ("length", "rank"))
            k = np.searchsorted(key, (length << 44) + rank, "right") - 1
            ahead = rank - s["rank"][k]
            sequence = s["sequence"][k] + ahead // s["copies"][k]
            offset = s["offset"][k] + ahead % s["copies"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(x)) for x in names), pa.array(sequence), pa.array(offset)], names=[f.name for f in schema])

    return rows.select(*names, "rank").mapInArrow(place, schema)
