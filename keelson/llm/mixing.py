"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Sources have weights that repeat over their order. The total budget is a share of all words; a
source's target grows with its weight and stops at so many times its words, what it leaves goes to
the others by weight. That is the state of a fair queue at one virtual time: each source has had
min(weight x time, cap) words. So the queue is run as such: a document, shuffled within its source
by hash, finishes its first pass at (words up to and with it in its source) / weight, its second one
a source's words later; all passes are range-sorted by finish time and taken while the total
stays within the budget. No source goes beyond its cap, as it has no more passes.

Sums over a source's documents are prefix sums by bucket of the shuffle hash, and sums over the
global order are prefix sums by bucket of the finish time, so no task sees a whole source or the
whole order. Tables of sources are sorted in one task: a row for each source. The sources' targets
and the documents in line are written as tables: each is used several times, and one plan of it all
would be planned anew, whole, on the driver after each of its exchanges.

Nulls: a null text has no words, a null source is a source of its own and comes last. Equal rows
are queued each for itself. Without any word, everything is 0. Empty tables give empty ones.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import atomic, digests, own_names, Tables

WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2
PER_BUCKET = 20_000
#: Rows of a table that is broadcast.
FEW = 100_000
#: Fixed value: a word.
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): a row for each source.

    A source is full at time cap * size / weight. In order of these times, the words given out when
    a source is full are the caps of those before it and the time's share of the rest; the queue
    stops at the time that uses up the budget. A source without words has target 0.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    t = t.withColumns({
        "spent": F.coalesce(F.sum(cap * F.col("source_size")).over(earlier), F.lit(0)),
        "left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)),
        "budget": budget * F.sum("source_size").over(everything),
    })
    stop = (F.col("budget") - F.col("spent")) / F.col("left")
    # The stop counts for the first source that isn't full by then; all later ones share it.
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("time", F.first(F.when(stop <= F.col("full_at"), stop), ignorenulls=True).over(whole))
    target = F.least(cap * F.col("source_size").cast("double"), F.coalesce(F.col("weight") * F.col("time"), cap * F.col("source_size").cast("double")))
    return t.withColumn("target", target).select("source", "source_size", "weight", "target")


def running(df: DataFrame, group: list[str], order: list[Column], spread: Column, amount: str, out: str) -> DataFrame:
    """df with the sum of `amount` up to and with each row in its group's order.

    spread: a bucket number that rises with the order. Windows run within (group, bucket); the
    sums of earlier buckets are joined to them.
    """
    spread_df = df.withColumn("__bucket", spread)
    sums = spread_df.groupBy(*group, "__bucket").agg(F.sum(amount).alias("__sum"))
    earlier = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(g).alias(f"__g{k}") for k, g in enumerate(group)), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    local = F.sum(amount).over(Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(g).eqNullSafe(F.col(f"__g{k}")) for k, g in enumerate(group)] + [F.col("__bucket") == F.col("__b")]
    joined = spread_df.withColumn("__local", local).join(offsets, on=same)
    return joined.withColumn(out, F.col("__local") + F.col("__before")).select(*df.columns, out)


def shuffled(id_col: str, seed: int) -> Column:
    """A row's place in the shuffle: 60 bits of the MD5 of the id as text; equal ids are side by side."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """(id, source, size, shuffle, d1, d2): what the queue needs of each row; rows that agree in all are equal to it."""
    d1, d2 = digests(text_col)
    return df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), shuffled(id_col, seed).alias("shuffle"), d1.alias("d1"), d2.alias("d2"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: int = 17, tables: Tables | None = None) -> DataFrame:
    """(id, size, source, source_size, target, passes, taken) for each row: how often the mix takes it, and its words in the mix."""
    tables = tables or Tables(df.sparkSession, "mixing")
    rows = tables.keep(sized(df, id_col, text_col, source_col, seed), "sizes")
    return queue(rows, tables, weights, budget, cap).drop("d1", "d2").withColumnRenamed("id", id_col)


def same_row(left: list[str], right: list[str]) -> Column:
    """Whether id, source and the two hashes of the text agree."""
    pairs = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left[:2], right[:2], strict=True)]
    return reduce(and_, pairs + [F.col(a) == F.col(b) for a, b in zip(left[2:], right[2:], strict=True)])


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP, seed: int = 17, tables: Tables | None = None) -> DataFrame:
    """df's own rows and columns, which may have any names, as the mix takes them: each as often as it has passes.

    Rows without words are not taken. Rows of equal id, source and text share their passes; which of them
    is taken more often goes by a hash of their other columns. Texts are shuffled once.
    """
    tables = tables or Tables(df.sparkSession, "mixing")
    rows = tables.keep(sized(df, id_col, text_col, source_col, seed), "sizes")
    key = ["id", "source", "d1", "d2"]
    total = tables.keep(queue(rows, tables, weights, budget, cap).groupBy(key).agg(F.count("*").alias("copies"), F.sum("passes").alias("passes")).where("passes > 0"), "passes")
    tables.drop("lined")
    docs, own = own_names(df)
    d1, d2 = digests(own[text_col])
    mine = ["__id", "__source", "__d1", "__d2"]
    docs = docs.withColumns(dict(zip(mine, (F.col(own[id_col]), F.col(own[source_col]).cast("string"), d1, d2), strict=True)))
    alone, shared = total.where("copies = 1"), total.where("copies > 1")
    out = docs.join(alone, same_row(mine, key)).withColumn("__times", F.col("passes"))
    number = shared.count()
    if number:
        # Rows that come several times over are looked for beside all others only where there are any.
        some = docs.join(F.broadcast(shared) if number <= FEW else shared, same_row(mine, key))
        nth = F.row_number().over(Window.partitionBy(*mine).orderBy(F.xxhash64(F.lit(0), *atomic(docs, list(own.values())))))
        more = F.when(nth <= F.col("passes") % F.col("copies"), 1).otherwise(0)
        out = out.unionByName(some.withColumn("__times", F.floor(F.col("passes") / F.col("copies")) + more))
    each = out.where("__times > 0").withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return each.select(*(F.col(o).alias(c) for c, o in own.items()))


def queue(rows: DataFrame, tables: Tables, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = CAP) -> DataFrame:
    """Run the queue over (id, source, size, shuffle, d1, d2). What it returns reads the table "lined"."""
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    buckets = max(16, -(-total["n"] // PER_BUCKET), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    limit = int(budget * total["words"])
    # A row for each source.
    goals = tables.keep(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, cap), "goals")
    # 2^60 hash values in equal ranges; a source's rows spread over them whatever its share.
    spread = F.floor(F.col("shuffle") / F.lit(float(1 << 60)) * buckets).cast("int")
    key = [F.col("shuffle"), F.col("id").asc_nulls_first(), F.col("size"), F.col("d1"), F.col("d2")]
    lined = running(rows, ["source"], key, spread, "size", "upto")
    g = goals.select(F.col("source").alias("__source"), "source_size", "weight", "target")
    lined = tables.keep(lined.join(g, F.col("source").eqNullSafe(F.col("__source"))).drop("__source"), "lined")
    passes = lined.where("size > 0").withColumn("pass", F.explode(F.array(*map(F.lit, range(cap))))).withColumn("finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("weight"))
    # The queue stops about when the sources that aren't full reach their targets.
    horizon = goals.agg(F.greatest(F.lit(1e-9), F.coalesce(F.max(F.col("target") / F.col("weight")), F.lit(0.0))).alias("horizon")).first()["horizon"]
    share = F.col("finish") / F.lit(horizon)
    by_time = F.floor(2 * buckets * share / (1 + share)).cast("int")
    order = [F.col("finish"), F.col("source").asc_nulls_last(), *key, F.col("pass")]
    taken = running(passes.withColumn("__all", F.lit(0)), ["__all"], order, by_time, "size", "given").where(F.col("given") <= limit)
    one = ["id", "source", "d1", "d2"]
    counted = taken.groupBy(one).agg(F.count("*").alias("__passes"))
    same = Window.partitionBy(one)
    line = lined.withColumn("__copies", F.count("*").over(same)).withColumn("__nth", F.row_number().over(same.orderBy("upto")))
    c = counted.select(*(F.col(x).alias(f"__{x}") for x in one), "__passes")
    joined = line.join(c, same_row(one, [f"__{x}" for x in one]), "left")
    # Equal rows share their passes: each gets the whole share, the first ones what is over.
    n, copies = F.coalesce("__passes", F.lit(0)), F.col("__copies")
    own = F.floor(n / copies) + F.when(F.col("__nth") <= n % copies, 1).otherwise(0)
    return joined.withColumn("passes", own.cast("int")).withColumn("taken", F.col("passes") * F.col("size")).select("id", "size", "source", "d1", "d2", "source_size", "target", "passes", "taken")
