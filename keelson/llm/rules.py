"""Quality rules: a modified Kneser-Ney n-gram model by language, with perplexity bands.

The model predicts the characters of a word, and its edge, from up to three before them. Characters are
themselves, in UTF-16 units (one beyond U+FFFF is two units, an invalid byte a lone surrogate), so an
n-gram is a number of 64 bits: none is folded into another and none collides. Spark counts the n-grams of
all documents (each task adds up its own first). While the languages are few and the tables small,
which is checked, they are broadcast and texts stay where they are; tasks turn them into models. Beyond that
Spark estimates the same probabilities by joins, texts are packed into blocks, a block asks for its
different n-grams and is answered by a join, so no table is gathered anywhere, however large.
A model is sorted hash arrays for every order: of the n-grams with their probabilities, and of the
contexts with the weight left to the order below. Hashes are invertible.
A word's probability is a mean of its language's model and of the model over all languages, so
that a foreign passage isn't mistaken for noise; the language's weight nears a half as its evidence
grows. Perplexity is by character, of the whole document.
Each language's bands lie so many interquartile ranges below and above the median of its documents'
log perplexities, both averaged with those of all documents by how many documents the language has.
A document is rejected if its own log perplexity lies outside them, whatever its
length and whatever single passages are like.

Nulls: a null text has no words. Documents of a null language use the model over all languages and
the band of all documents. Repeated rows are scored each for itself. Empty tables give empty ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import extended, Tables, text_bytes
from keelson.llm.lm import bucketed
from keelson.llm.textvec import IS_SPACE, U64, buffers, group_sums, mix, segment_hashes, slices, words, window_hashes

#: Characters of an n-gram, and bits of a UTF-16 unit.
ORDER, UNIT = 4, 16
#: Characters and documents with which a language's model and band get half of their full weight.
EVIDENCE, BAND_EVIDENCE = 1 << 17, 8
#: Languages, and n-grams of all of them together, whose tables are broadcast: at most 32 MB.
HELD_LANGUAGES, HELD_GRAMS = 32, 1 << 21
#: N-grams that a task holds before it sends their numbers on, and text of a block.
SENT, BLOCK = 1 << 20, 8 << 20
#: Half widths of the bands in interquartile ranges of log perplexity, below and above the median.
BELOW, ABOVE = 4.0, 4.5
#: Symbols that count as such.
SYMBOLS = b"#*$%&|<>"

LN10 = np.log(10)
IS_SYMBOL = np.zeros(256, np.int64)
IS_SYMBOL[list(SYMBOLS)] = 1


def word_table(data: np.ndarray, offs: np.ndarray):
    """Words of a batch: hashes, distinct ones with an example, and each text's first place."""
    starts, ends, first = words(data, offs)
    h = segment_hashes(data, starts, ends)
    distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    return starts, ends, first, h, distinct, at, inverse


def grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of words (edge, characters, edge; three edges before) and the word of each.

    With bits = UNIT each UTF-16 unit is itself (0 is the edge and U+0000 has the number of the blank, which
    no word has). With fewer bits the units that occur are numbered from 1, and must fit.
    """
    size = ends - starts + 1
    edge = np.cumsum(size)
    k = np.arange(int(size.sum())) - np.repeat(edge - size, size)
    spelled = np.full(len(k), 0x20, np.uint8)
    inside = np.ones(len(k), bool)
    inside[edge - 1] = False
    spelled[inside] = data[(np.repeat(starts, size) + k)[inside]]
    unit = np.frombuffer(spelled.tobytes().decode("utf-8", "surrogateescape").encode("utf-16-le", "surrogatepass"), "<u2")
    blank = unit == 0x20
    if bits == UNIT:
        symbol = np.where(unit == 0, 0x20, unit)
    else:
        own, symbol = np.unique(np.where(blank, 0, unit.astype(np.int64) + 1), return_inverse=True)
        if len(own) > 1 << bits:
            raise ValueError(f"{len(own)} different characters don't fit {bits} bits")
    symbol = np.where(blank, 0, symbol).astype(U64)
    last = np.flatnonzero(blank)
    owner = np.repeat(np.arange(len(last)), np.diff(last, prepend=-1))
    place = np.arange(len(unit)) - np.concatenate([[0], last + 1])[owner]
    out = symbol.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(out), U64)
        before[back:] = symbol[:-back]
        out |= np.where(place >= back, before, U64(0)) << U64(bits * back)
    return out, owner


def added(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams in order, with the sums of their numbers."""
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(n, first) if len(first) else n


def counts(documents: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, gram, n): n-grams of all documents by language, the null one too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for lang, (g, n) in held.items():
                for a in range(0, len(g), 1 << 16):
                    some = g[a : a + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(some), np.int64))), pa.array(some), pa.array(n[a : a + (1 << 16)])], names=["lang", "gram", "n"])
            held.clear()

        for b in slices(batches, "__bytes", 4 << 20):
            data, offs = buffers(b.column(0))
            starts, ends, first, h, distinct, at, inverse = word_table(data, offs)
            names = list(dict.fromkeys(b.column(1).to_pylist()))
            code = np.array([names.index(x) for x in b.column(1).to_pylist()], np.int64)
            lang = np.repeat(code, np.diff(first))
            for k, name in enumerate(names):
                times = np.bincount(inverse[lang == k], minlength=len(distinct))
                some = np.flatnonzero(times)
                g, owner = grams(data, starts[at[some]], ends[at[some]], UNIT)
                before = held.get(name, (np.zeros(0, U64), np.zeros(0, np.int64)))
                held[name] = added(np.concatenate([before[0], g]), np.concatenate([before[1], times[some][owner]]))
            if sum(len(g) for g, _ in held.values()) > SENT:
                yield from sent()
        yield from sent()

    rows = documents.select(text_bytes(text_col).alias("__bytes"), F.col(lang_col).cast("string").alias("__lang"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(n: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney's discounts for counts of 0, 1, 2 and 3 or more."""
    return discounts_by(*(float((n == k).sum()) for k in (1, 2, 3, 4)))


def discounts_by(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """The discounts by how many n-grams occur once, twice, three and four times."""
    if not n1 or not n2:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0] + [min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d[1:], strict=True)])


def low(bits: int) -> int:
    return (1 << bits) - 1


def hashed(gram: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorted hash array with its values as log10; the hash is invertible, so n-grams never collide."""
    h = mix(gram)
    order = np.argsort(h)
    return h[order], np.log10(np.maximum(values[order], 1e-12)).astype(np.float32)


def found(table: tuple[np.ndarray, np.ndarray], gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which n-grams a sorted hash array has, and the values of all (of those it hasn't: any)."""
    h = mix(gram)
    k = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
    return table[0][k] == h, table[1][k]


def estimate(gram: np.ndarray, n: np.ndarray, bits: int = 6) -> dict:
    """A model from counts of different highest-order n-grams of one language.

    Lower orders use continuation counts (numbers of different characters before). Returns for each
    order, from the highest, the sorted hash arrays of its n-grams with log10 probabilities and of their
    contexts with the log10 weight left to the order below.
    """
    tables = [added(gram.astype(U64), n.astype(np.int64))]
    for k in range(ORDER - 1, 0, -1):
        lower = tables[-1][0] & U64(low(bits * k))
        tables.append(added(lower, np.ones(len(lower), np.int64)))
    orders, contexts = [], []
    for k, (own, c) in zip(range(1, ORDER + 1), tables[::-1], strict=True):
        d = discounts(c)[np.minimum(c, 3)]
        first = np.flatnonzero(np.concatenate([[True], np.diff(own >> U64(bits)) != 0]))
        total = np.add.reduceat(c, first)
        weight = np.add.reduceat(d, first) / total
        size = np.diff(np.append(first, len(own)))
        # An n-gram that occurs has an end that occurs.
        below = 1 / (1 << bits) if k == 1 else p[np.searchsorted(shorter, own & U64(low(bits * (k - 1))))]
        p = (c - d) / np.repeat(total, size) + np.repeat(weight, size) * below
        shorter = own
        orders.append(hashed(own, p))
        contexts.append(hashed(own[first] >> U64(bits), weight))
    return {"bits": bits, "orders": orders[::-1], "contexts": contexts[::-1]}


def log_probability(model: dict, gram: np.ndarray) -> np.ndarray:
    """log10 probabilities of n-grams, seen or not."""
    bits, gram = model["bits"], gram.astype(U64)
    out, left = np.zeros(len(gram), np.float64), np.arange(len(gram))
    for k, order, context in zip(range(ORDER, 0, -1), model["orders"], model["contexts"], strict=True):
        known, p = found(order, gram[left] & U64(low(bits * k)))
        out[left[known]] += p[known]
        left = left[~known]
        if not len(left):
            return out
        known, weight = found(context, (gram[left] & U64(low(bits * k))) >> U64(bits))
        out[left[known]] += weight[known]
    out[left] -= bits * np.log10(2)
    return out


def estimated(table: DataFrame, tables: Tables, name: str) -> DataFrame:
    """(by, gram, p): what estimate() gives for the highest order, by joins, from (by, gram, n); `by` is never null."""
    levels = [tables.keep(table.select("by", "gram", F.col("n").alias("c")), f"{name}{ORDER}")]
    for k in range(ORDER - 1, 0, -1):
        lower = levels[-1].groupBy("by", F.col("gram").bitwiseAND(F.lit(low(UNIT * k))).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels.append(tables.keep(lower, f"{name}{k}"))
    below = None
    for k, own in zip(range(1, ORDER + 1), levels[::-1], strict=True):
        # One short row for each language.
        number = own.groupBy("by").agg(*(F.count_if(F.col("c") == x).alias(f"n{x}") for x in (1, 2, 3, 4))).collect()
        d = table.sparkSession.createDataFrame([(r["by"], *discounts_by(*map(float, r[1:]))[1:].tolist()) for r in number], "by string, d1 double, d2 double, d3 double")
        own = own.join(F.broadcast(d), "by").withColumn("d", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = Window.partitionBy("by", F.shiftrightunsigned("gram", UNIT))
        own = own.select("by", "gram", F.col("gram").bitwiseAND(F.lit(low(UNIT * (k - 1)))).alias("end"), (F.col("c") - F.col("d")).alias("high"), F.sum("c").over(context).alias("total"), F.sum("d").over(context).alias("left"))
        shorter = F.lit(1 / (1 << UNIT)) if below is None else F.col("below")
        own = own if below is None else own.join(below.select("by", F.col("gram").alias("end"), F.col("p").alias("below")), ["by", "end"])
        below = own.select("by", "gram", (F.col("high") / F.col("total") + F.col("left") / F.col("total") * shorter).alias("p"))
    return below


def repeated_windows(hashes: np.ndarray, first: np.ndarray, width: int = 3) -> np.ndarray:
    """For each text, the words in windows that occur twice or more in it."""
    n = np.diff(first)
    windows, place = window_hashes(hashes, first, width)
    owner = np.repeat(np.arange(len(n)), np.diff(place))
    _, inverse, count = np.unique(mix(windows + owner.astype(U64) * U64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    often = (count[inverse] > 1) & (n[owner] >= width) if len(windows) else np.zeros(0, bool)
    at = (first[:-1][owner] + np.arange(len(windows)) - place[:-1][owner])[often]
    covered = np.zeros(len(hashes), np.int64)
    for k in range(width):
        covered[at + k] = 1
    return group_sums(covered, first)


def held_tables(table: DataFrame) -> dict[str | None, tuple[np.ndarray, np.ndarray]]:
    """Each language's n-grams in order, and their numbers; for tables whose size is checked."""
    rows = table.toArrow()
    lang, gram, n = rows["lang"].combine_chunks().dictionary_encode(), rows["gram"].to_numpy().view(U64), rows["n"].to_numpy()
    code = lang.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return {None if k < 0 else lang.dictionary[int(k)].as_py(): added(gram[code == k], n[code == k]) for k in np.unique(code)}


#: A worker's models of languages, by fit; only the newest fit's.
_models: dict[str, dict[str, tuple[dict, float]]] = {}


def own_weight(n: int) -> float:
    """The weight of a language's model beside the one of all languages, by its n-grams."""
    return n / (n + EVIDENCE) / 2


def language_model(fit_: str, lang: str, gram: np.ndarray, n: np.ndarray) -> tuple[dict, float]:
    """A language's model and its weight."""
    if fit_ not in _models:
        _models.clear()
    known = _models.setdefault(fit_, {})
    if lang not in known:
        known[lang] = estimate(gram, n, UNIT), own_weight(int(n.sum()))
    return known[lang]


def fit(documents: DataFrame, tables: Tables, text_col: str = "text", lang_col: str = "lang") -> dict[str | None, tuple[np.ndarray, np.ndarray]] | tuple[DataFrame, dict[str | None, float]]:
    """Each language's counts, held here if few and small; else (lang, gram, own, pooled), log10 probabilities by its language's model and by that of all, and the languages' weights."""
    table = tables.keep(counts(documents, text_col, lang_col), "counts")
    size = table.agg(F.count(F.lit(1)).alias("grams"), F.count_distinct("lang").alias("languages")).first()
    if size["grams"] <= HELD_GRAMS and size["languages"] <= HELD_LANGUAGES:
        return held_tables(table)
    own = estimated(table.where("lang is not null").withColumnRenamed("lang", "by"), tables, "own")
    every = estimated(table.groupBy(F.lit("").alias("by"), "gram").agg(F.sum("n").alias("n")), tables, "pooled")
    log10 = lambda x: F.log10(x).cast("float")
    rows = table.join(every.select("gram", log10(F.col("p")).alias("pooled")), "gram").join(own.select(F.col("by").alias("lang"), "gram", log10(F.col("p")).alias("own")), ["lang", "gram"], "left")
    # One short row for each language.
    weights = {r["lang"]: own_weight(r["n"]) for r in table.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return tables.keep(rows.select("lang", "gram", "own", "pooled"), "probabilities"), weights


def by_language(langs: list[str | None]) -> dict[str | None, list[int]]:
    """The rows of each language."""
    by: dict[str | None, list[int]] = {}
    for k, x in enumerate(langs):
        by.setdefault(x, []).append(k)
    return by


def blocks(texts: DataFrame, kind: str) -> DataFrame:
    """(block, ids, langs, lengths, texts): the rows of each task, so many bytes of text together, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, parts, size = TaskContext.get().partitionId() << 32, [], 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            data, offs = buffers(t.column(1))
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            lists = [one(x) for x in (t.column(0).combine_chunks(), t.column(2).combine_chunks(), pa.array(np.diff(offs)))]
            text = pa.Codec("zstd", 3).compress(data.tobytes(), asbytes=True)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([text], pa.binary())], names=["block", "ids", "langs", "lengths", "texts"])

        for b in slices(batches, "__bytes", 1 << 20):
            n = int(buffers(b.column(1))[1][-1])
            if parts and size + n > BLOCK:
                yield block()
                number, parts, size = number + 1, [], 0
            parts.append(b)
            size += n
        if parts:
            yield block()

    return texts.mapInArrow(run, f"block long, ids array<{kind}>, langs array<string>, lengths array<long>, texts binary")


def rows_of(table: pa.RecordBatch | pa.Table, k: int = 0) -> pa.RecordBatch:
    """A block's (id, text, language)."""
    get = lambda x: table.column(table.schema.get_field_index(x))[k]
    offs = np.concatenate([[0], np.cumsum(np.asarray(get("lengths").values, np.int64))])
    raw = pa.Codec("zstd").decompress(get("texts").as_py(), int(offs[-1]), asbytes=True) if offs[-1] else b""
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(raw)])
    return pa.RecordBatch.from_arrays([get("ids").values, texts, get("langs").values], names=["id", "__bytes", "__lang"])


def measures(documents: DataFrame, model, tables: Tables, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, language, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_perplexity) of each whole text.

    Log perplexity is by character in log10; null without words. With tables that are held, texts
    aren't shuffled. Else they are packed into blocks; a block asks for its different n-grams.
    """
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = extended(documents.select(F.col(id_col)).schema, language="string", **dict.fromkeys(counted, "bigint"), log_perplexity="double")

    def score(b: pa.RecordBatch, lang: str | None, probabilities: Callable[[np.ndarray], tuple], weight: float) -> pa.RecordBatch:
        data, offs = buffers(b.column(1))
        starts, ends, first, h, distinct, at, inverse = word_table(data, offs)
        n_words = np.diff(first)
        inside = np.concatenate([[0], np.cumsum(~IS_SPACE[data] & (data & 0xC0 != 0x80))])
        symbols = np.concatenate([[0], np.cumsum(IS_SYMBOL[data])])
        g, owner = grams(data, starts[at], ends[at], UNIT)
        by_word, length = np.zeros(len(at)), np.zeros(len(at))
        if len(g):
            some, place = np.unique(g, return_inverse=True)
            own, pooled = probabilities(some)
            by_word = np.bincount(owner, pooled[place], minlength=len(at))
            if own is not None:
                by_own = np.bincount(owner, own[place], minlength=len(at))
                by_word = np.logaddexp(by_own * LN10 + np.log(weight), by_word * LN10 + np.log1p(-weight)) / LN10
            # The second unit of a character is none of its own.
            length = np.bincount(owner, g & U64(0xFC00) != U64(0xDC00), minlength=len(at))
        total, chars = group_sums(by_word[inverse], first), group_sums(length[inverse], first)
        lines = []
        for x in b.column(1).to_pylist():
            rows = [line for line in x.split(b"\n") if line.strip()] if b"\n" in x else []
            lines.append(len(rows) - len(set(rows)))
        return pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([lang] * b.num_rows, pa.string()), *(pa.array(np.asarray(x, np.int64)) for x in (n_words, inside[offs[1:]] - inside[offs[:-1]], symbols[offs[1:]] - symbols[offs[:-1]], lines, repeated_windows(h, first))), pa.array(-total / np.maximum(chars, 1), mask=n_words == 0)],
            names=[f.name for f in schema],
        )

    texts = documents.select(F.col(id_col), text_bytes(text_col).alias("__bytes"), F.col(lang_col).cast("string").alias("__lang"))
    if isinstance(model, dict):
        context, name = documents.sparkSession.sparkContext, uuid.uuid4().hex
        held = context.broadcast({x: own for x, own in model.items() if x is not None})
        shared = context.broadcast(estimate(*(np.concatenate(x) for x in zip(*model.values(), strict=True)), UNIT) if model else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "__bytes", 4 << 20):
                by = by_language(b.column(2).to_pylist())
                for x, at in by.items():
                    mine, weight = language_model(name, x, *held.value[x]) if x in held.value else (None, 0.0)
                    yield score(b.take(pa.array(at)) if len(by) > 1 else b, x, lambda g, mine=mine: (log_probability(mine, g) if mine else None, log_probability(shared.value, g)), weight)

        return texts.mapInArrow(run, schema)
    probabilities, weights = model
    size = texts.agg(F.sum(F.octet_length("__bytes")).alias("n")).first()["n"] or 0
    packed = bucketed(blocks(texts, schema[0].dataType.simpleString()), tables, "block", min(10_000, max(8, size // BLOCK)))
    shared_weights = documents.sparkSession.sparkContext.broadcast(weights)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for k in range(t.num_rows):
                rows = rows_of(t, k)
                for x, at in by_language(rows.column(2).to_pylist()).items():
                    g = np.zeros(0, U64)
                    for b in slices([rows.take(pa.array(at))], "__bytes", 1 << 20):
                        data, offs = buffers(b.column(1))
                        starts, ends, _, _, _, first, _ = word_table(data, offs)
                        g = np.union1d(g, grams(data, starts[first], ends[first], UNIT)[0])
                    for a in range(0, len(g), 1 << 16):
                        some = g[a : a + (1 << 16)].view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), t.column(0)[k].as_py(), np.int64)), pa.array([x], pa.string()).take(pa.array(np.zeros(len(some), np.int64))), pa.array(some)], names=["block", "__of", "__gram"])

    def finish(answers: pa.Table, table: pa.Table) -> pa.Table:
        rows, out = rows_of(table), []
        lang = answers.column("lang").combine_chunks().dictionary_encode()
        code, names = lang.indices.fill_null(-1).to_numpy(zero_copy_only=False), lang.dictionary.to_pylist()
        gram, ps = answers.column("gram").to_numpy().view(U64), [answers.column(c).to_numpy() for c in ("own", "pooled")]
        for x, at in by_language(rows.column(2).to_pylist()).items():
            own = np.flatnonzero(code == (names.index(x) if x in names else -1))
            own = own[np.argsort(gram[own])]
            g, mine, pooled = gram[own], None if x is None else ps[0][own], ps[1][own]

            def probabilities(some: np.ndarray, g=g, mine=mine, pooled=pooled) -> tuple:
                k = np.minimum(np.searchsorted(g, some), len(g) - 1)
                # All were counted and asked for.
                if not len(g) or (g[k] != some).any():
                    raise ValueError("an n-gram has no answer")
                return None if mine is None else mine[k], pooled[k]

            out += [score(b, x, probabilities, shared_weights.value.get(x, 0.0)) for b in slices([rows.take(pa.array(at))], "__bytes", 1 << 20)]
        return pa.Table.from_batches(out)

    asks = packed.mapInArrow(asked, "block long, __of string, __gram long")
    answers = asks.join(probabilities, F.col("__of").eqNullSafe(F.col("lang")) & (F.col("__gram") == F.col("gram"))).select("block", "lang", "gram", "own", "pooled")
    return answers.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(finish, schema)


def judge(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE, least_words: int = 50, tables: Tables | None = None) -> DataFrame:
    """measures() with base_failed, perplexity, band_low, band_high and kept."""
    tables = tables or Tables(documents.sparkSession, "rules")
    rows = tables.keep(measures(documents, fit(documents, tables, text_col, lang_col), tables, id_col, text_col, lang_col), "measures")
    rows = rows.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    judged, quartile = rows.where(~F.col("base_failed")), F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    everything = judged.agg(quartile.alias("__all"))
    own = judged.where("language is not null").groupBy("language").agg(quartile.alias("__q"), F.count(F.lit(1)).alias("__n"))
    # One short row for each language.
    out = rows.crossJoin(F.broadcast(everything)).join(F.broadcast(own), "language", "left")
    share = F.coalesce(F.col("__n") / (F.col("__n") + BAND_EVIDENCE), F.lit(0.0))
    blend = lambda x: F.coalesce(share * x(F.col("__q")), F.lit(0.0)) + (1 - share) * x(F.col("__all"))
    middle, spread = blend(lambda q: q[1]), blend(lambda q: q[2] - q[0])
    out = out.withColumns({"low": middle - below * spread, "high": middle + above * spread})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.withColumns({"perplexity": F.pow(F.lit(10.0), F.col("log_perplexity")), "band_low": F.pow(F.lit(10.0), F.col("low")), "band_high": F.pow(F.lit(10.0), F.col("high")), "kept": ~F.col("base_failed") & inside}).drop("low", "high", "language", "log_perplexity", "__all", "__q", "__n")
