"""Quality classifier: hashed word n-gram logistic regression trained with FTRL-proximal updates.

Features of a text are the hashes, in a fixed number of buckets, of its words and word pairs in four
views: words with A-Z lower-cased, pairs of those, word shapes (runs of letters, of digits and of
each sign, by class) and pairs of shapes with a mark where a word repeats the one before. Each
feature's value is its share of the text's occurrences, so a score is a sparse dot product: the
mean of the weights at the text's features, plus a bias. Training takes a bounded sample of
labelled rows; scoring is a map over all rows with the weights as a broadcast (4 bytes a bucket).

Nulls: a null text is an empty one; it gets the bias's score. Labelled rows with a null label, null
id or an id that isn't in the documents are not learned from. Without learnable rows all scores
are 0.5. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import extended, learned_from, own_names, text_bytes
from keelson.llm.textvec import LOWER, U64, buffers, mix, segment_hashes, slices, words

BUCKET_BITS = 18
#: Bound of the sample of labelled rows that training uses.
SAMPLE = 6000
THRESHOLD = 0.7

SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[ord("A") : ord("Z") + 1] = ord("A")
SHAPE[ord("a") : ord("z") + 1] = ord("a")
SHAPE[ord("0") : ord("9") + 1] = ord("0")
SHAPE[0x80:] = ord("a")


def occurrences(data: np.ndarray, offs: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all texts, four for each word (a text's first pairs pair with a start mark), and each text's first place."""
    starts, ends, first = words(data, offs)
    n = len(starts)
    out = np.empty((n, 4), np.uint32)
    if n:
        shape = SHAPE[data]
        begin = np.zeros(len(data), bool)
        begin[starts] = True
        keep = begin.copy()
        keep[1:] |= shape[1:] != shape[:-1]
        at = np.concatenate([[0], np.cumsum(keep)])
        # Runs of one class count once; what lies between words is in no range.
        short = shape[keep]
        s, e = at[starts], at[ends]
        same = s == e
        shapes = segment_hashes(short, s, np.where(same, s + 1, e))
        plain = segment_hashes(LOWER[data], starts, ends)
        prior = np.zeros(n, U64)
        prior[1:] = plain[:-1]
        prior_shape = np.zeros(n, U64)
        prior_shape[1:] = shapes[:-1]
        lead = first[:-1][np.diff(first) > 0]
        prior[lead] = prior_shape[lead] = U64(1)
        repeat = (prior == plain).astype(U64)
        shift = U64(64 - bits)
        for k, h in enumerate((plain, mix(prior * U64(3) + plain), shapes * U64(5) + U64(1), mix(prior_shape * U64(7) + shapes + repeat))):
            out[:, k] = (mix(h + U64(k)) >> shift).astype(np.uint32)
    return out, first


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BUCKET_BITS, passes: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-5, l2: float = 1e-4, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal on (different feature buckets, occurrences of each, label)."""
    size = (1 << bits) + 1  # the last is the bias
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(seed)
    for _ in range(passes):
        for k in order.permutation(len(rows)):
            # Rows stay as small as they came: shares are worked out anew each time.
            some, count, label = rows[k]
            index = np.append(some.astype(np.int64), size - 1)
            value = np.append(count.astype(np.int64) / max(1, int(count.sum())) * SCALE, 1.0)
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -30, 30)))
            g = (p - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * wi
            n[index] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return (w[:-1] * SCALE).astype(np.float32), float(w[-1])


#: Shares are small numbers; features are scaled by this for training.
SCALE = 8.0


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes each, 1, 2 or 4, as hold the greatest."""
    top = int(x.max(initial=0))
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4")


def packed(features: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending different features as the gaps between them, and the occurrences of each, in few bytes."""
    return narrow(np.diff(features, prepend=features.dtype.type(0))).tobytes(), narrow(counts).tobytes()


def unpacked(number: int, gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """What packed() was given, the occurrences as narrow as they came."""
    if not number:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint8)
    some, count = (np.frombuffer(x, f"<u{len(x) // number}") for x in (gaps, counts))
    return np.cumsum(some, dtype=np.uint32), count


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 4, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights learned from a sample of labelled rows, chosen by hash of the id, outside the held-out remainder."""
    chosen = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__label")).where(learned_from(id_col, modulus) & F.col("__label").isin(0, 1)).orderBy(F.xxhash64(id_col), id_col, "__label").limit(sample)
    rows = documents.select(F.col(id_col), text_bytes(text_col).alias("__bytes")).join(F.broadcast(chosen), id_col)

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__bytes", 2 << 20):
            data, offs = buffers(b.column(1))
            at, first = occurrences(data, offs)
            sums = [np.unique(at[x:y], return_counts=True) for x, y in zip(first[:-1], first[1:], strict=True)]
            gaps, counts = zip(*(packed(*x) for x in sums), strict=True)
            number = pa.array([len(x[0]) for x in sums], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), number, pa.array(gaps, pa.binary()), pa.array(counts, pa.binary()), b.column(2)], names=["id", "number", "gaps", "counts", "label"])

    got = rows.select(id_col, "__bytes", "__label").mapInArrow(featurise, "id string, number int, gaps binary, counts binary, label int").toArrow()
    learned = [(key, label, *unpacked(number, gaps, counts)) for b in got.to_batches() for key, number, gaps, counts, label in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    del got
    learned.sort(key=lambda x: x[:2])
    # Only rows of one id and label are put in order by what they hold.
    ordered = [x for _, same in groupby(learned, key=lambda x: x[:2]) for x in in_order(list(same))]
    if not ordered:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    return train([(features, counts, label) for _, label, features, counts in ordered])


def in_order(same: list[tuple]) -> list[tuple]:
    return same if len(same) == 1 else sorted(same, key=lambda x: (x[2].astype("<u4").tobytes(), x[3].astype("<u4").tobytes()))


def score(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """(id, *keep, score, predicted): predicted is 1 where the score reaches the threshold."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)
    head = [id_col, *keep]
    schema = extended(documents.select(*head).schema, score="double", predicted="int")

    # A text that is kept isn't sent twice.
    at_text = head.index(text_col) if text_col in keep else len(head)
    name = text_col if text_col in keep else "__bytes"
    extra = [] if text_col in keep else [text_bytes(text_col).alias("__bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for b in slices(batches, name, 2 << 20):
            data, offs = buffers(b.column(at_text).cast(pa.binary()))
            at, first = occurrences(data, offs)
            each = weights[at].sum(axis=1, dtype=np.float64)
            total = np.concatenate([[0], np.cumsum(each)])
            n = np.maximum(1, 4 * np.diff(first))
            p = 1 / (1 + np.exp(-np.clip((total[first[1:]] - total[first[:-1]]) / n + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(head)], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[f.name for f in schema])

    return documents.select(*head, *extra).mapInArrow(run, schema)


def accepted(documents: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents' rows and columns, which may have any names, where the score reaches the threshold."""
    docs, own = own_names(documents)
    rest = tuple(o for c, o in own.items() if c != id_col)
    scored = score(docs, model, own[id_col], own[text_col], rest, threshold)
    return scored.where("predicted = 1").select(*(F.col(o).alias(c) for c, o in own.items()))
