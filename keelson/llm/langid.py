"""Language identification by a byte convolutional network in numpy.

Bytes (A-Z lower-cased) are embedded; filters of widths 2, 3 and 4 run over windows of fixed length;
each filter's maximum over the window goes through a softmax layer. The network is trained with
Adam on windows spread over a bounded sample of labelled texts. Prediction is a map over all texts:
each whole text is cut into windows, batches of windows go through the network, and the text's
probabilities are the windows' means, weighted by their bytes.

Nulls: a null text, or one without a letter, is `und` with score 0. A null language is not learned
from. Without learnable rows everything is `und`. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import extended, learned_from, text_bytes
from keelson.llm.textvec import LOWER, buffers, slices

WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4), 16, 8, 128
REACH = max(WIDTHS)
#: Bounds of training: texts for each language, texts of all (one of each language at least), windows of a text.
PER_LANGUAGE, TEXTS, WINDOWS = 800, 51200, 6
STEP = 64


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of each text (n, WINDOW) with zero bytes after its end, the text of each, and its bytes."""
    size = np.diff(offs)
    number = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), number)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    start = offs[:-1][owner] + k * WINDOW
    left = np.minimum(WINDOW, offs[1:][owner] - start)
    # A text's last window starts earlier, so that it's full where the text is long enough.
    back = np.where(size[owner] >= WINDOW, WINDOW - left, 0)
    have = np.where(size[owner] >= WINDOW, WINDOW, left)
    place = (start - back)[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < have[:, None]
    out = np.where(inside, LOWER[data[np.minimum(place, max(0, len(data) - 1))]], 0) if len(owner) else np.zeros((0, WINDOW), np.uint8)
    return out.astype(np.uint8), owner, left


class Network:
    """Weights, forward and backward passes."""

    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        f = FILTERS * len(WIDTHS)
        self.mask = np.zeros((REACH, DIM, f), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(REACH * DIM, f)
        normal = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
        self.p = {"embed": normal(256, DIM) * 0.5, "conv": normal(REACH * DIM, f) * 0.25 * self.mask, "bias": np.zeros(f, np.float32), "out": normal(f, classes) * 0.2, "out_bias": np.zeros(classes, np.float32)}
        self.p["embed"][0] = 0

    def columns(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), WINDOW + REACH - 1, DIM), np.float32)
        padded[:, :WINDOW] = self.p["embed"][x]
        s = padded.strides
        view = np.lib.stride_tricks.as_strided(padded, (len(x), WINDOW, REACH * DIM), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view)

    def pooled(self, cols: np.ndarray) -> np.ndarray:
        return (cols.reshape(-1, REACH * DIM) @ self.p["conv"]).reshape(len(cols), WINDOW, -1)

    def softmax(self, top: np.ndarray) -> np.ndarray:
        z = np.maximum(top + self.p["bias"], 0) @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.p["out_bias"])), np.float32)
        for a in range(0, len(x), STEP):
            out[a : a + STEP] = self.softmax(self.pooled(self.columns(x[a : a + STEP])).max(axis=1))
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols = self.columns(x)
        response = self.pooled(cols)
        at = response.argmax(axis=1)
        top = np.take_along_axis(response, at[:, None, :], axis=1)[:, 0]
        act = np.maximum(top + self.p["bias"], 0)
        d = self.softmax(top)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        back = (d @ self.p["out"].T) * (act > 0)
        picked = cols[np.arange(len(x))[:, None], at]
        conv = np.einsum("nf,nfk->kf", back, picked, optimize=True) * self.mask
        spread = (back[:, :, None] * self.p["conv"].T[None]).reshape(-1, REACH, DIM)
        padded = np.concatenate([x, np.zeros((len(x), REACH - 1), x.dtype)], axis=1)
        place = at[:, :, None] + np.arange(REACH)
        bytes_at = padded[np.arange(len(x))[:, None, None], place].reshape(-1)
        embed = np.zeros((256, DIM), np.float32)
        np.add.at(embed, bytes_at, spread.reshape(-1, DIM))
        embed[0] = 0
        return {"embed": embed, "conv": conv, "bias": back.sum(axis=0), "out": act.T @ d, "out_bias": d.sum(axis=0)}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        t = 0
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            for a in range(0, len(x), STEP):
                t += 1
                part = order[a : a + STEP]
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= rate * (0.5**epoch) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, per_language: int = PER_LANGUAGE) -> tuple[list[str], Network | None]:
    """Languages and network, learned from about so many texts of each language outside the held-out remainder."""
    learn = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(learned_from("id", modulus) & F.col("lang").isNotNull())
    counts = [(r["lang"], r["count"]) for r in learn.groupBy("lang").count().collect()]
    if not counts:
        return [], None
    languages = sorted(x for x, _ in counts)
    per_language = max(1, min(per_language, TEXTS // len(counts)))
    # By hash of the id: about twice as many as needed, and enough that no language is missed; the driver then cuts to the bound.
    wanted = max(2 * per_language, per_language + 20)
    shares = documents.sparkSession.createDataFrame([(x, min(1.0, wanted / n)) for x, n in counts], "lang string, share double")
    drawn = learn.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    spots = [F.substring(F.encode("text", "UTF-8"), (F.octet_length("text") * (k / WINDOWS)).cast("int") + F.lit(1), F.lit(WINDOW)) for k in range(WINDOWS)]
    rows = drawn.select("lang", F.xxhash64("id").alias("h"), F.array(*spots).alias("windows")).collect()
    by: dict[str, list] = {x: [] for x in languages}
    for r in sorted(rows, key=lambda r: (r.lang, r.h, [bytes(w) for w in r.windows or []])):
        if len(by[r.lang]) < per_language:
            by[r.lang].append([bytes(w) for w in r.windows or [] if w])
    x, y = [], []
    for k, lang in enumerate(languages):
        for texts in by[lang]:
            for w in dict.fromkeys(texts):
                x.append(np.frombuffer(w[:WINDOW].ljust(WINDOW, b"\0"), np.uint8))
                y.append(k)
    network = Network(len(languages))
    if x:
        network.train(LOWER[np.stack(x)], np.array(y))
    return languages, network


def predict(documents: DataFrame, model: tuple[list[str], Network | None], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    head = [id_col, *keep]
    schema = extended(documents.select(*head).schema, lang_pred="string", score="double")
    letter = F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, network = shared.value
        for b in slices(batches, "__bytes", 1 << 20):
            data, offs = buffers(b.column(len(head)))
            mean = np.zeros((b.num_rows, max(1, len(languages))))
            if network is not None:
                x, owner, size = windows_of(data, offs)
                np.add.at(mean, owner, network.predict(x) * size[:, None])
                mean /= np.maximum(1, np.diff(offs))[:, None]
            best = mean.argmax(axis=1)
            known = np.asarray(b.column(len(head) + 1).to_numpy(zero_copy_only=False), bool) & (network is not None)
            names = [languages[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(mean.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(head)], pa.array(names, pa.string()), pa.array(score)], names=[f.name for f in schema])

    return documents.select(*head, text_bytes(text_col).alias("__bytes"), letter.alias("__letter")).mapInArrow(run, schema)
