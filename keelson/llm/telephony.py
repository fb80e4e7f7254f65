"""Telephony audio columns: mu-law, A-law and block ADPCM in WAV containers, decoded to resampled PCM.

G.711 bytes expand through 256-entry tables. ADPCM blocks are independent, so numpy decodes all
blocks of a batch in step: one pass a nibble, over every block. Containers are parsed from their
bytes, whatever chunks they hold. All steps are maps over rows, without a shuffle.

Nulls: a null text is an empty one; a null container gives null PCM. A container that can't be
parsed gives null PCM and its fault in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import extended, Tables, text_bytes
from keelson.llm.textvec import buffers, slices

UNIT = 192
RATE = 8000
#: Format tags of WAV containers.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 0x11}
#: IMA ADPCM's step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX_CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    level = (((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)
    return np.where(u & 0x80, 0x84 - level, level - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment = (a & 0x70) >> 4
    level = ((a & 0x0F) << 4) + np.where(segment == 0, 8, 0x108)
    level = level << np.maximum(segment - 1, 0)
    return np.where(a & 0x80, level, -level).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """The change of the sample and the next index, by index * 16 + nibble."""
    step, code = STEPS[:, None], np.arange(16)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(89)[:, None] + INDEX_CHANGES[code & 7], 0, 88)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (after * 16).astype(np.int32).ravel()


ADPCM_CHANGE, ADPCM_NEXT = _adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (one in a row: 2 bytes sample, index, one byte, then nibbles, low first)."""
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    sample = (blocks[:, 0].astype(np.uint16) | (blocks[:, 1].astype(np.uint16) << 8)).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = sample
    columns = np.ascontiguousarray(blocks.T)
    row = 1
    for k in range(4, width):
        for code in (columns[k] & 15, columns[k] >> 4):
            at = index + code
            sample += ADPCM_CHANGE[at]
            np.clip(sample, -32768, 32767, out=sample)
            index = ADPCM_NEXT[at]
            out[row] = sample
            row += 1
    return out.T


def decode(codec: str, data: np.ndarray, block: int = UNIT) -> np.ndarray:
    """Linear samples of one stream; what is left of an ADPCM block is not decoded."""
    if codec == "adpcm":
        return decode_adpcm(data[: len(data) // block * block].reshape(-1, block)).ravel()
    return (MULAW if codec == "mulaw" else ALAW)[data]


def resample(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Twice the rate: between two samples the four-point filter (-1, 9, 9, -1) / 16.

    before (1) and after (2): the samples around x, so that a long stream can go piece by piece.
    """
    y = np.concatenate([before, x, after]).astype(np.int32)
    between = (9 * (y[1:-2] + y[2:-1]) - y[:-3] - y[3:] + 8) >> 4
    out = np.empty(2 * len(x), "<i2")
    out[0::2] = x
    out[1::2] = np.clip(between, -32768, 32767)
    return out


def pieces(x: np.ndarray, most: int = 1 << 19) -> Iterator[np.ndarray]:
    """The resampled stream, so many samples at a time; beyond its ends the edge samples repeat."""
    for a in range(0, len(x), most):
        b = min(len(x), a + most)
        yield resample(x[a:b], x[[max(a - 1, 0)]], x[np.minimum([b, b + 1], len(x) - 1)])


def wav(codec: str, data: bytes, rate: int = RATE, block: int = UNIT) -> bytes:
    """A mono WAV container; data goes in as it is."""
    adpcm = codec == "adpcm"
    per = 2 * (block - 4) + 1 if adpcm else 1
    extra = struct.pack("<H", per) if adpcm else b""
    samples = len(data) // block * per if adpcm else len(data)
    form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate * block // per if adpcm else rate, block if adpcm else 1, 4 if adpcm else 8, len(extra)) + extra
    body = b"".join([b"WAVEfmt ", struct.pack("<I", len(form)), form, b"fact", struct.pack("<II", 4, samples), b"data", struct.pack("<I", len(data)), data, b"\0" * (len(data) % 2)])
    return b"".join([b"RIFF", struct.pack("<I", len(body)), body])


def parse(media: bytes | memoryview) -> tuple[str, int, int, memoryview]:
    """Codec, rate, block length and stream of a container; ValueError if it isn't one."""
    view = memoryview(media)
    if len(view) < 12 or view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, form = 12, None
    while at + 8 <= len(view):
        (n,) = struct.unpack_from("<I", view, at + 4)
        if view[at : at + 4] == b"fmt " and n >= 16:
            form = struct.unpack_from("<HHIIHH", view, at + 8)
        elif view[at : at + 4] == b"data":
            codec = {v: k for k, v in TAGS.items()}.get(form[0]) if form else None
            if codec is None or form[1] != 1 or at + 8 + n > len(view) or codec == "adpcm" and form[4] < 5:
                raise ValueError("stream of another kind, or cut short")
            return codec, form[2], form[4], view[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no stream")


def pad(text: bytes, unit: int = UNIT) -> bytes:
    """Spaces appended up to a positive multiple of the unit."""
    return text + b" " * (max(unit, -(-len(text) // unit) * unit) - len(text))


def store(df: DataFrame, id_col: str = "doc_id", bytes_col: str = "text", codec: str = "mulaw") -> DataFrame:
    """(id, n_bytes, media): each value's bytes, padded to whole units, as the stream of a WAV container.

    Lossless: the stream's bytes are the payload's. Null: empty. One row out for each row in.
    """
    schema = extended(df.select(F.col(id_col)).schema, n_bytes="bigint", media="binary")

    def to_media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__bytes"):
            raw = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([wav(codec, pad(x)) for x in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    return df.select(F.col(id_col), text_bytes(bytes_col).alias("__bytes")).mapInArrow(to_media, schema)


def to_pcm(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, rate, pcm, error): each container's samples at twice its rate, as little-endian 16-bit PCM."""
    schema = extended(df.select(F.col(id_col)).schema, rate="int", pcm="binary", error="string")

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__media", 1 << 20):
            out = []
            for x in b.column(1).to_pylist():
                try:
                    if x is None:
                        out.append((None, None, None))
                        continue
                    codec, rate, block, data = parse(x)
                    pcm = decode(codec, np.frombuffer(data, np.uint8), block)
                    out.append((2 * rate, b"".join(p.tobytes() for p in pieces(pcm)), None))
                except ValueError as fault:
                    out.append((None, None, str(fault)))
            rate, pcm, error = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rate, pa.int32()), pa.array(pcm, pa.binary()), pa.array(error, pa.string())], names=[id_col, "rate", "pcm", "error"])

    return df.select(F.col(id_col), F.col(media_col).cast("binary").alias("__media")).mapInArrow(expand, schema)


def row_powers(rows: np.ndarray) -> np.ndarray:
    """For each unit of payload bytes: the sums of squares as mu-law, as A-law and as an ADPCM block, and the ADPCM peak."""
    out = np.empty((len(rows), 4), np.int64)
    square = lambda table: (table.astype(np.int64) ** 2).astype(np.float32)
    mulaw, alaw = square(MULAW), square(ALAW)
    for a in range(0, len(rows), 4096):
        part = rows[a : a + 4096]
        pcm = decode_adpcm(part).astype(np.float32)
        out[a : a + 4096, 0] = mulaw[part].sum(axis=1, dtype=np.float64)
        out[a : a + 4096, 1] = alaw[part].sum(axis=1, dtype=np.float64)
        out[a : a + 4096, 2] = np.einsum("ij,ij->i", pcm, pcm, dtype=np.float64)
        out[a : a + 4096, 3] = np.abs(pcm).max(axis=1)
    return out


def measured(media: bytes | memoryview, levels: np.ndarray, codec: str, block: int, stream: memoryview) -> tuple:
    """One container's digests and feature; levels: what row_powers gives of its whole units."""
    x = np.frombuffer(stream, np.uint8)
    n, whole = len(x), len(x) // UNIT
    rest = x[whole * UNIT :]
    sums = levels[:, :3].sum(axis=0) + [(MULAW[rest].astype(float) ** 2).sum(), (ALAW[rest].astype(float) ** 2).sum(), 0]
    level = [int((s / max(1, d)) ** 0.5) for s, d in zip(sums, (n, n, whole * (2 * UNIT - 7)), strict=True)]
    peak = int(levels[:, 3].max(initial=0))
    sign = np.signbit(MULAW[x])
    pcm, crc = decode(codec, x, block), 0
    for p in pieces(pcm):
        crc = zlib.crc32(p, crc)
    feature = f"mulaw={level[0]};alaw={level[1]};adpcm={level[2]};peak={peak};turns={int(np.count_nonzero(sign[1:] != sign[:-1]))};pcm={2 * len(pcm)}:{crc:08x}"
    return n, hashlib.sha256(stream).hexdigest(), zlib.crc32(stream[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, None


def features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """Digests and features of stored containers; a null container gives nulls, one that can't be parsed gives its fault in `error`.

    (id, *keep, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, error). The
    feature has the effective levels of the stream as mu-law, A-law and ADPCM, the ADPCM peak, the
    sign changes of the mu-law samples, and the length and CRC-32 of the container's PCM at twice the rate.
    What is left of an ADPCM block doesn't count there.
    """
    head = [id_col, *keep]
    schema = extended(df.select(*head).schema, payload_bytes="bigint", payload_sha256="string", tail_crc32="bigint", media_bytes="bigint", media_sha256="string", feature="string", error="string")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__media", 2 << 20):
            out, parsed = [(None,) * 7] * b.num_rows, []
            for k, x in enumerate(b.column(len(head))):
                if x.is_valid:
                    try:
                        media = memoryview(x.as_buffer())
                        codec, _, block, stream = parse(media)
                        parsed.append((k, media, codec, block, stream))
                    except ValueError as fault:
                        out[k] = (None,) * 6 + (str(fault),)
            units = [len(x[4]) // UNIT for x in parsed]
            power = row_powers(np.frombuffer(b"".join(x[4][: u * UNIT] for x, u in zip(parsed, units, strict=True)), np.uint8).reshape(-1, UNIT))
            place = np.concatenate([[0], np.cumsum(units)]).astype(np.int64)
            for (k, media, codec, block, stream), a, z in zip(parsed, place[:-1], place[1:], strict=True):
                out[k] = measured(media, power[a:z], codec, block, stream)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(head)], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=[f.name for f in schema])

    return df.select(*head, F.col(media_col).cast("binary").alias("__media")).mapInArrow(measure, schema)


def store_pcm(df: DataFrame, tables: Tables, id_col: str = "doc_id", media_col: str = "media", name: str = "pcm") -> DataFrame:
    """to_pcm()'s rows as a table in the shared folder, read back."""
    return tables.keep(to_pcm(df, id_col, media_col), name)
