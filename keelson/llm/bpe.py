"""Byte-level BPE over many texts with caches of whole chunks.

A chunk runs from one single space between two characters that are not white space up to the
next. The pre-tokenizer always breaks before such a space, so the tokens of a text are those of
its chunks in order. Chunks are looked up by 64-bit hash: first in a broadcast table, then in the
worker's cache; what is new is encoded once, many chunks in one call. Texts with the special string
go through the tokenizer file's own library, which maps it to its id, as it does by default.
"""

from __future__ import annotations

import base64

import numpy as np

from keelson.llm.textvec import U64, segment_hashes

#: Fixed value: the special token of the vocabulary, its string and id.
SPECIAL, SPECIAL_ID = b"<|endoftext|>", 50256
#: Bytes that end or begin white space, or might: beside them no chunk is cut.
_ASCII_WS = np.zeros(256, bool)
_ASCII_WS[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)]] = True
_LEAD = _ASCII_WS.copy()
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
LONGEST_CACHED = 256
MOST_CACHED = 600_000


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of chunks, each text's first place (n+1), and whether a chunk may be joined to others.

    A joinable chunk begins with its space and does not end in white space.
    """
    n = len(data)
    full = np.flatnonzero(np.diff(offs) > 0)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64), none.astype(bool)
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < n - 1)]
    at = at[~_LEAD[data[at + 1]] & ~blank_before(data, at)]
    cut = np.zeros(n, bool)
    cut[at] = True
    # The first space of a text and its last have no character of the text on one side.
    cut[offs[full]] = False
    cut[offs[full + 1] - 1] = False
    spaces = np.flatnonzero(cut)
    cut[offs[full]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    joinable = np.zeros(n, bool)
    joinable[spaces] = True
    ok = joinable[starts]
    last = np.searchsorted(starts, offs[full + 1]) - 1
    ok[last] &= ~(blank_before(data, ends[last]) | _ASCII_WS[data[ends[last] - 1]])
    return starts, ends, np.searchsorted(starts, offs), ok


def blank_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character before each place is white space."""
    one = data[at - 1]
    two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = (three == 0xE2) & ((two == 0x80) | (two == 0x81)) | (three == 0xE3) & (two == 0x80) | (three == 0xE1) & (two == 0x9A)
    return _ASCII_WS[one] | (two == 0xC2) & ((one == 0x85) | (one == 0xA0)) | wide


class Encoder:
    """Ids of byte strings: tiktoken over the same vocabulary, and the tokenizer's own library for special strings."""

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(json_path)
        self.fast = None
        self.length = np.zeros(max(self.own.get_vocab().values()) + 1, np.int64)
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for token, k in ranks.items():
                self.length[k] = len(token)

    def one(self, text: bytes) -> np.ndarray:
        words = text.decode("utf-8", "replace")
        if self.fast is None or SPECIAL in text:
            return np.array(self.own.encode(words, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(words), "<u4")

    def many(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of many joinable chunks, by one call where that is safe."""
        joined = b"".join(texts)
        if self.fast is None or SPECIAL in joined:
            return [self.one(x) for x in texts]
        try:
            ids = np.array(self.fast.encode_ordinary(joined.decode("utf-8")), "<u4")
        except UnicodeDecodeError:
            return [self.one(x) for x in texts]
        stop = np.cumsum(self.length[ids])
        ends = np.cumsum([len(x) for x in texts])
        place = np.searchsorted(stop, ends)
        if not len(stop) or place[-1] >= len(stop) or not (stop[place] == ends).all():
            return [self.one(x) for x in texts]
        return np.split(ids, place[:-1] + 1)


class Ragged:
    """A growing map from hash to a run of ids, in arrays; begun anew when full."""

    def __init__(self, most: int = MOST_CACHED):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.start = np.zeros(0, U64), np.zeros(0, np.int64)
        self.count, self.ids, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, "<u4"), 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places among the entries, -1 where there is none."""
        if not len(self.hashes):
            return np.full(len(h), -1)
        k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[k] == h, k, -1)

    def add(self, h: np.ndarray, runs: list[np.ndarray]) -> None:
        """h: sorted, without those that are there."""
        flat = np.concatenate(runs) if runs else np.zeros(0, "<u4")
        count = np.array([len(x) for x in runs], np.int64)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), "<u4")])
        self.ids[self.used : self.used + len(flat)] = flat
        start = self.used + np.cumsum(count) - count
        self.used += len(flat)
        at = np.searchsorted(self.hashes, h)
        self.hashes = np.insert(self.hashes, at, h)
        self.start, self.count = np.insert(self.start, at, start), np.insert(self.count, at, count)


_workers: dict[tuple, tuple[Encoder, Ragged]] = {}


def worker(paths: tuple[str, str | None, str | None]) -> tuple[Encoder, Ragged]:
    """This worker process's encoder and cache."""
    if paths not in _workers:
        _workers[paths] = Encoder(*paths), Ragged()
    return _workers[paths]


def encode(data: np.ndarray, offs: np.ndarray, paths: tuple, known: np.ndarray | None = None, lengths: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Each text's number of ids, and unless a table of known lengths is given, all ids end to end.

    known, lengths: sorted hashes of frequent chunks and their numbers of tokens; they are looked up first.
    """
    encoder, cache = worker(paths)
    starts, ends, first, ok = chunks(data, offs)
    h = segment_hashes(data, starts, ends)
    distinct, example, inverse = np.unique(h, return_index=True, return_inverse=True)
    count = np.full(len(distinct), -1, np.int64)
    if known is not None and len(known) and len(distinct):
        k = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
        count = np.where(known[k] == distinct, lengths[k], -1)
    need = np.flatnonzero(count < 0)
    place = cache.find(distinct[need])
    missing = need[place < 0]
    if len(cache.hashes) + len(missing) > cache.most:
        cache.clear()
        missing = need
    raw = data.tobytes() if len(missing) else b""
    size = ends - starts
    join = ok[example[missing]]
    short = join & (size[example[missing]] <= LONGEST_CACHED)
    texts = lambda which: [raw[a:b] for a, b in zip(starts[example[which]], ends[example[which]], strict=True)]
    new = missing[short]
    cache.add(distinct[new], encoder.many(texts(new)) if len(new) else [])
    alone = missing[~short]
    runs = [encoder.one(x) for x in texts(alone)]
    place = cache.find(distinct[need])
    found = place >= 0
    count[need[found]] = cache.count[place[found]]
    count[alone] = [len(x) for x in runs]
    per_chunk = count[inverse]
    total = np.concatenate([[0], np.cumsum(per_chunk)])
    sizes = total[first[1:]] - total[first[:-1]]
    if lengths is not None:
        return sizes, None
    pool = np.concatenate([cache.ids[: cache.used], *runs]) if runs else cache.ids
    begin = np.zeros(len(distinct), np.int64)
    begin[need[found]] = cache.start[place[found]]
    begin[alone] = cache.used + np.cumsum([0, *(len(x) for x in runs)])[:-1] if len(alone) else 0
    source = np.repeat(begin[inverse] - total[:-1], per_chunk) + np.arange(total[-1])
    return sizes, pool[source]
