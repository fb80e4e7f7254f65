import itertools
import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import bpe, textvec
from keelson.llm.queries import tokenizer_paths

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a\n b", " \na", "x  y", "x  y", "é à ß", "<|endoftext|>", "a <|endoftext|> b", "it's  'll we'll ", "\t\t a\x1c b", "日本語 テキスト", "a" * 3000, "A   b   c\n\n\n d", "　 x", "a  b  c", "🙂 🙂", " 12 34!! ..."]


def column(texts):
    return pa.array([x.encode() for x in texts], pa.binary())


@pytest.fixture(scope="module")
def own():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_paths()[0])


def encoded(texts):
    sizes, ids = bpe.encode(*textvec.buffers(column(texts)), tokenizer_paths())
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_ids_are_the_librarys(own):
    assert encoded(ODD + ODD) == [own.encode(x, add_special_tokens=False).ids for x in ODD + ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é  \n\t\x1c'!9<|>🙂s"), max_size=30), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    from tokenizers import Tokenizer

    global _own
    _own = globals().get("_own") or Tokenizer.from_file(tokenizer_paths()[0])
    assert encoded(texts) == [_own.encode(x, add_special_tokens=False).ids for x in texts]


def test_cache_that_fills_up(own):
    encoder, _ = bpe.worker(tokenizer_paths())
    bpe._workers[tokenizer_paths()] = encoder, bpe.Ragged(most=5)
    try:
        assert encoded(ODD * 2) == [own.encode(x, add_special_tokens=False).ids for x in ODD * 2]
    finally:
        bpe._workers.clear()


@given(st.lists(st.text(st.sampled_from("aB \t\n\x0b\x1c é"), max_size=20), max_size=5))
def test_words(texts):
    data, offs = textvec.buffers(column(texts))
    starts, ends, first = textvec.words(data, offs)
    got = [[bytes(data[a:b]) for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert got == [x.encode().split() for x in texts]


def test_hashes_depend_on_the_bytes_alone():
    texts = ["one two Three", "two", "three ONE two", "x" * 500 + " two"]
    data, offs = textvec.buffers(column(texts))
    whole, first = textvec.word_hashes(data, offs)
    assert whole[0] == whole[5] and whole[1] == whole[3] == whole[6] == whole[8] and whole[2] == whole[4]
    plain, _ = textvec.word_hashes(data, offs, lower=False)
    assert plain[0] != plain[5]


def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for one, if they are long enough."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 64, 1024, 2048, 4096])
def test_no_collision_of_regular_words(own, n):
    pair = thue_morse(n)
    data, offs = textvec.buffers(column(pair))
    hashes, _ = textvec.word_hashes(data, offs)
    assert hashes[0] != hashes[1]
    assert encoded(pair) == [own.encode(x, add_special_tokens=False).ids for x in pair]


def test_distinct_words_have_distinct_hashes():
    every = ["".join(x) for k in range(1, 10) for x in itertools.product("ab\0é" if k < 7 else "ab", repeat=k)]
    every += ["a" * k for k in range(10, 200)]
    hashes, _ = textvec.word_hashes(*textvec.buffers(column(every)))
    assert len(set(hashes.tolist())) == len(hashes) == len(set(every))


def test_buffers_with_nulls_and_slices():
    a = pa.array([b"x", None, b"yz", b""], pa.binary())
    data, offs = textvec.buffers(a.slice(1))
    assert bytes(data) == b"yz" and offs.tolist() == [0, 0, 2, 2]
    parts = list(textvec.slices(iter([pa.RecordBatch.from_arrays([a], ["t"])]), "t", 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == a.to_pylist() and len(parts) > 1
