"""Huffman coding and token output: round trips and optimality."""

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm import token_output
from hearth.llm.common import stored
from hearth.llm.huffman import Coder, canonical_codes, code_lengths
from hearth.llm.queries import QUERIES, tokenizer_path
from hearth.session import scratch_path
from tests.llm.util import docs, sample_docs, tables_dir


@lru_cache
def whole():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


def whole_ids(texts):
    t = whole()
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for x in texts]


def huffman_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 10**6), min_size=2, max_size=60))
def test_lengths(counts):
    counts = np.array(counts)
    n = int((counts > 0).sum())
    free = code_lengths(counts, 60)
    if n > 1:
        assert (free * counts).sum() == huffman_cost(counts)
    for limit in (1, 6, 8):
        lengths = code_lengths(counts, limit)
        assert lengths.max(initial=0) <= max(limit, 6)
        assert ((lengths > 0) == (counts > 0)).all()
        assert n < 2 or sum(2.0 ** -x for x in lengths[lengths > 0]) == 1
        codes = [format(int(c), f"0{m}b") for c, m in zip(canonical_codes(lengths), lengths) if m]
        assert not any(b.startswith(a) for a, b in zip(sorted(codes), sorted(codes)[1:]))


def test_length_limit_is_optimal_on_a_known_case():
    assert sorted(code_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21]), 4).tolist()) == [2, 2, 3, 3, 4, 4, 4, 4] or \
        (code_lengths(np.array([1, 1, 2, 3, 5, 8, 13, 21]), 4) * [1, 1, 2, 3, 5, 8, 13, 21]).sum() == 141


@settings(deadline=None, max_examples=40)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=300), min_size=1, max_size=6))
def test_round_trip(texts):
    coder = Coder(code_lengths(np.bincount(np.concatenate(texts)), 7))
    counts = np.array([len(t) for t in texts])
    bits, size, deltas, marks = coder.encode(np.concatenate(texts), counts, every=16)
    assert size.sum() == len(bits) and marks.tolist() == [-(-len(t) // 16) for t in texts]
    offsets, sizes = token_output.segments(counts, deltas, every=16)
    assert coder.decode(bits.tobytes(), offsets, sizes).tolist() == sum(texts, [])


def test_pieces_give_the_same_ids():
    texts = ["", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "x  y", "don't stop  now", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|>b c",
             "tab\there\n\nnew line", "café \U0001f600 ok", "!!! ??? ...", "12 345 6a7", "  z", "q\x1c r", "one two three " * 50 + "end"]
    encoder = token_output.Encoder(tokenizer_path())
    assert encoder.in_parts
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in whole_ids(texts)]


def thue_morse(n, a="a", b="b"):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.mark.parametrize("letters", [1024, 2048, 8192])
def test_parts_that_collide_in_polynomial_hashes(letters):
    """Two strings whose difference vanishes under every odd base modulo 2^64, alone and inside a text."""
    texts = [thue_morse(letters), thue_morse(letters, "b", "a"), f"x {thue_morse(letters)} y", f"x {thue_morse(letters, 'b', 'a')} y"]
    encoder = token_output.Encoder(tokenizer_path())
    for t in ([x] for x in texts):
        assert [x.tolist() for x in encoder.encode(t)] == [x[:-1].tolist() for x in whole_ids(t)]
    assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in whole_ids(texts)]


@pytest.mark.parametrize("low", [0, 3, 0xFF])
def test_equal_mixes_never_give_wrong_ids(monkeypatch, low):
    """Parts that are looked up under the same number are told apart by their bytes."""
    mix = token_output.Encoder._mix
    monkeypatch.setattr(token_output.Encoder, "_mix", staticmethod(lambda names: mix(names) & np.uint64(low)))
    monkeypatch.setattr(token_output, "MAX_LONG", 3)
    texts = ["one two three. four", "two one", "one", "a" * 33 + " " + "b" * 40, "c" * 5000 + ". " + "a" * 33, "nul\x00 nul", "nul nul", "d" * 32 + " " + "d" * 33, ""]
    encoder = token_output.Encoder(tokenizer_path())
    for _ in range(3):
        assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in whole_ids(texts)]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "\x00", "\u00e9", " ", ".", "7"]), min_size=25, max_size=45).map("".join), min_size=2, max_size=4))
def test_parts_about_the_longest_compared(texts):
    encoder = token_output.encoder_of(tokenizer_path())
    assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in whole_ids(texts)]


def check(rows, got, with_ids=False):
    """Ids and offsets of all documents, in key order, nulls first."""
    ids = whole_ids([r.text for r in rows])
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len(x), zlib.crc32(x.tobytes())) for r, x in zip(rows, ids))
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [(r.doc_id is not None, r.doc_id or 0) for r in ordered] == [w[0] for w in want]
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
        if with_ids:
            assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32


def test_query_round_trip(spark, tmp_path):
    df = sample_docs(spark).repartition(5)
    got = QUERIES["op4_huffman_tokens"](spark, tables_dir(tmp_path, spark, documents=df))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    check(df.collect(), got.collect())


@settings(deadline=None, max_examples=300)
@given(st.lists(st.text(alphabet="ab .,\n'!9\t\u00e9\u0301\u00a0|", max_size=30), min_size=1, max_size=4))
def test_pieces_of_any_text(texts):
    encoder = token_output.encoder_of(tokenizer_path())
    assert [x.tolist() for x in encoder.encode(texts)] == [x[:-1].tolist() for x in whole_ids(texts)]


@pytest.mark.parametrize("block_ids", [1, 500, 1 << 18])
def test_blocks_and_hot_keys(spark, block_ids):
    df = docs(spark, [(7, "hot key text")] * 200 + [(i, f"text number {i} " * (i % 40)) for i in range(200)] + [(None, "x"), (None, None)]).repartition(4)
    tokens = stored(token_output.tokenize(df, tokenizer_path()), "t")
    path = scratch_path(spark, "blocks")
    token_output.write_blocks(tokens, path, block_ids=block_ids)
    check(df.collect(), token_output.read_tokens(spark, path, with_ids=True).collect(), True)
    sizes = spark.read.parquet(f"{path}/blocks")
    assert block_ids > 1 or sizes.count() == 402
    per_range = [r["count"] for r in sizes.selectExpr("range", "explode(keys)").groupBy("range").count().collect()]
    assert max(per_range) < 150  # half of all rows have one key


def test_empty_table(spark):
    assert token_output.token_output(docs(spark, []), tokenizer_path()).count() == 0
    assert token_output.token_output(docs(spark, [(1, None)]), tokenizer_path()).first().n_tokens == 1
