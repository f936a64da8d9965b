"""Packing: ids against the tokenizer itself, places against the capacity, combinations against brute force."""

import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatloom.llm import packing
from chatloom.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(hard_docs, name):
    path = public_tokenizers.path(name)
    texts = [t for _, t in hard_docs] + ["a  b", " a", "b ", "x\n\n\ny \n z", "it's we'll ' s", "<|endoftext|> a<|startoftext|>", "<|endoftext|>", "in<|endoftext|>side  <|endoftext|>  x", "<|ENDOFTEXT|>", "q\x1cz \x0b e", "é é", "a b 　c", "n\0m o"]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(b, "<u4").tolist() for b in Encoder(path).encode(texts)]
    assert got == want


def test_pieces_and_places(docs_frame, hard_docs):
    rows = packing.placed_digests(docs_frame, PATH).collect()
    plain = Tokenizer.from_file(PATH)
    want = {}
    for i, t in hard_docs:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            want[i, n] = (at, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1


def test_fullest_is_best_sum():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, 40, 6).tolist()
        counts = {n: lengths.count(n) for n in lengths}
        room = int(rng.integers(1, 90))
        use = packing.fullest(room, dict(counts), sorted(counts, reverse=True))
        best = max(sum(c) for k in range(7) for c in itertools.combinations(lengths, k) if sum(c) <= room)
        assert sum(n * k for n, k in use.items()) == best
        assert all(k <= counts[n] for n, k in use.items())


def test_many_equal_lengths_and_empty(spark, no_docs):
    fills = packing.fill_bins({3000: 5, 1096: 1_000_000, 7: 3})
    used = {}
    for f in fills:
        assert sum(n * k for n, k in f.use.items()) <= 4096
        for n, k in f.use.items():
            used[n] = used.get(n, 0) + k * f.bins
    assert used == {3000: 5, 1096: 1_000_000, 7: 3}
    assert packing.placed_digests(no_docs, PATH).count() == 0


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d"), (2, None)], "doc_id long, text string")
    rows = packing.pack(docs, PATH).collect()
    assert len(rows) == 1
    ids = np.frombuffer(bytes(rows[0].ids), "<u4").tolist()
    plain = Tokenizer.from_file(PATH)
    assert sorted(ids) == sorted([*plain.encode("a b c").ids * 2, *plain.encode("d").ids, 1, 1, 1, 1])
    assert len(rows[0].parts) == 4
