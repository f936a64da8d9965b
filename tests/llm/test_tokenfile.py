"""Token files: exact round trips of the coder and of whole tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chatloom.llm import rangecoder, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    blocks = [rng.integers(0, 50257, n) for n in (1, 0, 5, 63, 64, 65, 129, 4096)]
    blocks += [rng.zipf(1.3, 3000) % 5000, np.zeros(1000, int), np.tile(rng.integers(0, 100, 17), 100)]
    for wide in ([], [rng.integers(0, 1 << 32, 300), np.array([(1 << 32) - 1])]):
        coded = rangecoder.encode_blocks(blocks + wide)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks + wide, rangecoder.decode_blocks(coded), strict=True))
    assert len(coded[9]) < 60 and len(coded[10]) < 200


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.4, 2000) % 900 for _ in range(5)]
    together = rangecoder.encode_blocks(blocks)
    assert together == [rangecoder.encode_blocks([b])[0] for b in blocks]
    broken = bytearray(together[2])
    broken[100] ^= 1
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        rangecoder.decode_blocks([b"xxxx" + together[0][4:]])


@pytest.mark.parametrize("block", [4096, 50])
def test_files(spark, docs_frame, hard_docs, no_docs, tmp_path, monkeypatch, block):
    monkeypatch.setattr(tokenfile, "BLOCK", block)
    tokenfile.write_token_files(docs_frame, f"{tmp_path}/a", PATH)
    plain = Tokenizer.from_file(PATH)
    want, at = {}, 0
    for i, t in sorted(hard_docs, key=lambda x: x[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want[i] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.file_digests(spark, f"{tmp_path}/a").collect()} == want
    segments = tokenfile.read_token_files(spark, f"{tmp_path}/a").filter("key = 16").orderBy("start").collect()
    whole = b"".join(bytes(s.ids) for s in segments)
    assert zlib.crc32(whole) == want[16][2]
    tokenfile.write_token_files(no_docs, f"{tmp_path}/b", PATH)
    assert tokenfile.file_digests(spark, f"{tmp_path}/b").count() == 0


def test_null_and_equal_ids(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (4, "b c"), (4, "b c"), (9, None)], "doc_id long, text string")
    tokenfile.write_token_files(docs, f"{tmp_path}/c", PATH)
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.file_digests(spark, f"{tmp_path}/c").collect())
    assert rows == [(0, None, 2), (2, 4, 3), (5, 4, 3), (8, 9, 1)]


def test_quotients_of_intervals_are_exact_and_payloads_stay():
    import zlib

    import numpy as np

    from chatloom.llm import rangecoder as R

    rng = np.random.default_rng(4)
    b = rng.integers(1, 1 << 14, 100_000).astype(np.uint64)
    q = rng.integers(1, 1 << 34, 100_000).astype(np.uint64)
    for a in (q * b - np.uint64(1), q * b, np.full(len(b), (1 << 48) - 1, np.uint64)):
        assert (R._divide(a, b) == a // b).all()
    blocks = [np.arange(5000) * 7 % m for m in (3, 97, 4001, 70_000)] + [np.array([2])]
    coded = R.encode_blocks([x[:4096].astype("<u4") for x in blocks])
    assert zlib.crc32(b"".join(coded)) == 2809810574
    assert all((x[:4096] == y).all() for x, y in zip(blocks, R.decode_blocks(coded)))
