import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import byte_bpe, packing

ODD_TEXTS = ["", " ", "a", "don't  stop\n\n\nnow ", "１２３ ½ ²", "ΑΣ ΣΑΣ İı Straße ﬁ", "é ́x", "\x1c\x1d a\x85b  c​", "<|endoftext|> x <|startoftext|>", "日本語のテキスト", "a" * 5000, " " * 5000 + "x", "x" + "\n" * 3000 + "y", "ab12 " * 3000, "😀" * 2000, "it's we'll I'M"]


def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("aé\n \t'stz9Ω日 .!-<|") for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    return ODD_TEXTS + made


@pytest.mark.parametrize("chunk,overlap", [(32_768, 1024), (64, 16), (50, 3)])
def test_byte_bpe_equals_library(spark, chunk, overlap):
    enc = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS), public_tokenizers.PATTERN)
    rows = [*enumerate(texts()), (None, None), (0, "")]
    got = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk, overlap=overlap)).collect()
    assert len(got) == len(rows)
    want = {i: enc.encode_ordinary(t or "") for i, t in rows}
    for r in got:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want[r["doc_id"]]
        assert bytes(r["decoded"]).decode() == (dict(rows)[r["doc_id"]] or "")


def test_byte_bpe_digests_and_empty(spark, odd, nothing):
    got = byte_bpe.round_trip(odd).where("doc_id = 4").first()
    empty = hashlib.sha256(b"").hexdigest()
    assert (got["n_tokens"], got["ids_sha256"], got["decoded_sha256"]) == (0, empty, empty)
    assert byte_bpe.round_trip(odd).count() == odd.count() and byte_bpe.round_trip(nothing).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(odd, chunk=10, overlap=10)


def test_word_tokenizer_equals_library(documents):
    path = public_tokenizers.path(packing.VOCABULARY)
    plain, own = Tokenizer.from_file(path), packing.WordTokenizer(path, remembered=50)
    for t in [*texts(), *[r["text"] for r in documents.limit(60).collect()]]:
        assert np.frombuffer(own.ids(t), dtype="<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t[:80])


def well_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity
    return len(by)


def test_packing(spark, documents):
    rows = packing.packed(documents).collect()
    plain = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in documents.collect()}
    for r in rows:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(own) == r["length"] and zlib.crc32(np.array(own, dtype="<u4").tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    assert well_packed(rows, 4096) <= -(-sum(map(len, ids.values())) // 4096) + 1


@pytest.mark.parametrize("part_rows", [7, 100_000])
def test_exchange_rounds_stay_near_the_bound(spark, part_rows):
    rng = random.Random(2)
    items = [(i, 0, 0, rng.randrange(1, 100), i) for i in range(400)] + [(500, 0, 0, 100, 5), (500, 1, 100, 100, 6)]
    rows = packing.pack(spark.createDataFrame(items, packing.PIECES), 100, part_rows=part_rows).collect()
    bound = packing.lower_bound(np.array([x[3] for x in items]), np.ones(len(items)), 100)
    assert len(rows) == len(items) and bound <= well_packed(rows, 100) <= bound * (1.1 if part_rows == 7 else 1.03)


def test_lower_bounds_and_best_fit():
    big = np.full(10, 60)
    assert packing.lower_bound(big, np.ones(10), 100) == 10  # the sum alone says 6
    bins, room = packing.best_fit_decreasing(np.array([60, 50, 40, 50]), 100)
    assert len(room) == 2 and sum(room) == 0 and bins[0] == bins[2]


def test_packing_odd_rows(odd, nothing):
    rows = packing.packed(odd).collect()
    assert {(r["doc_id"], r["length"]) for r in rows if r["doc_id"] in (3, 4, 5)} == {(3, 1), (4, 1), (5, 1)}
    assert len([r for r in rows if r["doc_id"] is None]) == 2 and well_packed(rows, 4096) > 0
    assert packing.packed(nothing).count() == 0


@pytest.mark.parametrize("rows,length,capacity", [(150_000, 1, 4096), (20_000, 1, 256), (30_000, 200, 256), (9_000, 86, 256), (20_000, 128, 256)])
def test_exchange_rounds_end_for_equal_lengths(spark, rows, length, capacity):
    """Repeated rows all through: nothing but a row number could tell them apart."""
    cut = spark.range(rows, numPartitions=4).selectExpr("cast(7 as long) doc_id", "0 piece", "0L start", f"{length}L length", "5L ids_crc32")
    got = packing.pack(cut, capacity)
    assert got.count() == rows
    used = got.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert len(used) <= packing.lower_bound(np.array([length]), np.array([rows]), capacity) + 1
    assert all(r["sum(length)"] <= capacity and r["max(offset)"] == r["sum(length)"] - length for r in used)


def test_all_empty_texts_are_packed(spark):
    docs = spark.range(150_000, numPartitions=4).selectExpr("id doc_id", "'' text")
    got = packing.packed(docs).groupBy("sequence_id").agg({"offset": "max", "length": "sum"}).collect()
    assert sum(r["sum(length)"] for r in got) == 150_000 and len(got) <= -(-150_000 // 4096) + 1
    assert all(r["max(offset)"] == r["sum(length)"] - 1 for r in got)


def test_byte_bpe_long_text_without_spaces_is_cut(spark):
    """Several pieces, so several tasks, wherever the pattern ends a pre-token; a pre-token of many chunks stays whole."""
    rng = random.Random(4)
    base64ish = "".join(rng.choice("abcXYZ0189+/") for _ in range(5_000_000))
    chinese = "".join(rng.choice("日本語中文字，。") for _ in range(200_000))
    rows = [(1, base64ish), (2, chinese), (3, "z" * 2500 + "1" * 300 + "y" * 700 + "'ll'l " * 300), (4, "ab'l" * 900)]
    path, small = public_tokenizers.path(byte_bpe.RANKS), {"chunk": 500, "overlap": 40}
    enc = byte_bpe.encoding(path, public_tokenizers.PATTERN)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    big = byte_bpe.encode(df.where("doc_id < 3")).collect()
    for r in [*big, *byte_bpe.encode(df.where("doc_id > 2"), **small).collect()]:
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == enc.encode_ordinary(dict(rows)[r["doc_id"]]), r["doc_id"]
    own = byte_bpe.PieceEncoder(path, public_tokenizers.PATTERN, remembered=20)
    assert all(np.frombuffer(own.ids(t), dtype="<u4").tolist() == enc.encode_ordinary(t) for t in texts())
