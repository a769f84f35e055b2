"""Token store, Elias-Fano code and BPE against whole encodings."""

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from shipledger.llm import bpe, token_store, work
from shipledger.llm.elias_fano import EliasFano, build
from shipledger.llm.word_cache import SpacedWordEncoder, encoder_for

TEXTS = [None, "", "<|endoftext|> hello <|endoftext|>", "x<|endoftext|>y  <|endoftext|>\n", "a", "  two  spaces ", "line\n\nline\r\n\tx", "it's we'll THEY'RE '' '", "漢字　テスト 🙂🙂", "<|endoftext|> x", "a\x1cb \x1d c", "0 12 3.4", " \n", "word " * 3000, "x" * 20000, "é" * 5000 + " " * 300]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def noise(count):
    rng = random.Random(3)
    letters = "ab'sltdrevm  \n\t\r12.!é漢 　\x1c\x85<|>😀"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(count)]


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5], [0, 1, 2, 3], [0, 10, 10, 1000000], list(range(0, 5000, 7))])
def test_elias_fano(values):
    code = EliasFano(len(values), *build(np.array(values, dtype=np.int64)))
    assert code.all().tolist() == values
    assert [code.select(i) for i in range(len(values))] == values
    assert code.select_many(np.arange(len(values))).tolist() == values
    assert code.select_many(np.arange(len(values))[::-3]).tolist() == values[::-3]
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10000))
    width, low, high, samples = build(values)
    assert len(low) + len(high) + len(samples) < 10000 * (np.log2(values[-1] / 10000) + 3) / 8


def test_cached_words_encode_as_whole_texts(tokenizer):
    encoder = encoder_for(tokenizer)
    assert isinstance(encoder, SpacedWordEncoder)
    encoder.limit = encoder.words.limit = 200
    rng = random.Random(8)
    special = ["".join(rng.choice(["a", " ", "\n", "<|endoftext|>", "b,", "<|"]) for _ in range(9)) for _ in range(500)]
    texts = TEXTS + noise(2000) + special
    whole = pa.array(texts, pa.string())
    found = [ids for start in range(0, len(texts), 300) for ids in encoder.encode(whole.slice(start, 300))]
    assert [f.tolist() for f in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_store_round_trip(spark, tokenizer):
    rows = [(100 - i, t, "clash") for i, t in enumerate(TEXTS)] + [(7, "seven", "x"), (7, "seven", "x"), (None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = work.new_folder(spark, "store")
    token_store.write_token_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2, block_tokens=500, block_docs=4)
    found = token_store.read_token_store(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d or 0))
    by_id = {d: t for d, t, _ in rows}
    start = 0
    for r in found:
        ids = [*tokenizer.encode(by_id[r.doc_id] or "", add_special_tokens=False).ids, 2]
        data = np.array(ids, dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, bytes(r.ids)) == (start, len(ids), data)
        assert r.ids_crc32 == zlib.crc32(data)
        start += len(ids)
    blocks = spark.read.parquet(f"{path}/blocks").collect()
    for b in blocks:
        assert token_store.boundary(b, len(b.doc_ids)) == b.n_tokens and token_store.boundary(b, 0) == 0


def test_empty_store(spark):
    path = work.new_folder(spark, "store")
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_token_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_store.read_token_store(spark, path).count() == 0


def test_tree_encodes_as_the_whole(ranks):
    whole = tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for leaf, window in ((1, 1), (5, 2), (64, 8)):
        tree = bpe.TreeCoder(ranks, public_tokenizers.PATTERN, leaf, window)
        for text in [t for t in TEXTS if t and len(t) < 6000] + noise(300):
            ids = tree.encode(text)
            assert ids == whole.encode_ordinary(text)
            assert tree.decode(ids) == text.encode()


def test_bpe_frames(spark, ranks):
    docs = spark.createDataFrame(list(enumerate(TEXTS)) + [(0, None)], "doc_id long, text string").selectExpr("doc_id", "text", "'old' AS ids", "1 AS decoded")
    coded = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids", "decoded"]
    rows = coded.collect()
    assert len(rows) == len(TEXTS) + 1
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in rows)
    assert bpe.encode(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
