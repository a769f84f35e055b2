"""Packing against the tokenizer, and the packer by itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shipledger.llm import packing, work
from shipledger.llm.word_cache import FoldedWordEncoder, WholeTextEncoder, encoder_for

FILE = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " \t\n", "a", "Hello, WORLD's it's don't é ς", "<|endoftext|> x<|startoftext|>y", "漢字　テスト 🙂🙂", "a\x1cb \x85 d", "İstanbul ΣΑΣ é ß", "12 3.4 a_b", "word " * 9000, "x" * 20000]


def noise(count):
    rng = random.Random(5)
    letters = "ab'sltdrevm  \n\t\r12.!é漢 　\x1c\x85<|>😀́ÉİΣß_^~@"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(count)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def test_cached_words_encode_as_whole_texts(tokenizer):
    encoder = FoldedWordEncoder(tokenizer, limit=200)
    texts = TEXTS + noise(2000)
    found = [ids for start in range(0, len(texts), 300) for ids in encoder.encode(pa.array(texts[start : start + 300], pa.string()))]
    assert [f.tolist() for f in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_of_a_tokenizer(tokenizer):
    assert isinstance(encoder_for(tokenizer), FoldedWordEncoder)
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole = encoder_for(other)
    assert isinstance(whole, WholeTextEncoder)
    assert [i.tolist() for i in whole.encode(pa.array(["a  b", None]))] == [other.encode("a  b").ids, []]


def packed(lengths, **limits):
    packer = packing.Packer(**limits)
    done = []
    for doc, n in enumerate(lengths):
        done += packer.place([(doc, 0, n, np.arange(n))])
    assert len(packer.windows) <= packer.open_windows
    return packer, done, list(packer.poured())


@pytest.mark.parametrize("lengths", [[], [1], [64], [65, 63], [200], [40, 40, 24, 24], [7] * 100, [random.Random(1).randint(1, 150) for _ in range(500)]])
def test_packer_keeps_every_id(lengths):
    packer, done, last = packed(lengths, size=64, open_windows=3, min_cut=4)
    seen = {doc: [] for doc in range(len(lengths))}
    for parts in done + last:
        for doc, start, total, ids in parts:
            assert total == lengths[doc] and ids[0] == start
            seen[doc] += ids.tolist()
    assert all(sorted(ids) == list(range(lengths[doc])) for doc, ids in seen.items())
    assert all(61 <= packing._length(parts) <= 64 for parts in done)
    short = [n for parts in last if (n := packing._length(parts)) < 64]
    assert all(n & (n - 1) == 0 for n in short) and len(short) <= 6


def test_packer_prefers_the_best_fit():
    packer, done, last = packed([30, 50, 14, 34], size=64, open_windows=3, min_cut=4)
    assert [[p[0] for p in parts] for parts in done] == [[1, 2], [0, 3]] and last == []


def test_limits_are_checked():
    with pytest.raises(ValueError):
        packing.Packer(size=0)


def check(rows, texts, tokenizer, size, min_cut):
    """Everything that the pieces must satisfy."""
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            data = np.array(ids[doc][at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids[doc]), zlib.crc32(data)) and r.length > 0
            at += r.length
        assert at == len(ids[doc])
    odd = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        if at <= size - min_cut:
            odd += 1
            assert at & (at - 1) == 0
    assert odd <= size.bit_length()


def test_packed_documents(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    texts = TEXTS + noise(300)
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id int, text string, ids string, `a.b` int")
    for parts in (1, 7):
        path = work.new_folder(spark, "packed")
        found = packing.pack_documents(docs.repartition(parts), path, FILE, 2, size=256, open_windows=4, min_cut=8)
        assert found.agg({"n_tokens": "sum"}).first()[0] == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
        check(packing.read_pieces(spark, path, FILE).collect(), texts, tokenizer, 256, 8)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    path = work.new_folder(spark, "packed")
    docs = spark.createDataFrame([(1, "one"), (1, "one"), (None, "none"), (2, None)], "doc_id long, text string")
    packing.pack_documents(docs, path, FILE, 2)
    rows = packing.read_pieces(spark, path, FILE).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.doc_tokens) for r in rows if r.start == 0)[:3] == [(False, 1, 0, 2), (False, 1, 0, 2), (False, 2, 0, 1)]
    path = work.new_folder(spark, "packed")
    assert packing.pack_documents(docs.where("false"), path, FILE, 2).count() == 0
    assert packing.read_pieces(spark, path, FILE).count() == 0
