"""Personal data, the quality classifier and the pipeline."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from shipledger.llm import bpe, pii, quality
from tests.llm.test_lines_shards import brute as brute_lines
from tests.llm.test_pairs import brute_components

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def noise(count):
    rng = random.Random(7)
    parts = ["a@b.c", "a@b", "@", "x_y%z@h-1.co.uk", "a@b.c_d@e.f", "1.2.3.4", "001.2.3.255", "1.2.3.256", "1.2.3.4.5", "10.0.0.1",
             "4111111111111111", "4111 1111-1111 1111", "4111  1111", "378282246310005", "+1 (555) 010-9999", "+12", "++49.30.1234567", "+1234567890123456",
             "é", "漢", " ", "\n", "-", ".", "+", "7", "word", "🙂"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ","]) for _ in range(rng.randint(0, 12))) for _ in range(count)]


def test_base_spans(spark):
    texts = [None, "", *noise(1500), "a." * 20000 + "@" + "b." * 20000 + "c", "1" * 50000, "+" * 30000, "1.2.3.4 " * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS base0", "2 AS email")
    for r in pii.base_spans(df).select("doc_id", "text", "base").collect():
        assert [(s.start, s.rank, s.kind, s.end) for s in r.base] == brute_spans(r.text), r.text[:200]
        assert all((r.text or "")[s.start : s.end] == s.value for s in r.base)


def test_revealing_terms(spark):
    docs = [(i, f"ordinary words about the weather number {i}\nanother ordinary line {i * 7}") for i in range(40)]
    docs += [(100 + i, f"ordinary note {i}\nask Nightjar the boss@corp.example about weather {i}") for i in range(3)]
    docs += [(200, docs[-1][1]), (201, None), (None, "boss@corp.example and Nightjar once more"), (202, "ordinary Nightjar words without the address")]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS added", "'t' AS terms")
    rows = pii.find_personal_data(df).join(df.select("doc_id", "text"), "doc_id").withColumn("clean", pii.sanitised("text", "base", "added")).collect()
    assert len(rows) == 46
    by_id = {r.doc_id: r for r in rows}
    for d in (100, 101, 102, 200):
        r = by_id[d]
        found = {r.text[s.start : s.end].lower() for s in r.added}
        assert "nightjar" in found and not found & {"weather", "the", "about"}
        assert "Nightjar" not in r.clean and "[EMAIL]" in r.clean and "weather" in r.clean
    assert not by_id[202].added and by_id[202].clean == by_id[202].text
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_revealing_terms_in_all_lines(spark):
    docs = [(i, f"ordinary words about the weather number {i}\nanother ordinary line {i * 7}") for i in range(200)]
    docs += [(300 + i, f"ask Nightjar the boss@corp.example {i}\nordinary line\nordinary end\nNightjar again, ordinary weather") for i in range(3)]
    docs += [(400 + i, f"another ordinary number {i * 3}\nordinary weather\nOakwood Tern\nchief@corp.example\nanother line") for i in range(3)]
    docs += [(500 + i, f"ordinary words {i}\nOakwood\nmail chief@corp.example {i}") for i in range(2)]
    docs += [(600, "Nightjar ordinary"), (601, "copied Plover\ncopy@corp.example"), (602, "copied Plover\ncopy@corp.example")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    text = dict(docs)
    for doc in (300, 301, 302):
        at = [s.start for s in found[doc].added if s.value == "Nightjar"]
        assert at == [m.start() for m in re.finditer("Nightjar", text[doc])] and len(at) == 2
        assert not {s.value for s in found[doc].added} & {"ordinary", "weather"}
    for doc in (400, 401, 402, 500, 501):
        assert "Oakwood" in {s.value for s in found[doc].added} and all(text[doc][s.start : s.end] == s.value for s in found[doc].added)
        assert not {s.value for s in found[doc].added} & {"ordinary", "weather"}
    assert not found[600].added and not found[601].added


def labelled(count, seed):
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfgl')}{rng.choice('aeiou')}{rng.choice('mnrst')}{rng.choice('aeiou')}{i}" for i in range(800)]
    words = [re.sub(r"\d", "", w) for w in words]
    docs, labels = [], []
    for doc in range(count):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        kind = rng.random()
        if kind < 0.15:
            text[rng.randrange(len(text))] = rng.choice(["vilescum", "dolt"])
            labels.append((doc, 1, 1))
        elif kind < 0.35:
            text = [w.upper() + "!!" for w in text] if kind < 0.25 else [text[0]] * len(text)
            labels.append((doc, 0, 0))
        else:
            labels.append((doc, 1, 0))
        docs.append((doc, " ".join(text), "x"))
    return docs, labels


def test_quality(spark):
    docs, labels = labelled(1600, 3)
    df = spark.createDataFrame(docs + [(None, None, None), (5000, "", "x")], "doc_id long, text string, expected_grade string")
    train = spark.createDataFrame(labels[:1200] + [(None, 1, 0), (3, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    model = quality.fit(df, train)
    assert model.thresholds[0] < model.thresholds[1]
    scored = {r.doc_id: r for r in quality.score(df, model).collect()}
    assert len(scored) == 1602
    right = sum((scored[d].tail_probability >= 0.5) == (q == 1 and t == 0) for d, q, t in labels[1200:])
    assert right >= 0.97 * len(labels[1200:])
    grades = [[scored[d].expected_grade for d, q, t in labels[1200:] if (q, t) == kind] for kind in ((1, 1), (0, 0), (1, 0))]
    assert np.mean(grades[0]) < np.mean(grades[1]) < np.mean(grades[2])
    kept = quality.select(df, model)
    assert kept.schema == df.schema
    nothing = quality.fit(df, train.limit(0))
    assert quality.select(df, nothing).count() == df.count() - 2
    for fitted in (model, nothing):
        blank = quality.score(df.where("doc_id IS NULL OR doc_id = 5000").withColumn("b.c", F.lit(1)), fitted).collect()
        assert [(r.expected_grade, r.tail_probability) for r in blank] == [(0.0, 0.0)] * 2
    assert quality.score(df.limit(0), model).count() == 0


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)
    model = quality.fit(docs, labels.join(held, "doc_id", "left_anti"))
    rows = quality.score(docs.join(held, "doc_id"), model).select("quality", "toxic", "tail_probability").collect()
    clean = [r.tail_probability >= 0.5 for r in rows if r.quality == 1 and r.toxic == 0]
    other = [r.tail_probability >= 0.5 for r in rows if not (r.quality == 1 and r.toxic == 0)]
    assert np.mean(clean) > 0.97 and np.mean(other) < 0.1


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "bpe"]
    first = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert first.columns == docs.columns
    rows = {r.doc_id: r.text for r in first.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[d] == t for d, t in rows.items()) and 0.7 * len(texts) < len(rows) <= len(texts)
    kept = {d: t for d, n, dropped, t in brute_lines(list(rows.items())) if not dropped or re.search(r"[^\x20\x09-\x0D]", t)}
    groups = brute_components(list(kept.items()), 5, 80)
    kept = {d: kept[d] for d, _, least, _ in groups if d == least}
    items = [" " + " ".join(words(r.text)) + " " for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, t in kept.items() if any(i in " " + " ".join(words(t)) + " " for i in items)}
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    whole = tiktoken.Encoding("w", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = {}
    for d, t in kept.items():
        if d not in leaks:
            ids = whole.encode_ordinary(t)
            expected[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == expected


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:4]])
def test_stages_take_nothing(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = stage(spark, docs.limit(0), SF)
    assert out.columns == docs.columns and out.count() == 0


def test_stages_take_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, None), (1, None, "en", None, None), (2, "", None, "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, nulls, SF)
        assert out.columns == docs.columns and out.count() <= 4
    assert corpus_pipeline.tokenize(spark, nulls, SF).count() == 4
