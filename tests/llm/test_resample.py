"""Importance resampling and the radix sort against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logtide.llm import resample
from samples import SF


def plain(rows, target):
    def words(text):
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        return [w.encode() for w in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)]

    def counts(texts):
        return Counter(zlib.crc32(w) % 10000 for t in texts for w in words(t))

    s, t = counts(x for _, x in rows), counts(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
                 for b in (zlib.crc32(w) % 10000 for w in words(text))]
        weight = math.floor(sum(found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, row in enumerate(able[:10 * len(able) // 100]):
        row[4] = place + 1
    return sorted(map(tuple, out), key=str)


def same(got, expected):
    assert sorted(map(tuple, got.collect()), key=str) == expected


def test_against_plain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    same(resample.resample(docs.repartition(5), target), expected)
    assert sum(r[4] is not None for r in expected) > 10


def test_odd_rows(spark, docs, texts, none, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK_ROWS", 4)
    monkeypatch.setattr(resample, "LEAST_WORDS", 1)
    monkeypatch.setattr(resample, "DRAWN_PERCENT", 100)
    got = resample.resample(docs, docs.limit(2)).collect()
    assert len(got) == len(texts)
    able = [r for r in got if r.n_features >= 1]
    assert sorted(r["rank"] for r in able) == list(range(1, len(able) + 1))
    ordered = sorted(able, key=lambda r: r["rank"])
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)
    assert all(r["rank"] is None and r.weight == 0 for r in got if r.n_features == 0)
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, none).count() == len(texts)


@pytest.mark.parametrize("bits,chunk", [(11, 16384), (3, 7), (1, 1000)])
def test_radix_sort(spark, bits, chunk):
    rng = random.Random(bits)
    edge = 1 << 63
    rows = [(rng.choice([-5, 0, 3, None, edge - 1, -edge]), rng.randrange(-9, 9), i // 50, i % 50, i)
            for i in range(400)]
    frame = spark.createDataFrame(rows, "a long, b long, chunk long, place long, id long")
    if bits == 1:  # few passes: one narrow column
        frame, keys = frame.drop("a"), [("b", True)]
        expected = sorted(rows, key=lambda r: (-r[1], r[2], r[3]))
    else:
        keys = [("b", True), ("a", False)] if bits == 11 else [("b", False)]
        expected = sorted(rows, key=(lambda r: (-r[1], r[0] is None, r[0] or 0, r[2], r[3]))
                          if bits == 11 else (lambda r: (r[1], r[2], r[3])))
    got = resample.ranked(frame, keys, bits, chunk).orderBy("position").collect()
    assert [r.id for r in got] == [r[4] for r in expected]
    assert [r.position for r in got] == list(range(len(rows)))


def test_equal_keys_need_no_digits(spark):
    rows = spark.range(5).select(F.lit(7).cast("long").alias("k"), F.lit(0).cast("long").alias("chunk"),
                                 F.col("id").alias("place"), "id")
    got = resample.ranked(rows, [("k", True)]).collect()
    assert sorted((r.position, r.id) for r in got) == [(i, i) for i in range(5)]
    assert resample.ranked(rows.limit(0), [("k", True)]).count() == 0
