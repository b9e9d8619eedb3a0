"""Fill-in-middle transformation against plain slices of Python strings."""

import hashlib
import random

import numpy as np
import pytest

from logtide.llm import middle


def sha(text):
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def plain_row(doc_id, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, form, a, b - a, sha(out), sha(text)


@pytest.mark.parametrize("batch", [1 << 22, 50])
def test_against_slices(spark, docs, texts, none, monkeypatch, batch):
    monkeypatch.setattr(middle, "_BATCH", batch)
    rng = random.Random(4)
    more = [(100 + i, "".join(rng.choice("ab é日🙂<>PSM") for _ in range(rng.randrange(60))))
            for i in range(300)]
    more += [(500, "x<S>y"), (501, "<P>"), (502, "<"), (503, "é" * 70_000 + "a" * 70_000 + "🙂" * 9_000)]
    frame = docs.select("doc_id", "text", "fp").union(
        spark.createDataFrame([(i, t, "c") for i, t in more], "doc_id long, text string, n string"))
    got = middle.digests(middle.transform(frame)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        (plain_row(i, t) for i, t in texts + more), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert middle.transform(none).count() == 0


@pytest.mark.parametrize("error", [1, 5, 100])
def test_segments_are_bounded_and_exact(error, monkeypatch):
    monkeypatch.setattr(middle, "_BLOCK", 4096)
    rng = random.Random(error)
    text = "".join(rng.choice(["abcdefgh" * 20, "é" * 30, "日本" * 40, "🙂x"]) for _ in range(300))
    data = text.encode()
    offsets = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    starts, slopes = middle.fit(offsets, error)
    which = np.searchsorted(starts, np.arange(len(offsets)), side="right") - 1
    miss = offsets - (offsets[starts][which] + slopes[which] * (np.arange(len(offsets)) - starts[which]))
    assert np.abs(miss).max() <= error + 1e-6 and len(starts) < len(offsets) / 3
    index = middle.RankIndex(data, error)
    assert index.count == len(text)
    ranks = np.arange(len(text) + 1)
    assert (index.offsets(ranks) == np.append(offsets, len(data))).all()
    assert (index.ranks(np.append(offsets, len(data))) == ranks).all()


def test_ascii_is_one_segment_a_block():
    assert middle.RankIndex(b"plain text " * 1000).segments == 1
    assert middle.RankIndex(b"").count == 0


def test_parts_that_look_like_marks_come_back():
    for form in ("psm", "spm"):
        for parts in ((b"<", b"P>", b"<S"), (b"<P", b"", b">"), (b"", b"M>", b"S><"), (b"<<", b"M", b"<M")):
            out = middle.output(form, parts[0], parts[1], parts[2])
            assert middle.restore(form, out) == b"".join(parts)
