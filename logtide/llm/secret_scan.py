"""Secret scans: fixed patterns, and runs that look random to character Markov models.

Two first-order models give the probability of a run of characters: one of random strings,
learnt from what the fixed patterns catch in the same texts (the labelled samples), and one
of ordinary identifiers, learnt from all other text. A run whose log-likelihood ratio passes
``THRESHOLD`` is reported as ``random``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, releasing, utf8

#: The patterns, and the shortest match or group that counts.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are whole, so short ones drop out by themselves
ASSIGN_CHARS, ACCESS_CHARS = 12, 18
KINDS = ("assign", "access", "hex", "random")

#: Characters of a run, its least length, and the log-likelihood ratio (natural logarithm,
#: whole run) from which it counts as random.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
THRESHOLD = 14.0

_SIDE = len(ALPHABET) + 1  # code 0 stands for every other character
_CODE = np.zeros(256, np.intp)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i + 1

Span = tuple[int, int, int]  # start, end, position in KINDS


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_CHARS]
    found += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end, _ in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _pairs(text: str) -> np.ndarray:
    """Counts of neighbouring codes in a text."""
    codes = _CODE[np.frombuffer(utf8("\n" + text + "\n"), np.uint8)]
    return np.bincount(codes[:-1] * _SIDE + codes[1:], minlength=_SIDE * _SIDE)


def pair_counts(docs: DataFrame) -> DataFrame:
    """``(label, pair, n)``: counts of neighbouring characters in random and ordinary text.

    Every task returns at most one row per label and pair, and these are summed.
    """
    def task(batches):
        counts = np.zeros((2, _SIDE * _SIDE), np.int64)
        for batch in batches:
            ordinary, random = [], []
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                at = 0
                for start, end in _merged(base_spans(text)):
                    ordinary.append(text[at:start])
                    # what follows a separator is the value that was caught
                    random.append(re.split(r"[:=]\s*[\"']?", text[start:end], maxsplit=1)[-1])
                    at = end
                ordinary.append(text[at:])
                if sum(map(len, ordinary[-64:])) > 1 << 20 or len(ordinary) >= 512:
                    counts[0] += _pairs("\n".join(ordinary))
                    ordinary = []
            counts[0] += _pairs("\n".join(ordinary))
            counts[1] += _pairs("\n".join(random))
        label, pair = np.nonzero(counts)
        yield {"label": pa.array(label, pa.int32()), "pair": pa.array(pair, pa.int32()),
               "n": pa.array(counts[label, pair])}

    return (arrow_pass(docs.select("text"), task, "label int, pair int, n long")
            .groupBy("label", "pair").agg(F.sum("n").alias("n")))


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of characters, random over ordinary.

    Both models are smoothed: the ordinary one by half a count for each pair, the random one
    is half even, half what was counted, so that it also knows forms it has not seen.
    Without any sample it is even.
    """
    counts = np.zeros((2, _SIDE * _SIDE))
    for row in pair_counts(docs).collect():  # at most 2 x 68 x 68 rows
        counts[row["label"], row["pair"]] = row["n"]
    ordinary, random = counts.reshape(2, _SIDE, _SIDE)[:, :, 1:]
    even = 1.0 / len(ALPHABET)
    p_ordinary = (ordinary + 0.5) / (ordinary + 0.5).sum(axis=1, keepdims=True)
    seen = random.sum(axis=1, keepdims=True)
    p_random = 0.5 * even + 0.5 * np.where(seen > 0, random / np.maximum(seen, 1), even)
    ratio = np.zeros((_SIDE, _SIDE))
    ratio[:, 1:] = np.log(p_random) - np.log(p_ordinary)
    return ratio


def likelihood_ratio(run: str, ratio: np.ndarray) -> float:
    codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
    return float(ratio[codes[:-1], codes[1:]].sum() + ratio[0, codes[0]])


def all_spans(text: str, ratio: np.ndarray, threshold: float = THRESHOLD) -> list[Span]:
    """Base spans and random runs that touch none of them, by start and then kind."""
    base = base_spans(text)
    taken, found, at = _merged(base), list(base), 0
    for m in RUN.finditer(text):  # runs and taken spans both rise, so one walk over them does
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or end <= taken[at][0]) and likelihood_ratio(m[0], ratio) >= threshold:
            found.append((start, end, 3))
    return sorted(found, key=lambda s: (s[0], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, end, k in spans)


def scan(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base, spans)`` of every whole text.

    Spans are ``kind:start:end`` in code points, end exclusive. A null or empty text has no
    spans. ``ratio`` is the result of ``train``; by default it is trained on ``docs``.
    Repeated rows and null ids are returned like others; other columns are not read.
    """
    ratio = train(docs) if ratio is None else ratio

    def task(batches):
        for batch in batches:
            found = [all_spans(t or "", ratio) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(s[2] == k for s in x) for x in found], pa.int64())
            yield {"doc_id": batch.column(0), "n_assign": count(0), "n_access": count(1),
                   "n_hex": count(2), "base": [joined([s for s in x if s[2] < 3]) for x in found],
                   "spans": [joined(x) for x in found]}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, n_assign long, n_access long, n_hex long, base string, "
                      "spans string")


def redact(docs: DataFrame, ratio: np.ndarray | None = None) -> DataFrame:
    """``docs`` with every span replaced by ``[kind]`` and ``n_chars`` brought up to date.

    Columns, and texts without spans, stay as they are; a null text stays null.
    """
    ratio = train(docs) if ratio is None else ratio

    def clean(text):
        spans = all_spans(text, ratio) if text else []
        if not spans:
            return text
        first = {}
        for start, _, kind in spans:
            first.setdefault(start, KINDS[kind])
        out, at = [], 0
        for start, end in _merged(spans):
            out += [text[at:start], f"[{first[start]}]"]
            at = end
        return "".join([*out, text[at:]])

    def run(batches):
        for batch in batches:
            at, n_at = (batch.schema.get_field_index(c) for c in ("text", "n_chars"))
            before = batch.column(at).to_pylist()
            after = [clean(t) for t in before]
            if before == after:
                yield batch
                continue
            new = {at: after}
            if n_at >= 0:
                new[n_at] = [n if a == b else len(a) for n, a, b in
                             zip(batch.column(n_at).to_pylist(), after, before, strict=True)]
            for i, values in new.items():
                field = batch.schema.field(i)
                batch = batch.set_column(i, field, pa.array(values, field.type))
            yield batch

    return docs.mapInArrow(releasing(run), docs.schema)
