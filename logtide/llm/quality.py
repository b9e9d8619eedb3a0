"""Quality classifier from weak labels.

Overlapping heuristic labellers vote on every text. Expectation-maximisation over the counts of
their vote patterns estimates how accurate each labeller is, and the posterior labels of a
bounded sample train a linear scorer on hashed features.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, releasing, utf8

#: Texts on which the linear scorer is trained, in the mean (chosen by the hash of their id).
SAMPLE = 4000

#: Labellers: measure, then a good text has at most / at least the first value, a bad one more
#: than / less than the second; between them the labeller abstains.
LABELLERS = (
    ("symbols", "low", 0.03, 0.06),       # share of characters that are marks
    ("shouting", "low", 0.15, 0.40),      # share of letters that are capitals
    ("variety", "high", 0.30, 0.15),      # distinct words to words
    ("monotony", "low", 0.15, 0.30),      # share of the commonest word
    ("stops", "high", 0.02, 0.008),       # sentence ends to words
    ("marked", "low", 0.10, 0.30),        # share of words that end in a mark other than , and .
    ("separate", "low", 0.02, 0.15),      # share of words that are a single mark
    ("stutter", "low", 0.05, 0.25),       # share of words that repeat the one before
)
_FEW_WORDS = 5  # with fewer, measures of repetition and sentences abstain

_BUCKETS = 2048
_STEPS = 8
_MARKS = b"#$%&*|!<>=+~^@{}[]\\_"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123))


def measures(text: str | None) -> list[float | None]:
    """One value per labeller; none where it has nothing to go by."""
    raw = utf8(text)
    words = raw.split()
    if not words:
        return [None] * len(LABELLERS)
    n = len(words)
    marks = len(raw) - len(raw.translate(None, _MARKS))
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    counts = Counter(words)
    enough = n >= _FEW_WORDS
    long = n >= 50
    ended = sum(c for w, c in counts.items() if w[-1:] in (b"#", b"$", b"%", b"&", b"*", b"!", b"|"))
    single = sum(counts.get(m, 0) for m in (b"|", b"*", b"#", b"-", b"=", b"&"))
    return [marks / len(raw), capitals / letters if letters and enough else None,
            # long texts repeat words anyway, so the allowance is for their square root
            len(counts) / n * (max(1.0, n / 400) ** 0.5) if long else None,
            max(counts.values()) / n if enough and n >= 20 else None,
            raw.count(b".") / n if long else None,
            ended / n, single / n,
            sum(map(bytes.__eq__, words, words[1:])) / n if enough else None]


def votes(values: list[float | None]) -> list[int]:
    """1 for good, 2 for bad, 0 for no vote."""
    out = []
    for value, (_, kind, good, bad) in zip(values, LABELLERS, strict=True):
        if value is None:
            out.append(0)
        elif kind == "low":
            out.append(1 if value <= good else 2 if value > bad else 0)
        else:
            out.append(1 if value >= good else 2 if value < bad else 0)
    return out


def pattern_of(vote: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v
    return code


def _votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELLERS:
        pattern, v = divmod(pattern, 3)
        out.append(v)
    return out[::-1]


@dataclass
class Agreement:
    """What expectation-maximisation found."""

    prior: float  # share of good texts
    table: np.ndarray  # labeller, class (0 bad, 1 good), vote (0 bad, 1 good) -> probability

    def posterior(self, pattern: int) -> float:
        """Probability that a text with these votes is good."""
        logs = np.log([1 - self.prior, self.prior])
        for i, v in enumerate(_votes_of(pattern)):
            if v:  # an abstention says nothing
                logs = logs + np.log(self.table[i, :, 2 - v])
        return float(1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50))))


def expectation_maximisation(counts: dict[int, int], rounds: int = 200) -> Agreement:
    """Accuracy of every labeller and the share of good texts, from counts of vote patterns.

    It starts from the rule that one vote for bad is enough; a smoothing of one text keeps probabilities off 0 and 1.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    vote = np.array([_votes_of(p) for p in patterns], int).reshape(len(patterns), len(LABELLERS))
    good = np.where((vote == 2).any(1), 0.1, 0.9)
    table = np.full((len(LABELLERS), 2, 2), 1 / 2)
    prior = 0.5
    for _ in range(rounds):
        weight = np.stack([n * (1 - good), n * good])
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        for i in range(len(LABELLERS)):
            voted = weight[:, vote[:, i] > 0].sum(1)
            for v in (1, 2):
                table[i, :, 2 - v] = (weight[:, vote[:, i] == v].sum(1) + 1) / (voted + 2)
        found = Agreement(prior, table)
        new = np.array([found.posterior(p) for p in patterns])
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return Agreement(prior, table.copy())


def features(text: str | None) -> np.ndarray:
    """Hashed features: square roots of the shares of byte triples, and measures in steps."""
    raw = np.frombuffer(utf8(text), np.uint8).astype(np.uint32)
    out = np.zeros(_BUCKETS + len(LABELLERS) * (_STEPS + 1), np.float32)
    if len(raw) >= 3:
        key = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) \
            ^ (raw[2:] * np.uint32(0xC2B2AE3D))
        hashed = (key ^ (key >> np.uint32(15))) % np.uint32(_BUCKETS)
        out[:_BUCKETS] = np.sqrt(np.bincount(hashed, minlength=_BUCKETS) / len(hashed))
    for i, value in enumerate(measures(text)):
        step = _STEPS if value is None else min(_STEPS - 1, int(value ** 0.5 * _STEPS))
        out[_BUCKETS + i * (_STEPS + 1) + step] = 0.5
    return out


@dataclass
class Model:
    agreement: Agreement
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        margin = float(features(text) @ self.weights) + self.bias
        return float(1 / (1 + np.exp(np.clip(-margin, -50, 50))))


def _linear(x: np.ndarray, goal: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by gradient steps with running moments."""
    w, first, second = (np.zeros(x.shape[1] + 1, np.float32) for _ in range(3))
    weight = np.where(goal > 0.5, 0.5 / max(1e-6, (goal > 0.5).mean()),
                      0.5 / max(1e-6, (goal <= 0.5).mean())).astype(np.float32)
    for t in range(1, rounds + 1):
        miss = (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - goal) * weight
        slope = np.append(x.T @ miss / len(x) + 1e-5 * w[:-1], miss.mean()).astype(np.float32)
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope * slope
        w = w - 0.2 * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    return w[:-1], float(w[-1])


def vote_patterns(docs: DataFrame) -> DataFrame:
    """``(pattern, n)`` over all texts; a task returns each pattern once."""
    def task(batches):
        seen: Counter = Counter()
        for batch in batches:
            seen.update(pattern_of(votes(measures(t))) for t in batch.column(0).to_pylist())
        yield {"pattern": list(seen), "n": list(seen.values())}

    return (arrow_pass(docs.select("text"), task, "pattern int, n long")
            .groupBy("pattern").agg(F.sum("n").alias("n")))


def train(docs: DataFrame) -> Model:
    """A model of ``docs``, without any labels but the labellers' votes.

    Vote patterns are counted over all rows (at most three to the number of labellers). The
    scorer is trained on about ``SAMPLE`` rows, or all if there are fewer, drawn by the hash of id
    and text and never more than twice ``SAMPLE``, however often a row is repeated. Without
    rows every text scores 0.5.
    """
    counts = {r["pattern"]: r["n"] for r in vote_patterns(docs).collect()}
    agreement = expectation_maximisation(counts)
    width = _BUCKETS + len(LABELLERS) * (_STEPS + 1)
    total = sum(counts.values())
    if not total:
        return Model(agreement, np.zeros(width, np.float32), 0.0)
    limit = int(min(1.0, SAMPLE / total) * (1 << 32))
    key = F.xxhash64(F.col("doc_id").cast("long"), "text", F.lit(11))
    sample = docs.where(F.pmod(key, F.lit(1 << 32)) < limit).select("text", key.alias("key"))

    def task(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield {"x": pa.array([features(t).astype(np.float16).tobytes() for t in texts], pa.binary()),
                   "pattern": [pattern_of(votes(measures(t))) for t in texts], "key": batch.column(1)}

    rows = (arrow_pass(sample, task, "x binary, pattern int, key long")
            .orderBy("key").limit(2 * SAMPLE).collect())
    if not rows:
        return Model(agreement, np.zeros(width, np.float32), 0.0)
    rows.sort(key=lambda r: (r["pattern"], bytes(r["x"])))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    goal = np.array([agreement.posterior(r["pattern"]) for r in rows], np.float32)
    return Model(agreement, *_linear(x, goal))


def classify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, pattern, posterior, score, predicted)`` of every whole text.

    ``score`` is the linear scorer's probability of a good text and ``predicted`` is 1 from 0.5
    on; ``pattern`` and ``posterior`` are the votes and what they alone say. A null or empty text
    has no votes and is scored by its lack of features. Repeated rows are scored alike; null ids
    are returned. Only ``doc_id`` and ``text`` are read.
    """
    model = train(docs) if model is None else model

    def task(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            patterns = [pattern_of(votes(measures(t))) for t in texts]
            posterior = {p: model.agreement.posterior(p) for p in set(patterns)}
            scores = [model.score(t) for t in texts]
            yield {"doc_id": batch.column(0), "pattern": patterns,
                   "posterior": [posterior[p] for p in patterns], "score": scores,
                   "predicted": [int(s >= 0.5) for s in scores]}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, pattern int, posterior double, score double, predicted int")


def keep_good(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` that are predicted good, as they are.

    Null and empty texts are scored by their lack of features; repeated rows go or stay together
    and null ids do not matter. Columns of any names stay; no rows give no rows.
    """
    model = train(docs) if model is None else model

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(t) >= 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
