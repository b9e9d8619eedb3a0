"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text of a bounded
labelled sample. A text is cut into windows, one for each word, and a window counts against
the text if the toxic dictionary makes it shorter than the ordinary one by a calibrated number
of bytes. Each character is first written as the hash of the window up to it: short windows are
then long enough to compress, and a match always starts with the window.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, releasing, utf8

#: Labelled rows used for training, at most, with and without the label; the rows are those of
#: the lowest id hashes, and texts that occur twice count once.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 1500, 4500
#: Part of the sample that calibrates the thresholds instead of training the dictionaries.
CALIBRATION = 0.3

_WINDOW = 40  # bytes
_EDGES = ".,;:!?\"'()*&%$#|[]{}<>-"
_PREFIX = 4  # characters by which toxic and ordinary words are told apart in the sample
_TOXIC_BYTES, _ORDINARY_BYTES = 1 << 14, 1 << 15
_HEADER = 12  # most bytes that a frame adds to what cannot be compressed
_REMEMBERED = 300_000
_PARAMETERS = dict(window_log=16, hash_log=12, chain_log=12, search_log=4, min_match=6,
                   target_length=16, strategy=zstandard.STRATEGY_LAZY2,
                   write_content_size=False, write_checksum=False, write_dict_id=False)


def learnable(doc_id: Column) -> Column:
    """Rows from which labels may be learnt; the others are held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _windows(token: str) -> list[bytes]:
    word = utf8(token.strip(_EDGES))
    return [word[i:i + _WINDOW] for i in range(0, len(word), _WINDOW)]


def _spread(window: bytes) -> bytes:
    digest = xxhash.xxh64_digest
    return b"".join([digest(window[:i]) for i in range(1, len(window) + 1)])


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int  # bytes by which a window must be shorter
    needed: int  # such windows that make a text toxic


class Scorer:
    """Scores texts within a task; equal words are compressed once."""

    def __init__(self, model: Model, bound: bool = True):
        parameters = zstandard.ZstdCompressionParameters(**_PARAMETERS)
        self._shorten = []
        for content in (model.toxic, model.ordinary):
            trained = zstandard.ZstdCompressionDict(content, zstandard.DICT_TYPE_RAWCONTENT)
            self._shorten.append(zstandard.ZstdCompressor(
                dict_data=trained, compression_params=parameters).compress)
        self.model, self.known = model, {}
        # A window whose toxic length is beyond this cannot reach the threshold.
        self._slack = _HEADER - model.threshold if bound else 1 << 30

    def _gain(self, token: str) -> int:
        best, (toxic, ordinary) = 0, self._shorten
        for window in _windows(token):
            spread = _spread(window)
            length = len(toxic(spread))
            if length <= len(spread) + self._slack:
                best = max(best, len(ordinary(spread)) - length)
        if len(self.known) >= _REMEMBERED:
            self.known.clear()
        if len(token) <= _WINDOW:
            self.known[token] = best
        return best

    def gains(self, text: str | None) -> list[int]:
        known = self.known
        return [known[t] if t in known else self._gain(t) for t in set(tokens(text))]

    def score(self, text: str | None) -> float:
        """From 0.5 with enough windows over the threshold, rising with their number."""
        if not self.model.toxic:
            return 0.0
        gains = self.gains(text)
        found = sum(g >= self.model.threshold for g in gains)
        if found >= self.model.needed:
            return 1.0 - 0.5 ** (found - self.model.needed + 1)
        nearest = min(1.0, max(gains, default=0) / self.model.threshold)
        return 0.4 * (found + 0.5 * nearest) / self.model.needed


def _trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on ``samples``; few samples are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=48, d=8).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _families(texts: list[str]) -> list[set[str]]:
    """Words of the texts, those of near copies together: they tell no more than one text.

    Near copies are told by the smallest hash of their triples of words.
    """
    families: dict[int, set[str]] = {}
    for text in texts:
        row = tokens(text)
        triples = zip(row, row[1:], row[2:], strict=False)
        name = min((xxhash.xxh64_intdigest(utf8(" ".join(t))) for t in triples),
                   default=xxhash.xxh64_intdigest(utf8(text)))
        families.setdefault(name, set()).update(
            w for t in row if len(w := t.strip(_EDGES)) >= _PREFIX)
    return list(families.values())


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Dictionaries from most of the texts, thresholds from the rest."""
    cuts = [max(1, int(len(x) * (1 - CALIBRATION))) for x in (toxic, ordinary)]
    if not toxic or not ordinary:
        return Model(b"", b"", 1, 1)
    families = [_families(texts[:cut]) for texts, cut in zip((toxic, ordinary), cuts, strict=True)]
    words = [Counter(w for held in part for w in held) for part in families]
    heads = [Counter(h for held in part for h in {w[:_PREFIX] for w in held}) for part in families]
    # What ordinary text has as well says nothing about toxicity, so it gets no room.
    least = max(3, int(0.008 * len(families[0])))
    share = len(families[0]) / max(1, len(families[1]))
    marked = {h for h, n in heads[0].items()
              if n >= least and heads[1][h] * share * 20 < n}
    samples = [[_spread(utf8(w)[:_WINDOW]) for w, n in sorted(words[0].items())
                if w[:_PREFIX] in marked for _ in range(min(n, 50))],
               [_spread(utf8(w)[:_WINDOW]) for w, n in words[1].most_common(20_000)
                if w[:_PREFIX] not in marked for _ in range(min(5, 1 + n // 5))]]
    for part in samples:
        random.Random(3).shuffle(part)
    model = Model(_trained(samples[0], _TOXIC_BYTES) if samples[0] else b"",
                  _trained(samples[1], _ORDINARY_BYTES) if samples[1] else b"", 1, 1)
    return _calibrated(model, toxic[cuts[0]:] or toxic, ordinary[cuts[1]:] or ordinary) \
        if model.toxic else model


def _calibrated(model: Model, toxic: list[str], ordinary: list[str]) -> Model:
    """The thresholds that part the calibration texts best; of equals the middle one."""
    scorer = Scorer(model, bound=False)
    gains = [[np.array(scorer.gains(t) or [0]) for t in texts] for texts in (toxic, ordinary)]
    found = {}
    for threshold in range(8, 65, 2):
        counts = [np.array([(g >= threshold).sum() for g in part]) for part in gains]
        for needed in (1, 2, 3):
            hit, wrong = [(c >= needed).mean() for c in counts]
            found[threshold, needed] = hit - 2 * wrong
    best = max(found.values())
    good = [key for key, value in found.items() if value >= best - 1e-9 and key[1] == min(
        k[1] for k, v in found.items() if v >= best - 1e-9)]
    threshold, needed = good[len(good) // 2]
    return Model(model.toxic, model.ordinary, threshold, needed)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from the labelled rows of ``docs`` that are not held out.

    At most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` labelled ids are read, and no more rows than
    that, however often an id is repeated. Rows
    without a label or id are not used; of repeated labels the higher counts. Without rows of
    both kinds the model scores every text 0.
    """
    usable = (labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label"))
              .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                     & learnable(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label")))
    order = F.xxhash64("doc_id")
    chosen = [usable.where(F.col("label") == value).orderBy(order, "doc_id").limit(most)
              for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    picked = chosen[0].union(chosen[1])  # bounded by the two limits
    rows = (docs.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())
            .join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id", "text"))
            .limit(SAMPLE_TOXIC + SAMPLE_ORDINARY).collect())
    rows.sort(key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"]))
    texts = [list(dict.fromkeys(r["text"] for r in rows if r["label"] == value)) for value in (1, 0)]
    return fit(*texts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every whole text.

    The score is 0 to 1, higher for toxic, and ``predicted`` is 1 from 0.5 on. A null or empty
    text has no windows and scores 0. Repeated rows are scored alike; a null id is never held
    out. Only ``doc_id`` and ``text`` are read.
    """
    def task(batches):
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score(t) for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "score": pa.array(scores, pa.float64())}

    scored = arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                        "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
                         .alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, as they are.

    Null and empty texts stay; repeated rows go or stay together and null ids do not matter.
    Columns of any names stay; no rows give no rows.
    """
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(releasing(run), docs.schema)
