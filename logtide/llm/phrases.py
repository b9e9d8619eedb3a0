"""Document fingerprints by locally consistent parsing.

A text is cut into phrases at places that depend on the few characters around them only:
runs of a character are one symbol, deterministic coin tossing turns neighbouring symbols into
small labels that differ, and a phrase starts where a label is larger than both its
neighbours. Phrases are named by a hash of their content, and the row of names is parsed again.
Equal substrings therefore get equal names inside, wherever they stand. The fingerprint is the
sketch of the smallest hashes of the names from level ``LOWEST`` up.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass

#: Levels of phrases; a phrase of the first has about 3 characters, each next is 3 times longer.
LEVELS, LOWEST = 4, 2
#: Hashes in a sketch.
SKETCH = 64

_TOSSES = 4  # 64 bits become at most 128, 14, 8 and 6 labels
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))
_LOWEST_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_CHARS = 1 << 19  # characters parsed together, at least one text


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _toss(labels: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the lowest place in which a label differs from the one before, plus its bit there."""
    differ = labels.copy()
    differ[1:] ^= labels[:-1]
    differ[first] = 1  # the first symbol of a text has nothing before it
    if labels.dtype == np.uint8:
        place = _LOWEST_BIT[differ]
        return (place << 1) | ((labels >> place) & 1)
    low = (differ & (~differ + np.uint64(1))).astype(np.float64).view(np.int64)
    place = np.maximum((low >> 52) - 1023, 0)
    return ((place << 1) | ((labels >> place.astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ).astype(np.uint8)


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of several texts, and where each text starts among them."""
    change = np.ones(len(names), bool)
    change[1:] = names[1:] != names[:-1]
    change[starts] = True
    at = np.flatnonzero(change)
    symbols, runs = names[at], np.diff(np.append(at, len(names))).astype(np.uint64)
    first = np.zeros(len(at), bool)
    first[np.searchsorted(at, starts)] = True
    labels = symbols
    for _ in range(_TOSSES):
        labels = _toss(labels, first)
    cut = first.copy()
    cut[1:-1] |= ((labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
                  & ~first[2:])
    begin = np.flatnonzero(cut)
    length = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at)) - np.repeat(begin, length)
    symbols = _mix(symbols + (runs - np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    name = np.add.reduceat(symbols * _POWERS[place & 255], begin)
    return (_mix(name + length.astype(np.uint64)), np.flatnonzero(first[begin]))


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The smallest distinct hashes of the phrase names of each text, ascending."""
    out, lo = [np.zeros(0, np.uint32)] * len(texts), 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHARS):
            size += len(texts[hi])
            hi += 1
        part = [i for i in range(lo, hi) if texts[i]]
        lo = hi
        if not part:
            continue
        chars = [np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), "<u4") for i in part]
        names = np.concatenate(chars).astype(np.uint64)
        starts = np.cumsum([0] + [len(c) for c in chars[:-1]])
        kept = []
        for level in range(1, LEVELS + 1):
            names, starts = parse(names, starts)
            if level >= LOWEST:
                kept.append(((names >> np.uint64(32)).astype(np.uint32), np.append(starts, len(names))))
        for k, i in enumerate(part):
            found = np.unique(np.concatenate([n[s[k]:s[k + 1]] for n, s in kept]))
            out[i] = found[:SKETCH]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common names, 0 to 1, as the smallest hashes of both together show it."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:SKETCH]
    return float((np.isin(both, a, assume_unique=True)
                  & np.isin(both, b, assume_unique=True)).mean())


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)``: eight hexadecimal digits for each hash, empty for no text."""
    def task(batches):
        for batch in batches:
            found = sketches([t or "" for t in batch.column(1).to_pylist()])
            yield {"doc_id": batch.column(0), "fingerprint": [as_text(s) for s in found]}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, fingerprint string")


# Rows that are sorted together, and most stretches of ids (a row of the driver's for each).
_STRETCH_ROWS, _STRETCHES = 4096, 1 << 20
_SMALLEST = -(1 << 63)


class _Cuts:
    """Where the rows, in order of id and then hash of their text, are cut into stretches.

    ``quantiles`` are about equally many rows apart. An id that fills several of them is cut by
    the hash, into as many parts of equal range.
    """

    def __init__(self, quantiles: list[float]):
        cuts = []
        for value, times in sorted(Counter(quantiles).items()):
            one = max(_SMALLEST, min(int(value), -_SMALLEST - 1))
            cuts += [(one, _SMALLEST + (j << 64) // times) for j in range(times)]
        self.ids, self.hashes = (np.array(x, np.int64) for x in
                                 (zip(*sorted(cuts), strict=True) if cuts else ([], [])))

    def stretch(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Number of the stretch of each row, counted from the largest ids."""
        low = np.searchsorted(self.ids, ids, side="left")
        high = np.searchsorted(self.ids, ids, side="right")
        before = high.copy()
        for cut in np.unique(low[high > low]):
            rows = np.flatnonzero((low == cut) & (high > low))
            before[rows] = cut + np.searchsorted(self.hashes[cut:high[rows[0]]], hashes[rows], side="right")
        return (len(self.ids) - before).astype(np.int64)


def with_next(docs: DataFrame, task, schema: str) -> DataFrame:
    """Run ``task`` over pairs of neighbouring texts by descending ``doc_id``.

    ``task`` takes an iterator of ``(doc_id, text, is_guest)``, in which every row but a guest
    is followed by its next, and yields dicts. The rows are cut into stretches of about equal
    numbers, also within one id; each text is shuffled once, to the task of its stretch, and the
    first of a stretch goes as a guest to the one before as well (that of the first to the last).
    Rows with a null id come last; equal ids follow the falling hash of their texts.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")
                       ).withColumn("hash", F.xxhash64("text"))
    count = rows.count()
    n = max(1, min(_STRETCHES, count // _STRETCH_ROWS))
    # cut points are a matter of balance only, so approximate ones do
    by_id = rows.select(F.coalesce("doc_id", F.lit(_SMALLEST)).alias("id"))
    cuts = _Cuts(by_id.approxQuantile("id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else [])

    def keys(batch):
        ids = batch.column(0).fill_null(_SMALLEST).to_numpy()
        hashes = batch.column(batch.num_columns - 1).to_numpy()
        return ids, hashes, cuts.stretch(ids, hashes)

    def heads(batches):
        best: dict[int, tuple[int, int]] = {}
        for batch in batches:
            ids, hashes, stretch = keys(batch)
            order = np.lexsort((hashes, ids, stretch))
            last = order[np.append(np.flatnonzero(np.diff(stretch[order])), len(order) - 1)] if len(order) else order
            for i in last:
                s = int(stretch[i])
                best[s] = max(best.get(s, (_SMALLEST, _SMALLEST)), (int(ids[i]), int(hashes[i])))
        yield {"stretch": list(best), "id": [v[0] for v in best.values()],
               "hash": [v[1] for v in best.values()]}

    top = {r["stretch"]: tuple(r["head"]) for r in
           arrow_pass(rows.select("doc_id", "hash"), heads, "stretch long, id long, hash long")
           .groupBy("stretch").agg(F.max(F.struct("id", "hash")).alias("head")).collect()}
    order = sorted(top)
    before = {s: order[i - 1] for i, s in enumerate(order)}
    leaders = {top[s]: before[s] for s in order}
    leading = np.unique(np.array([head[1] for head in leaders], np.int64))
    part = {s: i for i, s in enumerate(order)}
    number = np.zeros((order[-1] if order else 0) + 1, np.int64)
    number[order] = range(len(order))

    def deal(batches):
        for batch in batches:
            ids, hashes, stretch = keys(batch)
            take, to, guest = np.arange(len(ids)), number[stretch], np.zeros(len(ids), np.int64)
            lead = [i for i in np.flatnonzero(np.isin(hashes, leading))
                    if (int(ids[i]), int(hashes[i])) in leaders]
            if lead:
                take = np.concatenate([take, lead])
                to = np.concatenate([to, [part[leaders[int(ids[i]), int(hashes[i])]] for i in lead]])
                guest = np.concatenate([guest, np.ones(len(lead), np.int64)])
            picked = batch.take(pa.array(take))
            yield {"doc_id": picked.column(0), "text": picked.column(1), "stretch": pa.array(to.astype(np.int32)),
                   "guest": pa.array(guest), "hash": picked.column(2)}

    dealt = (arrow_pass(rows, deal, "doc_id long, text string, stretch int, guest long, hash long")
             .repartitionById(max(1, len(order)), "stretch")
             .sortWithinPartitions("stretch", "guest", F.desc_nulls_last("doc_id"), F.desc("hash"), "text"))

    def run(batches):
        def flat():
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                   part.column(3).to_pylist(), strict=True)
        return task(flat())

    return arrow_pass(dealt, run, schema)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last ``n_chars // 2`` code points replaced by the first as many of
    the next text by descending id (the last is followed by the first, so a single row by
    itself). Returns ``(doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited,
    near_next)``; ``edited`` is the SHA-256 of the edited text. A null text counts as empty;
    two empty texts are alike (1), an empty and another not (0). Repeated rows follow each other.
    """
    def task(rows):
        def emit(group, following):
            """Results for ``group``, followed by the row ``following``."""
            texts = [t for _, t in group]
            nexts = [*texts[1:], following]
            edited = [t[:len(t) - len(t) // 2] + s[:len(t) // 2] for t, s in
                      zip(texts, nexts, strict=True)]
            found = sketches([*texts, following, *edited])
            own, changed = found[:len(texts) + 1], found[len(texts) + 1:]
            return {
                "doc_id": [i for i, _ in group], "n_chars": [len(t) for t in texts],
                "edited": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                "fingerprint": [as_text(s) for s in own[:-1]],
                "edited_fingerprint": [as_text(s) for s in changed],
                "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=False)],
                "near_next": [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]}

        group, size = [], 0
        for doc_id, text, guest in rows:
            if group and (guest or len(group) >= 512 or size > 2 * _CHARS):
                yield emit(group, text)
                group, size = [], 0
            if not guest:
                group.append((doc_id, text))
                size += len(text)

    return with_next(docs, task, "doc_id long, n_chars long, edited string, fingerprint string, "
                                 "edited_fingerprint string, near_edited double, near_next double")
