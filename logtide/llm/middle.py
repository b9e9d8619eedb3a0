"""Fill-in-middle transformation with a learned rank index.

A cut is given in code points and made in UTF-8 bytes. For a block of text the offsets of all
code points are a rising function of their rank; it is fitted by straight segments that are
off by at most ``ERROR`` bytes, and what is left is stored, one small integer for each code
point. The place of a cut is then predicted from its rank by one segment and corrected by
the stored residual, which gives the exact byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass

#: The marks, and percentages that decide the form.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED, SUFFIX_FIRST = 90, 20
SALT = "1:"

#: Bytes by which a segment may miss an offset; residuals fit one byte.
ERROR = 100

_BLOCK = 1 << 20  # bytes indexed together; segments end with their block
_WINDOW = 1024  # offsets that a segment tries to take in at first
_BATCH = 1 << 22  # bytes of texts handled together, at least one text


def fit(offsets: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray]:
    """First ranks and slopes of segments through ``offsets``, none off by more than ``error``.

    A segment starts at an offset and grows while one slope stays within ``error`` of all it has
    taken in (the cone of such slopes is not empty). It looks ahead in windows that double.
    """
    starts, slopes, at, n = [], [], 0, len(offsets)
    while at < n:
        low, high, end, width = 0.0, np.inf, at + 1, _WINDOW
        while end < n:
            part = offsets[end:end + width]
            run = np.arange(end - at, end - at + len(part), dtype=np.float64)
            rise = part - offsets[at]
            least = np.maximum(np.maximum.accumulate((rise - error) / run), low)
            most = np.minimum(np.minimum.accumulate((rise + error) / run), high)
            closed = np.flatnonzero(least > most)
            taken = int(closed[0]) if len(closed) else len(part)
            if taken:
                low, high = float(least[taken - 1]), float(most[taken - 1])
            end += taken
            if taken < len(part):
                break
            width *= 2
        starts.append(at)
        slopes.append(low if not np.isfinite(high) else (low + high) / 2)
        at = end
    return np.array(starts, np.int64), np.array(slopes)


class RankIndex:
    """Byte offsets of the code points of UTF-8 bytes, by rank."""

    def __init__(self, data: bytes, error: int = ERROR):
        self._size = len(data)
        raw = np.frombuffer(data, np.uint8)
        starts, firsts, slopes, residuals, ranks = [], [], [], [], 0
        for lo in range(0, len(raw), _BLOCK):
            offsets = lo + np.flatnonzero((raw[lo:lo + _BLOCK] & 0xC0) != 0x80)
            if not len(offsets):
                continue
            first, slope = fit(offsets, error)
            number = np.searchsorted(first, np.arange(len(offsets)), side="right") - 1
            guess = self._line(offsets[first][number], slope[number],
                               np.arange(len(offsets)) - first[number])
            residuals.append((offsets - guess).astype(np.int8))
            starts.append(ranks + first)
            firsts.append(offsets[first])
            slopes.append(slope)
            ranks += len(offsets)
        self.count = ranks
        self._starts, self._firsts, self._residuals = (
            np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, firsts, residuals))
        self._slopes = np.concatenate(slopes) if slopes else np.zeros(0)

    @staticmethod
    def _line(first: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return first + np.floor(slope * steps + 0.5).astype(np.int64)

    @property
    def segments(self) -> int:
        return len(self._starts)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Exact byte offsets; the rank after the last gives the end of the bytes."""
        ranks = np.asarray(ranks, np.int64)
        out = np.full(len(ranks), self._size, np.int64)
        inside = ranks < self.count
        r = ranks[inside]
        s = np.searchsorted(self._starts, r, side="right") - 1
        out[inside] = (self._line(self._firsts[s], self._slopes[s], r - self._starts[s])
                       + self._residuals[r])
        return out

    def ranks(self, offsets: np.ndarray) -> np.ndarray:
        """Number of code points before each of some offsets that begin one or end the bytes."""
        offsets = np.asarray(offsets, np.int64)
        if not self.count:
            return np.zeros(len(offsets), np.int64)
        at = np.maximum(np.searchsorted(self._firsts, offsets, side="right") - 1, 0)
        low, high = self._starts[at], np.append(self._starts[1:], self.count)[at]
        while (low < high).any():  # bisection by exact places within the segment
            middle = (low + high) // 2
            less = (low < high) & (self.offsets(middle) < offsets)
            low, high = np.where(less, middle + 1, low), np.where(less | (low >= high), high, middle)
        return low


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide about a document; a null id counts as no digits."""
    digest = hashlib.sha256(f"{SALT}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i:i + 8], 16) for i in range(0, 32, 8))


def form_of(text: bytes, h3: int, h4: int) -> str:
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= TRANSFORMED:
        return "plain"
    return "spm" if h4 % 100 < SUFFIX_FIRST else "psm"


def output(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restore(form: str, out: bytes) -> bytes:
    """The text behind an output."""
    if form == "plain":
        return out
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    cut = out.index(second, len(first))
    last = out.index(MIDDLE, cut)
    one, two, middle = (out[len(first):cut], out[cut + len(second):last], out[last + len(MIDDLE):])
    return one + middle + two if form == "psm" else two + middle + one


def _rows(ids: list, data: bytes, ends: np.ndarray) -> dict:
    """Results for texts that stand one after the other in ``data``."""
    starts = np.append(0, ends[:-1])
    index = RankIndex(data)
    before = index.ranks(ends)
    first = np.append(0, before[:-1])
    chars = before - first
    drawn = [draws(i) for i in ids]
    cuts = np.array([sorted((h1 % (n + 1), h2 % (n + 1))) for (h1, h2, _, _), n in
                     zip(drawn, chars.tolist(), strict=True)], np.int64).reshape(-1, 2)
    bytes_at = index.offsets((first[:, None] + cuts).ravel()).reshape(-1, 2)
    forms, outputs = [], []
    for (_, _, h3, h4), a, (b, c), d in zip(drawn, starts.tolist(), bytes_at.tolist(), ends.tolist(),
                                            strict=True):
        form = form_of(data[a:d], h3, h4)
        forms.append(form)
        outputs.append(output(form, data[a:b], data[b:c], data[c:d]))
    cut = [form != "plain" for form in forms]
    length = lambda x: [int(v) if ok else None for v, ok in zip(x, cut, strict=True)]
    return {"doc_id": ids, "n": chars, "form": forms, "prefix_chars": length(cuts[:, 0]),
            "middle_chars": length(cuts[:, 1] - cuts[:, 0]), "output": outputs}


def transform(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output)`` for every row of ``docs``.

    ``output`` holds UTF-8 bytes. A null or empty text has the form ``plain`` and an empty
    output, as has any text that holds one of the marks its own; the lengths are null then. A
    null id draws as if it had no digits. Repeated rows are returned again; only ``doc_id`` and
    ``text`` are read; no rows give no rows. Texts of any length are cut whole.
    """
    def task(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = batch.column(1)
            lo = 0
            while lo < len(ids):
                parts, size, hi = [], 0, lo
                while hi < len(ids) and (hi == lo or size < _BATCH):
                    parts.append(texts[hi].as_py() or b"")
                    size += len(parts[-1])
                    hi += 1
                yield _rows(ids[lo:hi], b"".join(parts), np.cumsum([len(p) for p in parts]))
                lo = hi

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return arrow_pass(rows, task, "doc_id long, n long, form string, prefix_chars long, "
                                  "middle_chars long, output binary")


def digests(transformed: DataFrame) -> DataFrame:
    """Rows of ``transform`` with the digests of the output and of the text rebuilt from it."""
    def task(batches):
        for batch in batches:
            forms, outputs = (batch.column(i).to_pylist() for i in (2, 5))
            digest = lambda x: hashlib.sha256(x).hexdigest()
            yield dict(zip(batch.schema.names[:5], batch.columns[:5], strict=True),
                       output_sha256=[digest(o) for o in outputs],
                       restored_sha256=[digest(restore(f, o)) for f, o in
                                        zip(forms, outputs, strict=True)])

    return arrow_pass(transformed, task, "doc_id long, n long, form string, prefix_chars long, "
                                         "middle_chars long, output_sha256 string, "
                                         "restored_sha256 string")
