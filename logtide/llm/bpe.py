"""Byte-level BPE: encoding by ranked merges, decoding by joining pieces.

The main path folds the merges over the bytes of each distinct word once per task, with the
rank map shipped to the tasks (a vocabulary, so of fixed size), and puts texts together from
the words' ids. ``encode_words_native`` is the same fold in higher-order functions, with the
rank map as a literal; it gives the same ids, but interprets every step (figures in the README).
"""

from __future__ import annotations

import base64
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, utf8

_NONE = 1 << 30
# Words whose ids a task remembers, and the longest of them in characters.
_REMEMBERED = 300_000
_LONGEST = 64
# Words from this many bytes on are merged by a heap.
_HEAP_FROM = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of every byte sequence in a rank file (on the driver's side)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: merge the neighbours of the lowest rank, leftmost first, to the end."""
    if word in ranks:
        return [ranks[word]]
    if len(word) >= _HEAP_FROM:
        return _merge_long(word, ranks)
    parts = [word[i:i + 1] for i in range(len(word))]
    pairs = [ranks.get(a + b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs:
        lowest = min(pairs)
        if lowest == _NONE:
            break
        i = pairs.index(lowest)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """``merge`` in n log n: open pairs wait in a heap, stale ones are passed over."""
    n = len(word)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    current = [_NONE] * n

    def rate(i):
        j = after[i]
        current[i] = ranks.get(word[i:end[j]], _NONE) if j < n else _NONE
        if current[i] != _NONE:
            heapq.heappush(heap, (current[i], i))

    heap: list[tuple[int, int]] = []
    for i in range(n):
        rate(i)
    while heap:
        rank, i = heapq.heappop(heap)
        if current[i] != rank:
            continue
        j = after[i]
        end[i], after[i], current[j] = end[j], after[j], _NONE
        if after[j] < n:
            before[after[j]] = i
        rate(i)
        if before[i] >= 0:
            rate(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts within a task; equal words are merged once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern).findall
        self.merged: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = np.array(merge(utf8(word), self.ranks), "<u4").tobytes()
        if len(word) <= _LONGEST:
            self.merged[word] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        if len(self.merged) >= _REMEMBERED:
            self.merged = {}
        merged = self.merged
        return b"".join([merged.get(w) or self._word(w) for w in self.words(text)])

    def encode(self, texts: list[str | None], spaced: bool) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        ``spaced``: a word of the pattern takes at most one space, before it, so that a
        lone space always starts a word and the parts between can be encoded apart.
        """
        split = [t.split(" ") if t and spaced and "  " not in t and t[-1] != " " else None
                 for t in texts]
        parts = set(chain.from_iterable(p[1:] for p in split if p))
        if len(self.known) + len(parts) > _REMEMBERED:
            self.known = {}
        known = self.known
        new = parts.difference(known)
        for part in new:
            known[part] = self._ids(" " + part)
        out = [self._ids(t or "") if p is None else self._ids(p[0]) + b"".join(
            map(known.__getitem__, p[1:])) for t, p in zip(texts, split, strict=True)]
        for part in new:
            if len(part) > _LONGEST:
                del known[part]
        return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, spaced: bool = True) -> DataFrame:
    """``(doc_id, ids)``: the ids of every whole text, four bytes each, without special tokens.

    ``pattern`` cuts a text into words, and each is merged separately by ``ranks``;
    ``spaced=False`` is for patterns in which a word can hold a space elsewhere than in
    front. A null or empty text has no ids. Repeated rows and rows with null ids are
    returned like others; only ``doc_id`` and ``text`` are read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)

    def task(batches):
        encoder = Encoder(shipped.value, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = encoder.encode(part.column(1).to_pylist(), spaced)
                yield {"doc_id": part.column(0), "ids": pa.array(ids, pa.binary())}

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: dict[bytes, int], *keep: str) -> DataFrame:
    """``(doc_id, *keep, decoded)``: the pieces of the ids joined, as bytes.

    ``keep`` names further columns of ``encoded`` to return. Null ids count as none.
    """
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)
    rows = encoded.select("doc_id", *keep, "ids")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def task(batches):
        pieces = {rank: token for token, rank in shipped.value.items()}
        for batch in batches:
            text = [b"".join([pieces[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])
                    for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield dict(zip(batch.schema.names[:-1], batch.columns[:-1], strict=True),
                       decoded=pa.array(text, pa.binary()))

    return arrow_pass(rows, task, f"{fields}, decoded binary")


# Slots of the literal rank map; two places for each pair.
_SLOTS = 1 << 18
_FIRST, _SECOND = (625341585, 30), (461845907, 28)


def _pair_table(ranks: dict[bytes, int]) -> list[int]:
    """Rank of every pair of ids that may merge, in one of two places of a table."""
    place = lambda pair, h: (pair * h[0] >> h[1]) % _SLOTS
    slots = [0] * _SLOTS
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is None or right is None:
                continue
            entry = ((left << 16 | right) << 17) | (rank + 1)
            at = place(entry >> 17, _FIRST)
            for _ in range(1000):
                slots[at], entry = entry, slots[at]
                if not entry:
                    break
                pair = entry >> 17
                at = place(pair, _SECOND if at == place(pair, _FIRST) else _FIRST)
            else:
                raise ValueError("the rank map does not fit its table")
    return slots


def encode_words_native(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``(word, ids array)`` for a table of distinct binary ``word``, by built-in functions only.

    Ranks must be under 65,536. A null word gives null, an empty one no ids.
    """
    listed = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(kind)
    slots = listed(_pair_table(ranks), "array<bigint>")
    of_byte = listed([ranks[bytes([b])] for b in range(256)], "array<int>")

    def rank(left, right):
        pair = left.cast("bigint") * 65536 + right
        found = [F.get(slots, (F.shiftright(pair * m, s) % _SLOTS).cast("int"))
                 for m, s in (_FIRST, _SECOND)]
        low = lambda e: e.bitwiseAND(F.lit((1 << 17) - 1)) - 1
        return (F.when(F.shiftright(found[0], 17) == pair, low(found[0]))
                .when(F.shiftright(found[1], 17) == pair, low(found[1])).otherwise(_NONE)
                .cast("int"))

    def step(ids, _):
        pairs = F.zip_with(F.slice(ids, 1, F.size(ids) - 1), F.slice(ids, 2, F.size(ids) - 1), rank)
        return F.get(F.transform(F.array(pairs), lambda p: F.get(F.transform(
            F.array(F.array_min(p)), lambda m: F.when(
                F.coalesce(m, F.lit(_NONE)) == _NONE, ids).otherwise(F.get(F.transform(
                    F.array(F.array_position(p, m).cast("int")), lambda i: F.concat(
                        F.slice(ids, 1, i - 1), F.array(m), F.slice(ids, i + 2, F.size(ids)))),
                    0))), 0)), 0)

    size = F.length("word")
    first = F.transform(F.sequence(F.lit(1), size), lambda i: F.get(
        of_byte, F.conv(F.hex(F.substring("word", i, 1)), 16, 10).cast("int")))
    ids = F.aggregate(F.sequence(F.lit(1), size), first,
                      lambda ids, n: F.when(F.size(ids) < 2, ids).otherwise(step(ids, n)))
    return words.select("word", F.when(size == 0, F.array().cast("array<int>"))
                        .otherwise(ids).alias("ids"))


def vocabulary(name: str) -> tuple[dict[bytes, int], str]:
    """Ranks and word pattern of a public tokenizer's rank file."""
    import public_tokenizers
    return read_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def round_trip(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes that decoding them gives."""
    ranks, pattern = vocabulary(name)
    encoded = encode(docs, ranks, pattern).withColumns({
        "n_tokens": (F.octet_length("ids") / 4).cast("long"),
        "ids_sha256": F.sha2("ids", 256)})
    return (decode(encoded, ranks, "n_tokens", "ids_sha256")
            .select("doc_id", "n_tokens", "ids_sha256",
                    F.sha2("decoded", 256).alias("decoded_sha256")))
