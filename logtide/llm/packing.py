"""Best-two-fit packing of documents into sequences.

Tokens are counted by tasks; what is packed is the table of how many pieces there are of each
length, which has at most ``CAPACITY`` rows whatever the corpus. One plan tells for each kind of
sequence which lengths it holds and how often it is made, and every piece finds its place in
it by its number among the pieces of its length.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, counted, stored

#: Tokens of a sequence, and the id that ends a document.
CAPACITY = 2048
END = 0

_WORD_END = "</w>"
# Punctuation that stands in a word of its own behind letters; an apostrophe may begin one.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# Letters of Latin alphabets but the one whose lower case is two characters.
_LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-įı-ɏ]*$"
# Words whose ids a task remembers, and the longest of them in characters.
_REMEMBERED = 500_000
_LONGEST = 64
_TEXTS = 512  # texts encoded together


def _listed(array: pa.Array) -> list:
    return array.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


class Encoder:
    """Encodes texts within a task by a tokenizer that drops white space; words once each.

    The tokenizer must cut its input into words at white space and between letters and
    punctuation, write letters in lower case, and mark the last token of every word. Texts that
    hold one of its special tokens are given to it whole, as such a token may hold anything.
    """

    def __init__(self, definition: str):
        import os

        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        special = [t["content"] for t in json.loads(definition).get("added_tokens", ())]
        self.special = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None
        self.openings = {t[:1].lower() for t in special} | {t[:1].upper() for t in special}
        self.known: dict[str, bytes] = {"": b""}

    def _tokenized(self, texts: list[str]) -> list[np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, "<u4") for e in encode(texts, add_special_tokens=False)]

    def _learn_plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of one kind of character each, all in one run of the tokenizer."""
        if not words:
            return []
        ids = self._tokenized([" ".join(words)])[0]
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != len(words) or last[-1] != len(ids):
            return [x.tobytes() for x in self._tokenized(words)]
        raw, cuts = ids.tobytes(), [0, *(4 * last).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _ids_of(self, words: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of distinct words; ``plain`` ones are lower-case letters or marks only."""
        known = self.known
        if len(known) + len(words) > _REMEMBERED:
            self.known = known = {"": b""}
        found = list(map(known.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        simple, other = ([i for i in new if plain[i] == kind] for kind in (True, False))
        for part, ids in ((simple, self._learn_plain([words[i] for i in simple])),
                          (other, [x.tobytes() for x in self._tokenized([words[i] for i in other])])):
            for i, own in zip(part, ids, strict=True):
                found[i] = own
                if len(words[i]) <= _LONGEST:
                    known[words[i]] = own
        return found

    def _parted(self, words: pa.Array) -> tuple[np.ndarray, pa.Array, list[bool]]:
        """Distinct words as two keys each: the letters and the marks behind them, or all and
        nothing. Returns codes of both keys for each word, the keys, and which are plain."""
        letters = pc.utf8_rtrim(words, _MARKS)
        plain = pc.match_substring_regex(letters, _LETTERS)
        whole = pc.if_else(plain, pc.utf8_lower(letters), words)
        marks = [w[n:] if ok else "" for w, n, ok in zip(
            _listed(words), _listed(pc.utf8_length(letters)), _listed(plain), strict=True)]
        keys = pa.concat_arrays([whole, pa.array(marks, whole.type)]).dictionary_encode()
        codes = keys.indices.to_numpy()
        known = np.zeros(len(keys.dictionary), bool)
        known[codes[:len(words)][plain.to_numpy(zero_copy_only=False)]] = True
        known[codes[len(words):]] = True
        return codes.reshape(2, -1).T, keys.dictionary, known.tolist()

    def _is_special(self, text: str) -> bool:
        return (self.special is not None and any(o in text for o in self.openings)
                and self.special.search(text) is not None)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        Texts are cut at spaces and line ends; each distinct word is looked up once and its ids
        are put in all its places by index.
        """
        whole = [i for i, t in enumerate(texts) if t and self._is_special(t)]
        held = list(texts)
        for i in whole:
            held[i] = None
        parts = pc.split_pattern(pc.replace_substring(
            pa.array([t or "" for t in held], pa.large_string()), "\n", " "), " ")
        coded = parts.values.dictionary_encode()
        codes, keys, plain = self._parted(coded.dictionary)
        ids = self._ids_of(_listed(keys), plain)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        flat = np.frombuffer(b"".join(ids), "<u4")
        index = codes[coded.indices.to_numpy()].ravel()  # two keys for each word of the texts
        length = size[index]
        ends = np.cumsum(length)
        first = (np.cumsum(size) - size)[index]
        out = flat[np.repeat(first - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.append(0, ends)[2 * parts.offsets.to_numpy()].tolist()
        done = [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, found in zip(whole, self._tokenized([texts[i] for i in whole]), strict=True):
            done[i] = found.tobytes()
        return done


def pieces(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, place)``: what there is to pack.

    The ids of a text and ``end`` make one piece, or pieces of ``capacity`` if there are more.
    ``part`` and ``place`` number the pieces: the task, and the number there among equal lengths.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(definition)
    closing = np.array([end], "<u4").tobytes()

    def task(batches):
        encoder = Encoder(shipped.value)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                some = batch.slice(lo, _TEXTS)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(),
                                       encoder.encode(some.column(1).to_pylist()), strict=True):
                    ids += closing
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at:at + 4 * capacity]
                        length = len(own) // 4
                        rows.append((doc_id, piece, at // 4, length, zlib.crc32(own), part,
                                     int(seen[length])))
                        seen[length] += 1
                yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "part", "place"),
                               map(list, zip(*rows, strict=True)), strict=True))

    return arrow_pass(docs.select(F.col("doc_id").cast("long"), "text"), task,
                      "doc_id long, piece int, start long, length long, ids_crc32 long, "
                      "part int, place long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Kinds of sequences, ``(how often, lengths)``, for so many pieces of each length.

    A sequence is filled greedily, with the longest piece that fits each time. If a gap is left,
    its smallest piece gives way to the two unpacked ones that fit the wider gap most
    tightly, where they fit it better. A kind is made as often as the pieces last, so each
    length is run down after a few kinds and the plan stays as short as the table.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    lengths = sorted(left)
    kinds = []
    while lengths:
        used: dict[int, int] = {}

        def free(length, used=used):
            return left[length] - used.get(length, 0)

        def longest(gap, free=free):
            i = bisect_right(lengths, gap) - 1
            while i >= 0 and free(lengths[i]) <= 0:
                i -= 1
            return lengths[i] if i >= 0 else 0

        held: list[int] = []
        gap = capacity
        while gap and (length := longest(gap)):
            times = min(gap // length, free(length))
            held += [length] * times
            used[length] = used.get(length, 0) + times
            gap -= length * times
        if gap and held:
            smallest = held[-1]
            wider, best = gap + smallest, (smallest, 0, 0)
            for one in lengths[:bisect_right(lengths, wider - 1)]:
                if free(one) <= 0:
                    continue
                used[one] = used.get(one, 0) + 1
                other = longest(min(one, wider - one))
                used[one] -= 1
                if other and one + other > best[0]:
                    best = (one + other, one, other)
            if best[1]:
                held.pop()
                used[smallest] -= 1
                for length in best[1:]:
                    insort(held, length, key=lambda x: -x)
                    used[length] = used.get(length, 0) + 1
        times = min(left[k] // n for k, n in used.items() if n)
        kinds.append((times, held))
        for length, n in used.items():
            left[length] -= n * times
        lengths = [k for k in lengths if left[k]]
    return kinds


def _slots(kinds: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length and first number), and first number, sequence and offset of each slot."""
    next_of: dict[int, int] = {}
    rows, sequence = [], 0
    for times, held in kinds:
        offset = 0
        for length in held:
            first = next_of.get(length, 0)
            rows.append((length, first, sequence, offset))
            next_of[length] = first + times
            offset += length
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0] << 44 | table[:, 1], table[:, 1], table[:, 2], table[:, 3]


def pack(docs: DataFrame, definition: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece.

    ``definition`` is the JSON of a tokenizer whose words never reach over a space or a line
    end. A null or empty text is the single token ``end``. Sequences are filled from offset 0
    without gaps. Repeated rows are packed again; null ids stay null; other columns are not
    read; no rows give no rows.
    """
    items = stored(pieces(docs, definition, capacity, end), "pieces")
    by_part = stored(items.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in
              by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    key, first, sequence, offset = _slots(plan(counts, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    shift = by_part.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0))
                           .alias("shift"))
    numbered = items.join(counted(shift, by_part.count()), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("shift") + F.col("place")).alias("number"))

    def place(batches):
        for batch in batches:
            length, number = (batch.column(i).to_numpy() for i in (3, 5))
            slot = np.searchsorted(key, length << 44 | number, side="right") - 1
            yield dict(zip(batch.schema.names[:5], batch.columns[:5], strict=True),
                       sequence_id=pa.array(sequence[slot] + number - first[slot]),
                       offset=pa.array(offset[slot]))

    return arrow_pass(numbered, place, "doc_id long, piece int, start long, length long, "
                                       "ids_crc32 long, sequence_id long, offset long")


def definition(name: str) -> str:
    """JSON of a public tokenizer (read on the driver's side)."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()
