"""Main text of web pages by template deduction over the pages of a host.

Tokens of a page are its elements, told apart by their path, and the texts between tags, told
apart by path and content. Over the pages of one host each token has an occurrence vector: how
often it stands in every page. Tokens with equal vectors and one parent form an equivalence
class, which is valid if its tokens come in one order wherever they occur. Valid classes nest
by their paths into the template of the host; what is left between its tokens are the slots.
The main text is what the slots below the template's content elements hold, without the parts
that belong to menus, notices and the like.

A vector is kept as its length, its sum and the exclusive or of a hash of (page, count), so
equal vectors are found by aggregates that combine before their shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, stored, utf8
from logtide.llm.markup import TEXT, Page, Reader, blocks, plain
from logtide.llm.urls import host
from logtide.session import BROADCAST_ROWS

#: Pages in which a token must occur to be part of a template, and their least share of the
#: host's pages; share from which a text that stands once a page belongs to the template.
SUPPORT, SHARE, CONSTANT = 3, 0.5, 0.9
#: Share of the text below an element that makes one child the place to look further.
DOMINANT = 0.6

#: Bytes of templates that are broadcast; beyond that pages meet them in a salted join.
BROADCAST_BYTES = 32 << 20
_SALT_PAGES = 2_000
ELEMENT, WORDING, BOX = 0, 1, 2
_SEEN = ("array<struct<token:long,parent:long,kind:int,landmark:boolean,count:int,chars:long,"
         "links:long>>")
_TEXTS = 256


def wording(path: int, text: str) -> int:
    """Token of a text at a path."""
    return xxhash.xxh64_intdigest(utf8(f"{path} {text}")) >> 1


def _told(page: Page) -> list[bool]:
    """Of each element: does it stand in a landmark."""
    out = [False]
    for own, parent in zip(page.landmark[1:], page.parent[1:], strict=True):
        out.append(own or out[parent])
    return out


def tokens(page: Page) -> tuple[list[int], dict[int, list]]:
    """Tokens in page order, and (parent, kind, landmark, count, chars, links) of each.

    Texts in a landmark are its content and those outside the main text play no part, so neither
    are tokens, but they count as characters of their element.
    """
    order, seen = [], {}
    told, path = _told(page), page.path
    at = 0

    def element(i):
        token = path[i]
        row = seen.get(token)
        if row is None:
            row = seen[token] = [path[page.parent[i]] if i else -1, BOX if page.box[i] else ELEMENT,
                                 page.landmark[i] and not page.outside[i], 0, 0, 0]
        row[3] += 1
        order.append(token)

    for kind, i, text in page.items:
        while at <= i:
            element(at)
            at += 1
        if kind != TEXT or page.outside[i]:
            continue
        words = " ".join(plain(text).split())
        if not words:
            continue
        seen[path[i]][5 if page.link[i] else 4] += len(words)
        if not told[i]:
            token = wording(path[i], words)
            row = seen.setdefault(token, [path[i], WORDING, False, 0, 0, 0])
            row[3] += 1
            row[5 if page.link[i] else 4] += len(words)
            order.append(token)
    while at < len(path):
        element(at)
        at += 1
    return order, seen


def observed(pages: DataFrame) -> DataFrame:
    """``(host, row, seen, order)`` of every page with a host and an html: its tokens."""
    def task(batches):
        reader, part, n = Reader(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                rows = []
                for name, html in zip(*(c.to_pylist() for c in batch.slice(lo, _TEXTS).columns),
                                      strict=True):
                    order, seen = tokens(reader.read(html or ""))
                    rows.append((name, part << 40 | n,
                                 [(token, *row) for token, row in seen.items()], order))
                    n += 1
                yield dict(zip(("host", "row", "seen", "order"), map(list, zip(*rows, strict=True)),
                               strict=True))

    return arrow_pass(pages.where("host is not null and html <> ''").select("host", "html"), task,
                      f"host string, row long, seen {_SEEN}, order array<long>")


def vectors(seen: DataFrame) -> DataFrame:
    """One row per host and token, with its occurrence vector in short and its host's pages."""
    by_token = (seen.select("host", "row", F.inline("seen")).groupBy("host", "token").agg(
        F.min("parent").alias("parent"), F.min("kind").alias("kind"), F.max("landmark").alias("landmark"),
        F.count("*").alias("pages"), F.sum("count").alias("total"),
        F.bit_xor(F.xxhash64("row", "count")).alias("vector"), F.sum("chars").alias("chars"),
        F.sum("links").alias("links")).where(F.col("pages") >= SUPPORT))
    sizes = seen.groupBy("host").agg(F.count("*").alias("of"))
    return by_token.join(sizes, "host").where(F.col("pages") >= F.col("of") * SHARE)


def classes(found: DataFrame) -> DataFrame:
    """``vectors`` with the ``class`` of each token, and how many ``members`` that has."""
    label = F.xxhash64("vector", "pages", "total", "parent")
    found = found.withColumn("class", label)
    size = found.groupBy("host", "class").agg(F.count("*").alias("members"))
    return found.join(size, ["host", "class"])


def by_host(rows: DataFrame, per_host: DataFrame, value: str) -> DataFrame:
    """``rows`` with the column ``value`` of their host in ``per_host`` (one row a host), or null.

    Small tables are broadcast after they were measured. Otherwise the rows of a host are dealt
    over as many salts as its pages need, and what ``per_host`` has is copied to each.
    """
    per_host = stored(per_host, f"host-{value}")
    size = per_host.agg(F.sum(F.length(F.to_json(F.struct("host", value))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(per_host.select("host", value)), "host", "left")
    salts = F.ceil(F.col("of") / _SALT_PAGES)
    dealt = per_host.select("host", value, salts.alias("salts"))
    copies = dealt.select("host", value, F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))
                          .alias("salt"))
    many = stored(dealt.where("salts > 1").select("host", "salts"), "large-hosts")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    salted = rows.join(many, "host", "left").withColumn("salt", F.coalesce(
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")), F.lit(0).cast("long")))
    return salted.join(copies, ["host", "salt"], "left").drop("salt", "salts")


def _in_order(order: list[int], members: dict[int, int]) -> Iterable[tuple[int, int | None]]:
    """(class, hash of its order) for classes in one page; none where it changes."""
    runs: dict[int, list[int]] = {}
    for token in order:
        label = members.get(token)
        if label is not None:
            runs.setdefault(label, []).append(token)
    for label, run in runs.items():
        n = len(set(run))
        first = run[:n]
        yield label, (hash(tuple(first)) if run == first * (len(run) // n) else None)


def valid_classes(seen: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` without the classes whose tokens do not keep one order in all pages."""
    several = (found.where("members > 1").groupBy("host", "of")
               .agg(F.collect_list(F.struct("token", "class")).alias("members")))
    pages = by_host(seen.select("host", "order"), several, "members").where("members is not null")

    def task(batches):
        kept: dict[tuple[str, int], tuple[int, int, bool]] = {}

        def flush():
            rows = [(h, c, *v) for (h, c), v in kept.items()]
            kept.clear()
            return dict(zip(("host", "class", "low", "high", "ok"),
                            map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))

        maps: dict[str, dict[int, int]] = {}
        for batch in batches:
            order = batch.column(1)
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name not in maps:
                    if len(maps) > 200:
                        maps.clear()
                    maps[name] = {m["token"]: m["class"] for m in batch.column(2)[i].as_py()}
                for label, mark in _in_order(order[i].as_py(), maps[name]):
                    low, high, ok = kept.get((name, label), (mark or 0, mark or 0, True))
                    kept[name, label] = (min(low, mark or 0), max(high, mark or 0),
                                         ok and mark is not None)
            if len(kept) > 100_000:
                yield flush()
        yield flush()

    broken = (arrow_pass(pages.select("host", "order", "members"), task,
                         "host string, class long, low long, high long, ok boolean")
              .groupBy("host", "class").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                            F.min("ok").alias("ok"))
              .where("not ok or low <> high").select("host", "class"))
    return found.join(broken, ["host", "class"], "left_anti")


def content_root(parent: dict[int, int], chars: dict[int, int], once: set[int], top: int) -> int:
    """The innermost element on the way down from ``top`` that holds most of the text.

    ``chars`` counts the text of each element without links; only those of ``once`` are entered,
    boxes that stand once in a page.
    """
    below: dict[int, list[int]] = {}
    for token, above in parent.items():
        if token != top:
            below.setdefault(above, []).append(token)
    order, sums = [top], {}
    for token in order:
        order += below.get(token, [])
    for token in reversed(order):
        sums[token] = chars.get(token, 0) + sum(sums[c] for c in below.get(token, []))
    at = top
    while True:
        best = max(below.get(at, []), key=lambda c: (sums[c], -c), default=None)
        if best is None or best not in once or sums[best] < DOMINANT * sums[at] or not sums[best]:
            return at
        at = best


def _outermost(some: set[int], parent: dict[int, int]) -> list[int]:
    out = []
    for token in some:
        above = parent.get(token, -1)
        while above in parent and above not in some:
            above = parent[above]
        if above not in some:
            out.append(token)
    return sorted(out)


def deduced(found: DataFrame) -> DataFrame:
    """``(host, of, template)`` of each host; ``template`` is ``(roots, texts)``.

    ``roots`` are the content elements: the landmarks of the template, or else the element to
    which most of the text leads. ``texts`` are texts of the template. A host has at most twice
    as many template tokens as its pages have on average, so it is one group.
    """
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        of = int(frame["of"].iloc[0])
        is_text = frame["kind"] == WORDING
        elements, texts = frame[~is_text], frame[is_text]
        parent = dict(zip(elements["token"].tolist(), elements["parent"].tolist(), strict=True))
        constant = texts[(texts["pages"] == texts["total"]) & (texts["pages"] >= CONSTANT * of)]
        roots = _outermost(set(elements.loc[elements["landmark"], "token"].tolist()), parent)
        if not roots and 0 in parent:
            chars = Counter(dict(zip(elements["token"].tolist(), elements["chars"].tolist(), strict=True)))
            for above, n in zip(constant["parent"].tolist(), constant["chars"].tolist(), strict=True):
                chars[above] -= n
            once = set(elements.loc[(elements["pages"] == elements["total"])
                                    & (elements["kind"] == BOX), "token"].tolist())
            roots = [content_root(parent, chars, once, 0)]
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "of": [of], "roots": [roots],
                             "texts": [sorted(constant["token"].tolist())]})

    return (found.select("host", "of", "token", "parent", "kind", "landmark", "pages", "total", "chars")
            .groupBy("host").applyInPandas(task, "host string, of long, roots array<long>, texts array<long>")
            .select("host", "of", F.struct("roots", "texts").alias("template")))


def page_root(page: Page) -> set[int]:
    """Content elements of a page by itself: its landmarks, or where most of its text is."""
    marked = {i for i, (m, o) in enumerate(zip(page.landmark, page.outside, strict=True)) if m and not o}
    if marked:
        return marked
    chars: Counter = Counter()
    for kind, i, text in page.items:
        if kind == TEXT and not page.outside[i] and not page.link[i]:
            chars[i] += len(text)
    parent = {i: p for i, p in enumerate(page.parent)}
    return {content_root(parent, chars, {i for i, box in enumerate(page.box) if box}, 0)}


def main_text(page: Page, roots: set[int], texts: set[int]) -> str:
    """Text of the slots below ``roots`` (or the page's own, if it has none of them)."""
    chosen = {i for i, p in enumerate(page.path) if p in roots and not page.outside[i]} or page_root(page)
    told, inside = _told(page), []
    for i, parent in enumerate(page.parent):
        inside.append(i in chosen or (parent >= 0 and inside[parent]))
    items = []
    for kind, i, text in page.items:
        if kind != TEXT:
            items.append((kind, ""))
        elif inside[i] and not page.outside[i]:
            if texts and not told[i] and wording(page.path[i], " ".join(plain(text).split())) in texts:
                continue
            items.append((kind, text))
    return blocks(items)


def templates(pages: DataFrame) -> DataFrame:
    """``(host, of, template)`` for every host of ``(host, html)`` with enough pages."""
    seen = stored(observed(pages), "tokens")
    found = stored(classes(vectors(seen)), "classes")
    return deduced(valid_classes(seen, found))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    A null or empty html has an empty text. Pages without a host (a null or odd url), and those
    of hosts with fewer than ``SUPPORT`` pages or none of the template's content elements, are
    judged by themselves: their landmarks, or the element with most of the text. Repeated rows
    and null ids are returned like others; other columns are not read; no rows give no rows.
    """
    rows = pages.select(F.col("page_id").cast("long"), "url", host(F.col("url")).alias("host"), "html")
    joined = by_host(rows, templates(rows), "template")

    def task(batches):
        reader = Reader()
        for batch in batches:
            for lo in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(lo, _TEXTS)
                out = []
                for html, template in zip(part.column(2).to_pylist(), part.column(3).to_pylist(),
                                          strict=True):
                    roots, texts = (template["roots"], template["texts"]) if template else ((), ())
                    out.append(main_text(reader.read(html or ""), set(roots), set(texts)))
                yield {"page_id": part.column(0), "url": part.column(1), "text": out,
                       "n_chars": pa.array(np.array([len(t) for t in out], np.int64))}

    return arrow_pass(joined.select("page_id", "url", "html", "template"), task,
                      "page_id long, url string, text string, n_chars long")
