"""Operators over tables against plain versions."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logtide.llm import common, components, packing, queries, simhash, toolcalls, topk, urls
from logtide.llm.components import connected_components

SF = "/root/testdata/sf0.001"


# --- near duplicates --------------------------------------------------------------

def plain_components(points):
    label = {p: p for p in points}
    changed = True
    while changed:
        changed = False
        for a in points:
            low = min(label[b] for b in points if bin(a ^ b).count("1") <= 3)
            if low < label[a]:
                label[a], changed = low, True
    groups: dict[int, list[int]] = {}
    for p in points:
        groups.setdefault(label[p], []).append(p)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("tile", [2048, 3])
def test_links_join_what_is_near(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "_TILE", tile)
    rng = np.random.default_rng(8)
    points = {0, (1 << 64) - 1}
    for _ in range(12):
        at = int(rng.integers(0, 1 << 63)) * 2 + 1
        for _ in range(8):
            points.add(at)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                at ^= 1 << int(bit)
    points = sorted(points)
    signed = [int(np.uint64(p).view(np.int64)) for p in points]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    found = {r.node: r.component for r in connected_components(links).collect()}
    groups: dict[int, list[int]] = {}
    for p, s in zip(points, signed, strict=True):
        groups.setdefault(found.get(s, s), []).append(p)
    assert sorted(map(sorted, groups.values())) == plain_components(points)


@pytest.mark.parametrize("tile, rows", [(2048, 1 << 14), (100, 50), (5, 7), (1, 1)])
def test_batches_of_anchors_are_compared_at_once(monkeypatch, tile, rows):
    """Anchors of few, many and too many rows, which end anywhere in a batch; those without an own row say nothing."""
    monkeypatch.setattr(simhash, "_ROWS", rows)
    rng = np.random.default_rng(5)
    key, fp, near = [], [], set()
    for anchor, size in enumerate([1, 2, 3, 64, 65, 150, 1, 2, 12, 5, 6, 4, 1]):
        at = int(rng.integers(0, 1 << 63))
        points = list({at ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
                       for _ in range(size)})
        own = 0 if anchor in (2, 8) else 1 + size // 3
        key += [anchor << 1 | (i >= own) for i in range(len(points))]
        fp += points
        label = {p: p for p in points}
        for _ in range(8):
            for a in points[:own]:
                for b in points:
                    if bin(a ^ b).count("1") <= 3:
                        label[a] = label[b] = min(label[a], label[b])
        near |= {(anchor, p, label[p]) for p in points if tile >= len(points)}
    key, fp = np.array(key, np.int64), np.array(fp, np.uint64).view(np.int64)
    batches = [pa.record_batch({"key": key[lo:lo + 90], "fp": fp[lo:lo + 90]}) for lo in range(0, len(key), 90)]
    found = [pa.table({k: pa.array(v) for k, v in x.items()}) for x in simhash._compared(tile)(iter(batches))]
    links = [r for t in found for r in t.to_pylist() if r["anchor"] is None]
    label = {p: p for _, p, _ in near}
    for _ in range(200):
        for r in links:
            a, b = (r[k] % (1 << 64) for k in "ab")
            label[a] = label[b] = min(label[a], label[b])
    assert {(g, p, label[p]) for g, p, _ in near} == near
    assert len(links) <= len(near)
    handed = [(r["anchor"], r["tile"], r["own"], r["a"]) for t in found for r in t.to_pylist() if r["anchor"] is not None]
    size = np.bincount(key >> 1)
    wanted = [(k >> 1, k & 1 == 0, f) for k, f in zip(key.tolist(), fp.tolist(), strict=True)
              if size[k >> 1] > tile and k >> 1 not in (2, 8)]
    assert [(g, o, f) for g, _, o, f in handed] == wanted
    place = {}
    for g, t, _, _ in handed:
        place[g] = place.get(g, -1) + 1
        assert t == place[g] // tile


def plan_of(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture
def plans(monkeypatch):
    """Plans of what the SimHash operators store."""
    found = []

    def kept(df, label):
        found.append(plan_of(df))
        return common.stored(df, label)

    for module in (simhash, components):
        monkeypatch.setattr(module, "stored", kept)
    return found


def test_copies_at_anchors_are_not_joined(spark, plans):
    """Spark sizes them as the fingerprints, of which they are 34 times as many, and broadcast them."""
    links = simhash.near_links(spark.range(3000).select(F.xxhash64("id").alias("fp")))
    plans.append(plan_of(links))
    assert any("MapInArrow" in x for x in plans)
    assert not any("Join" in x or "Broadcast" in x for x in plans)


def test_large_tables_are_not_broadcast_by_their_bytes(docs, plans, monkeypatch):
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    small = simhash.near_duplicates(docs)
    assert "BroadcastHashJoin" in plan_of(small)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    plans.clear()
    large = simhash.near_duplicates(docs)
    assert rows(large) == rows(small)
    plans.append(plan_of(large))
    assert any("SortMergeJoin" in x for x in plans)
    assert not any("BroadcastHashJoin" in x for x in plans)


def test_a_stage_of_the_pipeline_broadcasts_no_large_table(docs, plans, monkeypatch):
    """Neither the documents that go, nor those of repeated ids, nor the places of packed lengths."""
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    pack = lambda: packing.pack(docs, packing.definition("word_bpe_49k.json"))
    small = simhash.keep_first(docs), pack()
    assert all("BroadcastHashJoin" in plan_of(x) for x in small)
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    plans.clear()
    large = simhash.keep_first(docs), pack()
    assert list(map(rows, large)) == list(map(rows, small))
    plans += map(plan_of, large)
    assert any("SortMergeJoin" in x for x in plans)
    assert not any("BroadcastHashJoin" in x for x in plans)


def test_anchors_cover():
    rng = np.random.default_rng(9)
    a = rng.integers(0, 1 << 63, 200).astype(np.uint64)
    b = a.copy()
    for i in range(200):
        for bit in rng.choice(64, rng.integers(0, 4), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    anchor_a, row_a, own = simhash._anchors(a)
    anchor_b, row_b, _ = simhash._anchors(b)
    mine, theirs = [set() for _ in a], [set() for _ in a]
    for x, r in zip(anchor_a[own], row_a[own], strict=True):
        mine[r].add(x)
    for x, r in zip(anchor_b, row_b, strict=True):
        theirs[r].add(x)
    assert all(m & t for m, t in zip(mine, theirs, strict=True))


def test_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = {r.node: r.component for r in
           connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_near_duplicates(docs, texts, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    fps = [(i, simhash.fingerprint(t)) for i, t in texts]
    for group in plain_components(sorted({f for _, f in fps})):
        ids = {i for i, f in fps if f in group and i is not None}
        names = {r.component_id for r in got if int(r.fingerprint, 16) in group}
        assert names == {min(ids) if ids else None}
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_stays(docs, texts):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    groups = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert ids == sorted([*groups, None], key=str)


def test_one_of_each_row_of_a_repeated_id(spark):
    """One id with a text near a smaller id's, and one of its own: only the first goes."""
    a, b = "a b c d e f g h", "quite another text stands here and it is long enough"
    rows = [(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 4), (9, b, 5), (None, a, 6), (8, None, 7), (8, "", 8)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, fp int")
    kept = sorted(((r.doc_id, r.text or "") for r in simhash.keep_first(frame).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (None, a), (8, "")], key=str)


# --- top k ------------------------------------------------------------------------

@pytest.mark.parametrize("shard", [16384, 7])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(topk, "_SHARD", shard)
    monkeypatch.setattr(topk, "_TILE_BYTES", 100)
    monkeypatch.setattr(topk, "_MERGE", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(300)]
    rows += [(600, None), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan")] * 4),
             (900, [float("inf")] * 4), (None, [1.0] * 4), (1000, [1.0, 2.0]), (1001, [3.0, 1.0]),
             (0, rows[0][1]), (1100, []), (1, [9.0] * 4), (1, [9.0] * 4), (100, [-9.0] * 4)]
    frame = spark.createDataFrame([(i, v, 5, 1) for i, v in rows],
                                  "vec_id long, embedding array<float>, score int, tile int")
    got = sorted(map(tuple, topk.top_k(frame).collect()))
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for at, (q, own) in enumerate(usable):
        if q % 100 == 0:
            found = sorted((-int(own @ v), i) for j, (i, v) in enumerate(usable)
                           if j != at and len(v) == len(own))[:10]
            expected += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    assert got == sorted(expected)
    assert topk.top_k(frame.limit(0)).count() == 0


def test_large_values_are_exact(spark):
    rows = [(0, [2.0 ** 40, 1.0]), (1, [2.0 ** 15, 3.0]), (2, [1e300, 0.0]), (3, [-1e300, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in topk.top_k(frame).collect()}
    assert got == {1: (2 ** 50) * (2 ** 25) + 1024 * 3072 if 2 ** 75 < 2 ** 63 else 2 ** 63 - 1,
                   2: 2 ** 63 - 1, 3: -2 ** 63}


# --- URL lists --------------------------------------------------------------------

DAY = date(2024, 1, 1)


def judge(url, at, entries):
    best = None
    for key in urls_of(url):
        said = sorted((d, urls.ACTIONS.index(a)) for k, a, d in entries
                      if k and folded(k) == key and d is not None and a in urls.ACTIONS and d <= at)
        if not said:
            continue
        last = max(d for d, _ in said)
        action = min(s for d, s in said if d == last)
        if action < 2 and (best is None or (-len(key), key) < best[0]):
            best = ((-len(key), key), urls.ACTIONS[action], key, last)
    return best[1:] if best else ("none", None, None)


def folded(key):
    domain, slash, path = key.partition("/")
    return domain.lower() + slash + path


def urls_of(url):
    if not url or "://" not in url:
        return []
    host, _, path = url.split("://", 1)[1].partition("/")
    host = host.split("@")[-1].split(":")[0].split("?")[0].split("#")[0].lower()
    labels = host.split(".")
    names = [host] if host.replace(".", "").isdigit() else [
        ".".join(labels[i:]) for i in range(max(1, len(labels) - 1))]
    part = path.split("/")[0].split("?")[0].split("#")[0]
    return names + [f"{n}/{part}" for n in names if part]


def test_lists_over_time(spark):
    pages = [(1, "http://a.b.example.org/x/y"), (2, "https://B.example.org"), (3, "http://example.org/x?q"),
             (4, "http://u:p@a.b.example.org:8080/z"), (5, None), (6, "no url"), (7, "http://10.0.0.1/x"),
             (8, "http://localhost/x"), (None, "http://a.b.example.org/x")]
    captures = [(i, u, DAY + timedelta(days=d), "x") for i, u in pages for d in range(0, 120, 7)]
    captures += [(9, pages[0][1], None, "x"), captures[0]]
    entries = [("example.org", "block", DAY + timedelta(days=10)), ("example.org", "allow", DAY + timedelta(days=50)),
               ("example.org", "remove", DAY + timedelta(days=90)), ("b.example.org/x", "allow", DAY + timedelta(days=20)),
               ("B.Example.org", "block", DAY + timedelta(days=20)), ("b.example.org", "allow", DAY + timedelta(days=20)),
               ("b.example.org", "remove", DAY + timedelta(days=60)), ("10.0.0.1", "block", DAY), ("0.1", "block", DAY),
               ("localhost", "block", DAY), (None, "block", DAY), ("example.org", "other", DAY),
               ("example.org", "block", None), ("example.org", "remove", DAY + timedelta(days=10))]
    got = urls.evaluate(
        spark.createDataFrame(captures, "page_id long, url string, fetched date, verdict string"),
        spark.createDataFrame(entries, "key string, action string, listed date"))
    expected = [(i, *(judge(u, d, entries) if d else ("none", None, None))) for i, u, d, _ in captures]
    rows = [(r.page_id, r.verdict, r.entry, r.since) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert urls.evaluate(spark.createDataFrame([], "page_id long, url string, fetched date"),
                         spark.createDataFrame(entries, "key string, action string, listed date")).count() == 0


def test_lists_within_a_day(spark):
    """Times of the day, capitals of paths, and what a day begins with."""
    t = lambda day, hour=0: datetime(2024, 1, 1) + timedelta(days=day, hours=hour)
    pages = [(1, "http://A.org/Foo/x"), (2, "http://a.org/foo/x"), (3, "http://b.org/"), (4, "http://c.org")]
    captures = [(i, u, t(d, h)) for i, u in pages for d in range(0, 70, 3) for h in (0, 9, 15, 20, 23)]
    entries = [("a.ORG/Foo", "block", t(3, 20)), ("a.org", "allow", t(6, 10)), ("a.org/Foo", "remove", t(9, 9)),
               ("b.org", "block", t(3, 9)), ("b.org", "remove", t(3, 15)), ("b.org", "allow", t(3, 15)),
               ("b.org", "remove", t(3, 20)), ("b.org", "block", t(40, 1)), ("b.org", "allow", t(40, 2)),
               ("c.org", "block", t(-400, 5)), ("c.org", "allow", t(63, 9))]
    got = urls.evaluate(
        spark.createDataFrame(captures, "page_id long, url string, fetched timestamp"),
        spark.createDataFrame(entries, "key string, action string, listed timestamp"))
    rows = [(r.page_id, r.fetched, r.verdict, r.entry, r.since) for r in got.collect()]
    expected = [(i, at, *judge(u, at, entries)) for i, u, at in captures]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    assert {r[2] for r in rows} == {"block", "allow", "none"}


def test_url_query_is_native(spark):
    plan = queries.op9_urls(spark, SF)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# --- tool calls -------------------------------------------------------------------

def test_links(spark):
    schema = {"f": {"type": "object", "required": ["a"], "additionalProperties": False,
                    "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"type": "string"}}}}}
    calls = [
        (1, "a", 1, "f", '{"b":["x"],"a":2}', ["c"]), (1, "b", 2, "f", '{"a": 0}', None),
        (1, "c", 3, "f", '{"a":1,"z":1}', ["zz"]), (1, "d", 4, "g", "{}", ["a"]),
        (1, "e", 5, "f", '{"a":1', ["d", "a", "a"]), (1, "x", 6, "f", '{"a":1}', ["y"]), (1, "y", 7, "f", '{"a":1}', ["x"]),
        (1, "w", 8, "f", '{"a":1}', ["y"]), (1, "s", 9, "f", '{"a":1}', ["s"]), (2, "a", 1, "f", '{"a":true}', []),
        (2, "a", 5, "f", '{"a":9}', []), (2, "n", 2, "f", None, []), (2, "i", 3, "f", '{"a":1e999}', []),
        (2, "k", 3, "f", '{"a":1,"a":2}', []), (None, "a", 1, "f", "{}", []), (2, "u", 4, None, '{"b":"\\ud800"}', [])]
    results = [(1, "a", 9, "zwei"), (1, "a", 8, "é"), (1, "q", 3, None), (2, None, 1, "x"), (1, "b", 1, None)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, "
                                         "arguments string, needs array<string>")
    answers = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    everything = toolcalls.link(frame.withColumn("content", F.lit(1)), answers, schema).collect()
    apart = ("no_id", "repeated_call", "repeated_result")
    rows, others = ([r for r in everything if (r.status in apart) == kind] for kind in (False, True))
    got = {(r.conv_id, r.call_id): (r.level, r.status) for r in rows}
    assert got == {
        (1, "a"): (1, "ok"), (1, "b"): (0, "invalid: $.a: too small"), (1, "c"): (0, "invalid: $.z: not known"),
        (1, "d"): (2, "unknown_tool"), (1, "e"): (3, "not_json"), (1, "x"): (None, "cycle"), (1, "y"): (None, "cycle"),
        (1, "w"): (None, "cycle"), (1, "s"): (None, "cycle"), (1, "q"): (None, "no_call"),
        (2, "a"): (0, "invalid: $.a: not of type integer"), (2, "n"): (0, "not_json"), (2, "i"): (0, "not_json"),
        (2, "k"): (0, "not_json"), (2, "u"): (0, "unknown_tool")}
    assert sorted((str(r.conv_id), str(r.call_id), r.turn, r.status) for r in others) == [
        ("1", "a", 9, "repeated_result"), ("2", "None", 1, "no_id"), ("2", "a", 5, "repeated_call"),
        ("None", "a", 1, "no_id")]
    assert len(rows) + len(others) == len(calls) + len({(1, "q")}) + 2
    assert all(json.loads(r.message)["call_id"] == r.call_id for r in others)
    texts = {(r.conv_id, r.call_id): r.message for r in rows}
    assert texts[1, "a"] == '{"arguments":{"a":2,"b":["x"]},"call_id":"a","name":"f","result":"é"}'
    assert all(json.loads(t) is not None for t in texts.values())
    assert toolcalls.link(frame.limit(0), answers.limit(0), schema).count() == 0


def test_tool_query_is_ordered(spark):
    calls, _ = queries.tool_calls(spark, SF)
    needs = {(r.conv_id, r.call_id): r.needs for r in calls.collect()}
    rows = queries.op10_toolcalls(spark, SF).collect()
    level = {(r.conv_id, r.call_id): r.level for r in rows if r.status != "no_call"}
    assert set(level) == set(needs) and len({r.status.split(":")[0] for r in rows}) >= 5

    def depth(key, above=()):
        if key in above:
            return None
        below = [depth((key[0], n), (*above, key)) for n in needs[key] if (key[0], n) in needs]
        return None if None in below else max(below, default=-1) + 1

    assert level == {key: depth(key) for key in needs}


# --- pipeline ---------------------------------------------------------------------

def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        after = out.collect()
        was = {r.doc_id: r for r in before}
        assert after and len({r.doc_id for r in after}) == len(after) <= len(before)
        if name != "secrets":
            assert all(r == was[r.doc_id] for r in after)
        if name == "quality":
            gone = set(was) - {r.doc_id for r in after}
            assert not any(labels[i].quality for i in gone if i in labels)
        if name == "near_duplicates":
            groups = simhash.near_duplicates(docs)
            assert {r.doc_id for r in after} == {r.component_id for r in groups.collect()}
        docs, before = spark.createDataFrame(after, docs.schema), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in before}


def test_stages_keep_columns_of_any_names(spark):
    """Rows of the table with clashing columns, nulls and repeats: columns stay, rows only go."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    extra = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "f", 2.5, [3]) for r in rows]
    extra += [(None, None, None, None, None, 4, None, None, None), (rows[0].doc_id, rows[0].text, "x", "y", 1, 5, "g", 0.0, []),
              (10 ** 6, "", None, None, 0, 6, "", None, None)]
    docs = spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "row0 int, fp string, score double, key array<int>")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema == docs.schema, name
        kept = {(r.doc_id, r.row0) for r in out.collect()}
        assert kept <= {(r[0], r[5]) for r in extra} and (None, 4) in kept or name == "quality", name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).select("doc_id").distinct().count() == 62


def test_pipeline_of_nothing_and_nulls(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (1, "", None, None, 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()
