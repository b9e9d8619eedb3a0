"""Chat formatting: tool calls linked to their results, ordered, validated and serialised."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import arrow_pass, stored

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool,
          "object": dict, "array": list}


def _plain(pairs):
    made = dict(pairs)
    if len(made) != len(pairs):
        raise ValueError("a key occurs twice")
    return made


def _no_constant(name):
    raise ValueError(f"{name} is no JSON number")


def _finite(text):
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(f"{text} is too large a number")
    return value


def parsed(text: str | None):
    """The value of a JSON text; ``ValueError`` for what is not strict JSON."""
    try:
        return json.loads(text or "", object_pairs_hook=_plain, parse_float=_finite,
                          parse_constant=_no_constant)
    except RecursionError as error:
        raise ValueError("nested too deeply") from error


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and characters as they are (not halves of pairs)."""
    form = dict(sort_keys=True, separators=(",", ":"), allow_nan=False)
    text = json.dumps(value, ensure_ascii=False, **form)
    try:
        text.encode()
    except UnicodeEncodeError:  # half of a surrogate pair has no other form than its escape
        text = json.dumps(value, **form)
    return text


def problem(value, schema: dict, at: str = "$") -> str | None:
    """Where and how a value breaks its schema, if it does.

    Understood are ``type``, ``enum``, ``minimum``, ``maximum``, ``properties``, ``required``,
    ``additionalProperties`` (false) and ``items``.
    """
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind])
                 or isinstance(value, bool) and kind in ("integer", "number")):
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not one of the values"
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if "minimum" in schema and number and value < schema["minimum"]:
        return f"{at}: too small"
    if "maximum" in schema and number and value > schema["maximum"]:
        return f"{at}: too large"
    if isinstance(value, dict):
        fields = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{at}.{name}: missing"
        for name in sorted(value):
            if name in fields:
                if found := problem(value[name], fields[name], f"{at}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{name}: not known"
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            if found := problem(item, schema["items"], f"{at}[{i}]"):
                return found
    return None


def levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level)``: how many calls of the conversation must come before, in a row.

    ``calls`` has ``conv_id``, ``call_id`` and ``needs`` (an array of call ids). What a call
    needs has a lower level; calls on a cycle, or behind one, have none. Needs that are no calls
    of the conversation do not count. Each round settles the calls whose needs are all settled,
    for all conversations at once, and starts from stored tables.
    """
    ids = calls.select("conv_id", "call_id")
    open_needs = stored(
        calls.select("conv_id", "call_id", F.explode(F.array_distinct("needs")).alias("need"))
        .join(ids.withColumnRenamed("call_id", "need"), ["conv_id", "need"]), "needs")
    waiting = open_needs.select("conv_id", "call_id").distinct()
    ready = stored(ids.join(waiting, ["conv_id", "call_id"], "left_anti"), "ready")
    settled, level = ready.withColumn("level", F.lit(0)), 0
    while not (open_needs.isEmpty() or ready.isEmpty()):
        left = stored(open_needs.join(ready.withColumnRenamed("call_id", "need"),
                                      ["conv_id", "need"], "left_anti"), "needs")
        ready = stored(open_needs.select("conv_id", "call_id").distinct()
                       .join(left.select("conv_id", "call_id").distinct(),
                             ["conv_id", "call_id"], "left_anti"), "ready")
        level += 1
        settled = settled.union(ready.withColumn("level", F.lit(level)))
        open_needs = left
    return settled


_NAMED = "conv_id is not null and call_id is not null"


def _parted(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each id in ``order``, and all others. ``row`` tells rows apart."""
    first = (rows.where(_NAMED).groupBy("conv_id", "call_id")
             .agg(F.min(F.struct(*order, "row")).alias("first"))
             .select("conv_id", "call_id", "first.*"))
    return first, rows.join(first.select("row"), "row", "left_anti")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``(conv_id, level, turn, call_id, name, status, message)``: a row per call or stray result.

    ``calls`` has ``conv_id, call_id, turn, name, arguments`` (JSON) and ``needs`` (call ids),
    ``results`` has ``conv_id, call_id, turn, content``. Sorted by level, turn and call id, the
    calls of a conversation stand in topological order. ``status`` is ``ok`` or the first of
    ``cycle``, ``unknown_tool``, ``not_json``, ``invalid: where and how`` and ``no_result``
    that holds; a result of no call is ``no_call``. ``message`` is canonical JSON. Of calls
    with one id the earliest counts, of results as well (of equals the first in order); the
    others are returned as ``repeated_call`` and ``repeated_result``. Rows with a null
    conversation or call id are not linked to anything and have the status ``no_id``. Other columns
    are not read; no rows give no rows.
    """
    numbered = F.monotonically_increasing_id()
    calls = stored(calls.select("conv_id", "call_id", "turn", "name", "arguments", F.coalesce(
        "needs", F.array().cast("array<string>")).alias("needs"), numbered.alias("row")), "calls")
    results = stored(results.select("conv_id", "call_id", "turn", "content", numbered.alias("row")),
                     "results")
    first_calls, more_calls = _parted(calls, ["turn", "name", "arguments", "needs"])
    first_results, more_results = _parted(results, ["turn", "content"])
    yes, no = F.lit(True), F.lit(False)
    linked = (first_calls.withColumn("has_call", yes)
              .join(levels(first_calls), ["conv_id", "call_id"], "left")
              .join(first_results.select("conv_id", "call_id", F.col("turn").alias("result_turn"), "content",
                                         yes.alias("has_result")), ["conv_id", "call_id"], "full")
              .select("conv_id", "level", F.coalesce("turn", "result_turn").alias("turn"),
                      "call_id", "name", "arguments", "content", F.coalesce("has_call", no).alias("has_call"),
                      F.coalesce("has_result", no).alias("has_result"), F.lit(None).cast("string")
                      .alias("apart")))
    apart = lambda kind: F.when(F.expr(_NAMED), kind).otherwise("no_id").alias("apart")
    none = lambda of: F.lit(None).cast(of)
    joined = (linked
              .unionByName(more_calls.select(
                  "conv_id", none("int").alias("level"), "turn", "call_id", "name", "arguments",
                  none("string").alias("content"), yes.alias("has_call"), no.alias("has_result"),
                  apart("repeated_call")))
              .unionByName(more_results.select(
                  "conv_id", none("int").alias("level"), "turn", "call_id", none("string").alias("name"),
                  none("string").alias("arguments"), "content", no.alias("has_call"),
                  yes.alias("has_result"), apart("repeated_result"))))

    def finish(row) -> tuple[str, str]:
        message = {"call_id": row["call_id"]}
        if row["has_result"]:
            message["result"] = row["content"]
        if not row["has_call"]:
            return row["apart"] or "no_call", canonical(message)
        message["name"], schema = row["name"], schemas.get(row["name"])
        try:
            value, status = parsed(row["arguments"]), None
        except ValueError:
            value, status = row["arguments"], "not_json"
        message["arguments"] = value
        if row["apart"]:
            status = row["apart"]
        elif row["level"] is None:
            status = "cycle"
        elif schema is None:
            status = "unknown_tool"
        elif status is None:
            wrong = problem(value, schema)
            status = f"invalid: {wrong}" if wrong else "ok" if row["has_result"] else "no_result"
        return status, canonical(message)

    def task(batches):
        for batch in batches:
            done = [finish(row) for row in batch.to_pylist()]
            yield dict(zip(batch.schema.names[:5], batch.columns[:5], strict=True),
                       status=pa.array([d[0] for d in done], pa.string()),
                       message=pa.array([d[1] for d in done], pa.string()))

    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}
    return arrow_pass(joined, task, ", ".join(
        f"{c} {kinds[c]}" for c in ("conv_id", "level", "turn", "call_id", "name"))
        + ", status string, message string")
