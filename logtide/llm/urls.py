"""URL filters: dated list entries against dated captures, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What an entry can say, strongest first; a removal ends what the list said before.
ACTIONS = ("block", "allow", "remove")

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)"
_SEGMENT = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)"


def host(url: Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, _HOST, 1), F.lit("")))


def keys(url: Column) -> Column:
    """Patterns that can match a URL: its host and the domains above it, down to two labels,
    each alone and with the first part of the path; numeric hosts only as a whole."""
    name = host(url)
    labels = F.split(name, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    names = F.when(name.rlike(r"^[0-9.]+$"), F.array(name)).otherwise(above)
    part = F.nullif(F.regexp_extract(url, _SEGMENT, 1), F.lit(""))
    return F.when(part.isNull(), names).otherwise(
        F.concat(names, F.transform(names, lambda n: F.concat(n, F.lit("/"), part))))


def _said(entries: DataFrame) -> DataFrame:
    """``(key, day, since, strength)``: what is said about a key at an instant, once each."""
    strength = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    domain = F.substring_index("key", "/", 1)
    name = F.concat(F.lower(domain), F.expr("substring(key, char_length(substring_index(key, '/', 1)) + 1)"))
    return (entries.select(name.alias("key"), F.col("listed").cast("timestamp").alias("since"),
                           strength.alias("strength"))
            .where("key is not null and since is not null and strength > 0")
            .groupBy("key", "since").agg(F.min("strength").cast("int").alias("strength"))
            .select("key", F.to_date("since").alias("day"), "since", "strength"))


def intervals(entries: DataFrame) -> DataFrame:
    """``(key, action, since, first, until)``: what holds at the start of the days from ``first``
    to before ``until`` (which may be null), from ``(key, action, listed)``.

    An entry holds from its time until the next entry of its key, so the last of a day
    is what later days begin with. Of entries of one time the strongest action counts;
    removals only end. A key has no more rows than there are days. Rows with a null or another
    action say nothing. Domains match in any case, paths in their own.
    """
    days = (_said(entries).groupBy("key", "day")
            .agg(F.max(F.struct("since", "strength")).alias("last")))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    return (days.withColumn("until", following).where(F.col("last.strength") < len(ACTIONS))
            .select("key", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("last.strength"))
                    .alias("action"), "last.since", F.date_add("day", 1).alias("first"),
                    F.date_add("until", 1).alias("until")))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(page_id, host, fetched, verdict, entry, since)`` for every capture.

    ``captures`` has ``page_id``, ``url`` and ``fetched`` (a date or time), ``entries`` has
    ``key`` (a domain, or a domain and a first path part), ``action`` and ``listed`` (a date or
    time; dates begin at midnight). A capture is judged by the longest key that was listed when
    it was fetched, of equally long ones by the first in order; without any, or without a
    host or time, the verdict is ``none``. Repeated captures are judged alike and returned
    again; null ids as well. Other columns are not read.

    Captures are first reduced to the times of each key. The as-of join is in two parts: what
    held at the start of the day, joined on key and month, and what was said about the key on
    that day until then, joined on key and day.
    """
    kinds = {f.name: f.dataType for f in [*captures.schema.fields, *entries.schema.fields]}
    pages = captures.select(F.col("page_id").cast("long"), "url", "fetched",
                            F.col("fetched").cast("timestamp").alias("at"))
    asked = (pages.where("at is not null")
             .select("url", "at", F.explode(keys(F.col("url"))).alias("key")))
    times = asked.select("key", "at").distinct().withColumn("day", F.to_date("at"))
    month = lambda day: F.year(day) * 12 + F.month(day)
    end = F.lit(pages.agg(F.max(F.to_date("at"))).first()[0]).cast("date")
    until = F.least(F.coalesce("until", F.date_add(end, 1)), F.date_add(end, 1))
    listed = (intervals(entries).where(F.col("first") <= end).withColumn("until", until)
              .select("key", "action", "since", "first", "until", F.explode(F.sequence(
                  month(F.col("first")), month(F.date_sub("until", 1)))).alias("month")))
    days = times.select("key", "day").distinct().withColumn("month", month(F.col("day")))
    before = (days.join(listed, ["key", "month"]).where("first <= day and day < until")
              .select("key", "day", F.struct("since", "action").alias("before")))
    same_day = (times.join(_said(entries), ["key", "day"]).where("since <= at").groupBy("key", "at")
                .agg(F.max(F.struct("since", "strength")).alias("today")))
    today = F.struct("today.since", F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("today.strength"))
                     .alias("action"))
    active = (times.join(before, ["key", "day"], "left").join(same_day, ["key", "at"], "left")
              .select("key", "at", F.when(F.col("today").isNotNull(), today).otherwise(F.col("before"))
                      .alias("now"))
              .where("now.action <> 'remove'").select("key", "at", "now.*"))
    rank = F.struct(-F.length("key"), F.col("key").alias("k"))
    judged = (asked.distinct().join(active, ["key", "at"]).groupBy("url", "at")
              .agg(F.min_by(F.struct("action", "key", "since"), rank).alias("best")))
    return (pages.join(judged, ["url", "at"], "left")
            .select("page_id", host(F.col("url")).alias("host"), "fetched",
                    F.coalesce("best.action", F.lit("none")).alias("verdict"),
                    F.col("best.key").alias("entry"),
                    F.col("best.since").cast(kinds["listed"]).alias("since")))
