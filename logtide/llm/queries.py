"""One query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import (
    bpe, middle, packing, phrases, quality, resample, secret_scan, simhash, templates, toolcalls, topk,
    toxicity, urls,
)
from logtide.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(spark, table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (phrases.with_edits(table(spark, sf_dir, "documents"))
            .withColumnRenamed("edited", "edited_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.definition("word_bpe_49k.json"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a day of fetching that follows from its id."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(730)).cast("int")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2023-01-01").cast("date"), day).alias("fetched"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list that follows from the pages: half of them report something about their site."""
    digest = F.md5("url")
    digit = lambda i: F.conv(F.substring(digest, i, 1), 16, 10).cast("int")
    labels = F.split(urls.host(F.col("url")), r"\.")
    site = F.when((F.size(labels) > 3) & (digit(2) % 2 == 0), F.array_join(
        F.slice(labels, 2, F.size(labels)), ".")).otherwise(F.array_join(labels, "."))
    part = F.regexp_extract("url", r"//[^/?#]+/([^/?#]+)", 1)
    key = F.when((digit(3) < 4) & (part != ""), F.concat(site, F.lit("/"), part)).otherwise(site)
    action = (F.when(digit(1) < 4, "block").when(digit(1) < 6, "allow")
              .when(digit(1) < 8, "remove"))
    day = F.pmod(F.col("page_id") * 104729 + 13, F.lit(730)).cast("int")
    return (table(spark, sf_dir, "pages")
            .select(key.alias("key"), action.alias("action"),
                    F.date_add(F.lit("2023-01-01").cast("date"), day).alias("listed"))
            .where("action is not null"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.evaluate(captures(spark, sf_dir), list_entries(spark, sf_dir))


#: Tools of the derived calls, and what their arguments must be.
SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "additionalProperties": False, "properties": {
        "query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "translate": {"type": "object", "required": ["text", "target"], "properties": {
        "text": {"type": "string"}, "target": {"enum": ["de", "en", "es", "fr"]}}},
    "fetch": {"type": "object", "required": ["url"], "properties": {
        "url": {"type": "string"}, "headers": {"type": "array", "items": {"type": "string"}}}},
}


def tool_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls that follow from the assistant's turns, and results from what the user says next.

    Arguments hold the whole text of the turn. Some are broken, miss something or have a wrong
    value, and some calls need the call before, the one after (so that cycles arise) or one
    that does not exist.
    """
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    call = lambda turn: F.concat_ws("-", F.lit("call"), F.col("conv_id"), turn)
    text = F.col("text")
    arguments = (
        F.when(n % 4 == 0, F.to_json(F.struct(
            text.alias("query"), (n % 53).alias("limit"))))
        .when(n % 4 == 1, F.to_json(F.struct(
            text.alias("text"), F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr", "xx"))),
                                             n % 5 + 1).alias("target"))))
        .when(n % 8 < 4, F.to_json(F.struct(F.array(F.lit("b"), text).alias("headers"), F.concat(
            F.lit("https://example.org/"), n.cast("string")).alias("url"))))
        .otherwise(F.to_json(F.struct(F.lit(1.50).alias("z"), text.alias("a")))))
    needs = F.concat(F.when(n % 3 == 0, F.array(call(F.col("turn") - 2))).otherwise(F.array()),
                     F.when(n % 11 == 0, F.array(call(F.col("turn") + 2))).otherwise(F.array()))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", call(F.col("turn")).alias("call_id"),
        F.element_at(F.array(*map(F.lit, ("search", "translate", "fetch", "other"))), n % 4 + 1)
        .alias("name"),
        F.when(n % 29 == 0, F.substring(arguments, 2, F.char_length(arguments))).otherwise(arguments)
        .alias("arguments"), needs.alias("needs"))
    results = turns.where("role = 'user'").select(
        "conv_id", "turn", call(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op10_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toolcalls.link(*tool_calls(spark, sf_dir), SCHEMAS)


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(middle.transform(table(spark, sf_dir, "documents")))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_secrets": op3_secrets,
    "op4_quality": op4_quality,
    "op5_phrases": op5_phrases,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_packing": op8_packing,
    "op9_urls": op9_urls,
    "op10_toolcalls": op10_toolcalls,
    "op11_html": op11_html,
    "op12_middle": op12_middle,
    "op13_resample": op13_resample,
}

ORACLE = {
    "op9_urls": r"""
WITH p AS (
  SELECT page_id, url, md5(url) digest,
         DATE '2023-01-01' + CAST(((page_id * 7919) % 730 + 730) % 730 AS INTEGER) fetched,
         DATE '2023-01-01' + CAST(((page_id * 104729 + 13) % 730 + 730) % 730 AS INTEGER) listed,
         lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)', 1), '')) host,
         nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') part
  FROM pages),
d AS (
  SELECT *, string_split(host, '.') labels, CAST('0x' || substr(digest, 1, 1) AS INTEGER) d1,
         CAST('0x' || substr(digest, 2, 1) AS INTEGER) d2, CAST('0x' || substr(digest, 3, 1) AS INTEGER) d3
  FROM p),
e AS (
  SELECT CASE WHEN d3 < 4 AND part IS NOT NULL THEN site || '/' || part ELSE site END AS key,
         listed, CASE WHEN d1 < 4 THEN 1 WHEN d1 < 6 THEN 2 ELSE 3 END strength
  FROM (SELECT *, CASE WHEN len(labels) > 3 AND d2 % 2 = 0
                       THEN array_to_string(labels[2:], '.') ELSE host END site FROM d)
  WHERE d1 < 8 AND host IS NOT NULL),
i AS (
  SELECT key, strength, listed since, lead(listed) OVER (PARTITION BY key ORDER BY listed) until
  FROM (SELECT key, listed, min(strength) strength FROM e GROUP BY ALL)),
n AS (
  SELECT page_id, url, host, fetched, part, unnest(CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN [host]
         ELSE list_transform(range(1, greatest(len(labels) - 1, 1) + 1),
                             lambda k: array_to_string(labels[k:], '.')) END) name
  FROM d),
k AS (
  SELECT page_id, fetched, name key FROM n UNION ALL
  SELECT page_id, fetched, name || '/' || part FROM n WHERE part IS NOT NULL),
a AS (
  SELECT page_id, k.key, strength, since,
         row_number() OVER (PARTITION BY page_id ORDER BY length(k.key) DESC, k.key) place
  FROM k JOIN i ON k.key = i.key AND since <= fetched AND (until IS NULL OR fetched < until)
  WHERE strength < 3)
SELECT d.page_id, host, fetched,
       CASE a.strength WHEN 1 THEN 'block' WHEN 2 THEN 'allow' ELSE 'none' END verdict,
       a.key entry, a.since
FROM d LEFT JOIN a ON d.page_id = a.page_id AND place = 1""",
    "op7_topk": """
WITH v AS (
  SELECT row_number() OVER () nr, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) vec
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND embedding IS NOT NULL),
s AS (
  SELECT q.nr, q.vec_id query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) score
  FROM v q JOIN v c ON q.nr <> c.nr AND len(q.vec) = len(c.vec)
  WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY nr ORDER BY score DESC, vec_id) <= 10""",
    "op12_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') text, CAST(length(coalesce(text, '')) AS BIGINT) n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) digest
  FROM documents),
h AS (
  SELECT doc_id, text, n, CAST('0x' || digest[1:8] AS BIGINT) % (n + 1) c1,
         CAST('0x' || digest[9:16] AS BIGINT) % (n + 1) c2, CAST('0x' || digest[17:24] AS BIGINT) h3,
         CAST('0x' || digest[25:32] AS BIGINT) h4
  FROM d),
f AS (
  SELECT doc_id, text, n, least(c1, c2) a, greatest(c1, c2) b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END form
  FROM h),
p AS (
  SELECT *, substring(text, 1, a) prefix, substring(text, a + 1, b - a) middle,
         substring(text, b + 1, n - b) suffix
  FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) output_sha256,
       sha256(text) restored_sha256
FROM p""",
}
