"""The queries of this package: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, langid, mixing, quality, sharding, topk, toxicity, urls
from .common import remainder, table

#: (host, path, verdict): the list that op6 judges pages by.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


#: From this score on a label of 1 is predicted.
THRESHOLD = 0.3


def _judged(scores: DataFrame, mod: int, held: int) -> DataFrame:
    return scores.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learnable = docs.where(remainder("doc_id", 5) != 0)
    return _judged(quality.quality_scores(docs, learnable, table(spark, sf_dir, "labels")), 5, 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_chars", "slot", "shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("times")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(remainder("doc_id", 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    vocabulary = chat.load_vocabulary()
    return chat.digests(chat.format_chat(turns, vocabulary), vocabulary)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs.where(remainder("doc_id", 4) != 2), table(spark, sf_dir, "labels"), "toxic")
    return _judged(toxicity.score(docs, model), 4, 2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_ORACLES: dict[str, str] = {}

_ORACLES["op4_mixing"] = r"""
WITH slim AS (
  SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 ELSE 3.0 END)::DOUBLE AS weight,
         3.0::DOUBLE * source_size AS most FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
aims AS (SELECT source, source_size, least(most, weight * max(CASE WHEN level <= most / weight THEN level END) OVER ()) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM aims),
budgets AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT - epochs * source_size ELSE 0 END AS budget FROM plan),
placed AS (
  SELECT s.*, b.source_size, b.target, b.epochs, b.budget,
         sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM slim s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::BIGINT AS taken FROM placed
"""

_ORACLES["op6_url_filter"] = """
WITH rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
split AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE n = 1) USING (page_id)
"""

_ORACLES["op7_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_ORACLES["op2_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iw AS (SELECT DISTINCT item, n, ws[p : p + n - 1] AS g FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(generate_series(1, len(ws) - least(13, len(ws)) + 1)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT doc_id, n, p, ws[p : p + n - 1] AS g FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
h AS (SELECT doc_id, p, n, item FROM dw JOIN iw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT pos)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_ORACLES["op8_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[p : p + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * shared >= 80 * (nx.n + ny.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.v = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least_id AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v AS doc_id, min(c) AS least_id FROM r GROUP BY 1) USING (doc_id)
"""

_ORACLES["op9_chat_format"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(role) + length(text) + 23 + len(regexp_extract_all(role || ' ' || text,
  '<\\|turn\\|>|<\\|body\\|>|<\\|end\\|>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>|<s>|</s>|\\[INST\\]|\\[/INST\\]|<<SYS>>|<</SYS>>|␛')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
