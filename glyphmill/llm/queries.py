"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import chat_format, decontaminate, divergence, line_dedup, ngram_join, quality, simhash, slot_shards, source_mix, token_align, toxicity, url_filter, vector_topk
from glyphmill.llm.common import table

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rule_table(spark, url_filter.SITE_RULES + url_filter.PATTERN_RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules).drop("url")


ORACLES["op1_url_filters"] = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(rule, said, rhost, rpath) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), j AS (
  SELECT p.*,
    (SELECT arg_max(struct_pack(rule := rule, said := said), length(rule)) FROM r
      WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)) AS best,
    CASE
      WHEN regexp_matches(url, '(?i)^[^?#]*\.apk(?:[?#]|$)') THEN 'file .apk'
      WHEN regexp_matches(url, '(?i)^[^?#]*/cart/checkout(?:[/?#]|$)') THEN 'checkout'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.dmg(?:[?#]|$)') THEN 'file .dmg'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.exe(?:[?#]|$)') THEN 'file .exe'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.iso(?:[?#]|$)') THEN 'file .iso'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.mp3(?:[?#]|$)') THEN 'file .mp3'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.mp4(?:[?#]|$)') THEN 'file .mp4'
      WHEN regexp_matches(url, '(?i)^[^?#]*\.zip(?:[?#]|$)') THEN 'file .zip'
      WHEN regexp_matches(url, '(?i)^[^?#]*/wp-login\.php') THEN 'login page'
      WHEN regexp_matches(url, '(?i)[?&;]jsessionid=') THEN 'session jsessionid'
      WHEN regexp_matches(url, '(?i)[?&;]phpsessid=') THEN 'session phpsessid'
      WHEN regexp_matches(url, '(?i)[?&;]sessionid=') THEN 'session sessionid'
      WHEN regexp_matches(url, '(?i)://(?:[^/?#]*\.)?doubleclick\.net(?:[:/?#]|$)') THEN 'tracking host'
    END AS pattern
  FROM p
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.said, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern FROM j
"""


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.lit(said).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digest(chat_format.format_conversations(rows)).drop("n_escaped")


ORACLES["op2_chat_formatting"] = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (
  SELECT *, '<\\*(?:\|turn\|>|\|body\|>|/s>|s>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>)|\[\\*(?:INST\]|/INST\])' AS ctl FROM c
), e AS (
  SELECT *, CASE WHEN regexp_matches(text, ctl) OR regexp_matches(role, ctl)
    THEN len(regexp_extract_all(text, ctl)) + len(regexp_extract_all(role, ctl)) ELSE 0 END AS marks FROM m
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + marks + 20) AS BIGINT) AS formatted_chars,
  true AS round_trip
FROM e GROUP BY conv_id
"""


@query
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vector_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLES["op3_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


@query
def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).drop("source")


@query
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_shards.shard(table(spark, sf_dir, "documents"), 40)


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select(
        "row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)
), h AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)), marks AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN marks USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op9_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (SELECT k, min(doc_id) AS keeper FROM l WHERE length(k) >= 10 GROUP BY k), x AS (
  SELECT l.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM l LEFT JOIN f USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).select("row.doc_id", *chain.names, (F.col(chain.names[-1]) >= toxicity.THRESHOLD).alias("rejected"))


@query
def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


@query
def op4_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_counts(table(spark, sf_dir, "documents"))


ORACLES["op4_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * common >= 90 * (a.n + b.n - common)
), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l), r(doc_id, root) AS (
  SELECT DISTINCT x, x FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce((SELECT min(root) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.align(table(spark, sf_dir, "documents"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), o AS (SELECT id, lang, source, unnest(w) AS term FROM d
), kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), c AS (
  SELECT g.lang, g.source, k.term, coalesce(x.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k ON k.lang = g.lang
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY lang, source, term) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), p AS (
  SELECT *, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER g + 2 * count(*) OVER g)::HUGEINT AS p FROM c WINDOW g AS (PARTITION BY lang, source)
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 2)::HUGEINT) // (sum(sum(n)) OVER g + 2 * count(*) OVER g)::HUGEINT AS q FROM c GROUP BY lang, term WINDOW g AS (PARTITION BY lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM (SELECT DISTINCT lang, source FROM d) a
  JOIN (SELECT DISTINCT lang, source FROM d) b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), terms AS (
  SELECT p.lang, p.source, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), r AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
), k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS k FROM r)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(k AS INTEGER) AS rank FROM k WHERE part = 'pair' OR k <= 10
"""


@query
def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))
