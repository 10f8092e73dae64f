"""Repairs, orders, positions and policies."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.operators import dedupe, ledger, lines, policies, repair, reports, resolve, similarity
from glyphmill.plans.registry import LINES, query, table
from glyphmill.sources import identify


def doc_lines(spark, d):
    return lines.lines(table(spark, d, "documents"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS number FROM conversations")
def running_numbers(spark, d):
    return resolve.running_numbers(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query(
    f"""WITH {LINES}, s AS (SELECT doc_id, line_no, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
h AS (SELECT l1, l2, l3, min(doc_id) AS keeper FROM s WHERE l3 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_id) >= 2)
SELECT DISTINCT doc_id, unnest([line_no, line_no + 1, line_no + 2]) AS line_no FROM s JOIN h USING (l1, l2, l3) WHERE doc_id > keeper"""
)
def common_shingles(spark, d):
    return dedupe.common_blocks(doc_lines(spark, d), 3, 2)


_LISTS = "d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"


@query(
    f"""WITH RECURSIVE {_LISTS}, g AS (SELECT doc_id, l, CAST(unnest(range(1, len(l) + 1)) AS INTEGER) AS i FROM d),
k AS (SELECT doc_id, i, l[i] AS line, list_max(list_filter(range(1, least(120, (len(l) - i + 1) // 2) + 1), lambda k: l[i] = l[i + k] AND l[i:i + k - 1] = l[i + k:i + 2 * k - 1])) AS k FROM g),
r AS (SELECT doc_id, i, k FROM k WHERE i = 1 UNION ALL SELECT k.doc_id, k.i, k.k FROM r JOIN k ON k.doc_id = r.doc_id AND k.i = r.i + coalesce(2 * r.k, 1)),
kept AS (SELECT doc_id, unnest(range(i, i + coalesce(k, 1))) AS i FROM r) SELECT doc_id, CAST(i AS BIGINT) AS line_no, line FROM kept JOIN k USING (doc_id, i)"""
)
def folded_blocks(spark, d):
    return dedupe.folded(doc_lines(spark, d))


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(l) AS line, CAST(generate_subscripts(l, 1) AS BIGINT) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
p AS (SELECT a.doc_id, a.i AS j, b.i AS i, b.i - a.i AS d FROM l a JOIN l b ON a.doc_id = b.doc_id AND a.line = b.line AND a.i < b.i), g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS run FROM p),
e AS (SELECT doc_id, i, d, max(i) OVER (PARTITION BY doc_id, d, run) - i + 1 AS n FROM g), k AS (SELECT doc_id, i, max(least(n, d)) AS k FROM e WHERE least(n, d) >= 5 GROUP BY doc_id, i), m AS (SELECT l.*, k FROM l LEFT JOIN k USING (doc_id, i)),
r AS (SELECT doc_id, i, k FROM m WHERE i = 1 UNION ALL SELECT m.doc_id, m.i, m.k FROM r JOIN m ON m.doc_id = r.doc_id AND m.i = r.i + coalesce(r.k, 1)) SELECT doc_id, i AS line_no, line FROM r JOIN l USING (doc_id, i) WHERE k IS NULL"""
)
def earlier_repeats(spark, d):
    return dedupe.by_document(doc_lines(spark, d), dedupe.drop_earlier_repeats)


@query(
    """WITH a AS (SELECT conv_id, list(role ORDER BY turn) AS r FROM conversations WHERE role <> 'system' GROUP BY conv_id), p AS (SELECT conv_id, r, unnest(range(1, len(r) + 1)) AS p FROM a)
SELECT conv_id, CAST(min(p) AS INTEGER) AS period FROM p WHERE len(list_filter(range(1, len(r) - p + 1), lambda i: r[i] <> r[i + p])) = 0 GROUP BY conv_id"""
)
def role_periods(spark, d):
    own = F.array_sort(F.collect_list(F.struct("turn", "role")))
    rows = table(spark, d, "conversations").where("role <> 'system'").groupBy("conv_id").agg(own["role"].alias("r"))
    return rows.select("conv_id", dedupe.smallest_period(F.col("r")).alias("period"))


@query(
    """WITH s AS (SELECT page_id, string_split(replace(html, '><', '>' || chr(1) || '<'), chr(1)) AS s FROM pages) SELECT page_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS k, unnest(s) AS piece FROM s"""
)
def split_boundaries(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(repair.split_speech(F.col("html"), "<", ">")).alias("k", "piece"))


@query(
    f"""WITH {LINES}, d AS (SELECT *, sum(length(replace(line, '.', '')) - length(replace(line, ',', ''))) OVER (PARTITION BY doc_id ORDER BY line_no) AS depth FROM l),
s AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY line_no) <= 0, true) AS starts FROM d), g AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM s),
a AS (SELECT doc_id, grp, count(*) AS n, arg_max(depth, line_no) AS last, min(line_no) AS first_no, string_agg(line, '' ORDER BY line_no) AS joined FROM g GROUP BY ALL)
SELECT doc_id, first_no AS line_no, joined AS line, CAST(n AS INTEGER) AS parts FROM a WHERE n >= 2 AND last <= 0
UNION ALL SELECT doc_id, line_no, line, 1 FROM g JOIN a USING (doc_id, grp) WHERE NOT (n >= 2 AND last <= 0)"""
)
def wrapped_rows(spark, d):
    return repair.join_wrapped(doc_lines(spark, d), ",", ".")


@query()
def near_same_neighbours(spark, d):
    near = similarity.similar_neighbours(doc_lines(spark, d), "doc_id", "line_no", "line", 0.6)
    return near.select("doc_id", "line_no", repair.near_same(F.col("line"), F.col("next")).alias("near"), repair.affix_cover(F.col("line"), F.col("next")).alias("cover"))


@query(
    """WITH r AS (SELECT *, CASE role WHEN 'system' THEN 0 WHEN 'assistant' THEN 1 ELSE 2147483647 END AS rank FROM conversations) SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn) AS place FROM r"""
)
def listed_order(spark, d):
    order = spark.range(2).select(F.element_at(F.array(F.lit("system"), F.lit("assistant")), (F.col("id") + 1).cast("int")).alias("role"), F.col("id").cast("int").alias("rank"))
    rows = resolve.in_listed_order(table(spark, d, "conversations").select("conv_id", "turn", "role"), order, "role")
    return rows.select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("rank", "turn")).cast("long").alias("place"))


@query(
    """WITH b AS (SELECT conv_id, turn // 2 AS page, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS r, turn AS idx, text FROM conversations) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY page, r, idx) AS line_no, CASE WHEN r = 0 THEN 'option' ELSE 'line' END AS kind, text FROM b"""
)
def inserted_options(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("idx"), "role", "text")
    return resolve.insert_options(rows.where("role <> 'user'").drop("role"), rows.where("role = 'user'").drop("role"), "conv_id")


@query(
    """WITH m AS (SELECT conv_id, CASE role WHEN 'system' THEN 2 WHEN 'user' THEN 1 ELSE 0 END AS rank, turn, role FROM conversations) SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY rank, turn) AS line_no, turn FROM m"""
)
def blocks_last(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("line_no"), "turn", "role")
    return resolve.labelled_blocks_last(rows, F.col("role"), ["user", "system"], "conv_id")


@query(
    r"""WITH t AS (SELECT conv_id, turn, text, list_distinct(regexp_extract_all(text, '\b([a-z]{5,6})ing\b', 1)) AS names FROM conversations), v AS (SELECT DISTINCT regexp_extract(text, '([a-z]{5,6})', 1) AS name FROM benchmark),
r AS (SELECT conv_id, turn, unnest(names) AS name FROM t), u AS (SELECT conv_id, turn, list_sort(list(name)) AS unresolved FROM r ANTI JOIN v USING (name) GROUP BY ALL), k AS (SELECT conv_id, turn, count(*) AS n FROM r SEMI JOIN v USING (name) GROUP BY ALL)
SELECT conv_id, turn, coalesce(unresolved, []) AS unresolved, coalesce(n, 0) > 0 AS filled FROM t LEFT JOIN u USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn)"""
)
def unresolved_references(spark, d):
    """Stems before -ing as references; values are there for those that a benchmark text begins with."""
    values = table(spark, d, "benchmark").select(F.regexp_extract("text", "([a-z]{5,6})", 1).alias("name")).distinct().withColumn("value", F.lit("<>"))
    own = table(spark, d, "conversations").select("conv_id", "turn", "text")
    rows = resolve.fill_references(own, values, ["conv_id", "turn"], "text", r"\b([a-z]{5,6})ing\b", "%sing")
    return rows.select("conv_id", "turn", "unresolved", F.col("text").contains("<>").alias("filled"))


@query(
    """WITH n AS (SELECT item_id, text, unnest(list_distinct(regexp_extract_all(text, '([A-Z][a-z]+)', 1))) AS name FROM benchmark), t AS (SELECT item_id, name, CAST((length(text) - length(replace(text, name, ''))) / length(name) AS BIGINT) AS times FROM n)
SELECT item_id AS doc_id, arg_max(name, (times, length(name), name)) AS name, max(times) AS times FROM t GROUP BY item_id"""
)
def inferred_names(spark, d):
    return reports.infer_names(table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text"), ["([A-Z][a-z]+)"])


@query(
    f"""WITH {LINES} SELECT doc_id, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^[0-9 .,]+$') THEN 'numeric' WHEN regexp_matches(line, '[%$#&*]{{3}}') THEN 'junk' WHEN line IN ('And.', 'Of.', 'The.', 'As.') THEN 'listed' ELSE 'text' END AS kind, count(*) AS n FROM l GROUP BY ALL"""
)
def noise_flags(spark, d):
    kind = policies.noise_kind(F.col("line"), ("And.", "Of.", "The.", "As."), ("[%$#&*]{3}",))
    return doc_lines(spark, d).groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    """WITH j AS (SELECT source, avg(quality) AS q, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source), p AS (SELECT source, q >= (SELECT avg(quality) FROM labels) AS keep FROM j WHERE source <> 'src0')
SELECT d.source, coalesce(keep, lang = 'en', false) AS kept, CASE WHEN keep THEN 'included' WHEN NOT keep THEN 'excluded' ELSE 'default' END AS reason, count(*) AS n FROM documents d LEFT JOIN p ON p.source = d.source GROUP BY ALL"""
)
def policy_filter(spark, d):
    """Policies as JSON documents, one a source: sources of labelled quality at or above the mean are included, the others excluded, one stays by default."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    mean = labels.agg(F.avg("quality").alias("mean"))
    good = docs.join(labels.select("doc_id", "quality"), "doc_id").where("source <> 'src0'").groupBy("source").agg(F.avg("quality").alias("q")).join(F.broadcast(mean)).select("source", (F.col("q") >= F.col("mean")).alias("keep"))
    listed = lambda on: F.when(on, F.array("source")).otherwise(F.array().cast("array<string>"))
    files = good.select(F.to_json(F.struct(listed(F.col("keep")).alias("include"), listed(~F.col("keep")).alias("exclude"))).alias("text"))
    rows = policies.decided(docs.select("source", "lang"), policies.policy_table(files), "source", F.col("lang") == "en")
    return rows.groupBy("source", "kept", "reason").agg(F.count("*").alias("n"))


@query("SELECT source, list_sort(list(doc_id))[1:4] AS sample, count(*) AS n FROM documents GROUP BY source")
def bounded_samples(spark, d):
    # A window limits the ids before the shuffle; the counts need no ids.
    docs = table(spark, d, "documents").select("source", "doc_id")
    first = docs.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 4")
    return first.groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("sample")).join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")


@query(
    """WITH l AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, max(o_totalprice) OVER (PARTITION BY o_custkey) AS top FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM l WHERE o_totalprice = top"""
)
def max_per_key(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return orders.join(top, "o_custkey").where("o_totalprice = top").drop("top")


@query(
    """WITH e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 'set' WHEN 'click' THEN 'append' WHEN 'purchase' THEN 'print' END AS op, event_type || event_id AS text FROM events WHERE event_type IN ('signup', 'click', 'purchase')),
a AS (SELECT *, sum(CASE WHEN op = 'set' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age FROM e), p AS (SELECT * FROM a WHERE op = 'print')
SELECT p.event_id, (SELECT string_agg(s.text, '' ORDER BY s.ts, s.event_id) FROM a s WHERE s.user_id = p.user_id AND s.age = p.age AND s.op <> 'print' AND (s.ts, s.event_id) < (p.ts, p.event_id)) AS value FROM p"""
)
def slot_state(spark, d):
    op = F.when(F.col("event_type") == "signup", "set").when(F.col("event_type") == "click", "append").when(F.col("event_type") == "purchase", "print")
    rows = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("pos"), op.alias("op"), F.lit("s").alias("slot"), F.concat("event_type", F.col("event_id").cast("string")).alias("text"))
    return resolve.slot_values(rows.where("op is not null"), "user_id", "pos").select("event_id", "value")


@query()
def greedy_sentences(spark, d):
    return resolve.greedy_sentences(doc_lines(spark, d))


@query(
    """WITH RECURSIVE r(k, node, path) AS (SELECT n_nationkey, n_nationkey, '' FROM nation UNION ALL SELECT k, node * 2 + c, path || c FROM r, (VALUES (1), (2)) v(c) WHERE node * 2 + c < 25)
SELECT k, string_agg(node || '.', '' ORDER BY path) AS body FROM r GROUP BY k"""
)
def macro_expansion(spark, d):
    """A tree of macros: each calls two others, the last ones none."""
    k = F.col("n_nationkey")
    call = lambda c: F.when(k * 2 + c < 25, F.concat(F.lit("[m"), (k * 2 + c).cast("string"), F.lit("]"))).otherwise("")
    macros = table(spark, d, "nation").select(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.concat(k.cast("string"), F.lit("."), call(1), call(2)).alias("body"))
    return resolve.expand_macros(macros).select(F.substring("name", 2, 9).cast("int").alias("k"), "body")


@query(
    """WITH h AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents) SELECT doc_id, CAST('0x' || h AS INTEGER) AS byte, count(*) AS n FROM h GROUP BY ALL"""
)
def byte_counts(spark, d):
    """How often each byte stands in a document's text in UTF-8."""
    return ledger.byte_histogram(table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content")), "doc_id")


@query(
    """WITH p AS (SELECT item_id, text, unnest(range(1, length(text) + 1)) AS i FROM benchmark) SELECT item_id, CAST(strlen(substr(text, 1, i - 1)) AS BIGINT) AS "offset" FROM p WHERE substr(text, i, 2) = 'ee' OR substr(text, i, 2) = 'th'"""
)
def byte_places(spark, d):
    """Where two pairs of bytes stand in an item's text in UTF-8."""
    rows = table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    return identify.find_all(rows, "6565", "item_id").unionByName(identify.find_all(rows, "7468", "item_id"))


@query(
    """WITH s AS (SELECT conv_id, turn // 3 AS page, count(*) AS k FROM conversations GROUP BY ALL), w AS (SELECT conv_id, CAST(sum(k) + count(*) FILTER (k > 1) AS BIGINT) AS want FROM s GROUP BY conv_id), g AS (SELECT conv_id, count(*) + count(*) // 4 AS got FROM conversations GROUP BY conv_id) SELECT conv_id, want, got FROM w JOIN g USING (conv_id) WHERE want <> got"""
)
def row_closure(spark, d):
    """Conversations whose rows (a row more for every four turns) aren't what their pages of three turns ask for."""
    turns = table(spark, d, "conversations").select("conv_id", F.floor(F.col("turn") / 3).alias("page"))
    n = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = n.select("conv_id", F.explode(F.sequence(F.lit(1), (F.col("n") + F.floor(F.col("n") / 4)).cast("int"))).alias("k"))
    return ledger.row_closure(turns, rows, key="conv_id")


@query("SELECT text, list_sort(list(DISTINCT lang)) AS variants, conv_lang FROM (SELECT line AS text, lang, substr(line, 1, 1) AS conv_lang FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY ALL")
def variant_lines(spark, d):
    rows = table(spark, d, "documents").select("lang", F.explode(F.split("text", "\n", -1)).alias("text")).withColumn("conv_lang", F.substring("text", 1, 1))
    return resolve.variant_union(rows, ["conv_lang"], "lang", "text")


@query(
    """WITH l AS (SELECT doc_id, unnest(s) AS line, CAST(generate_subscripts(s, 1) AS BIGINT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), p AS (SELECT *, regexp_extract_all(line, '[^.,]*[.,]+|[^.,]+$') AS p FROM l)
SELECT doc_id, line_no, unnest(CASE WHEN line = '' THEN [''] ELSE p END) AS piece, CAST(generate_subscripts(CASE WHEN line = '' THEN [''] ELSE p END, 1) - 1 AS INTEGER) AS k FROM p"""
)
def click_pieces(spark, d):
    """Lines cut after stops and commas, as clicks would."""
    return doc_lines(spark, d).select("doc_id", "line_no", F.posexplode(repair.split_clicks(F.replace("line", F.lit("_"), F.lit("_")), ".,")).alias("k", "piece"))


@query(
    rf"""WITH {LINES}, n AS (SELECT *, length(replace(line, '.', '')) - length(replace(line, ',', '')) AS more FROM l)
SELECT doc_id, line_no, CASE WHEN more = 1 AND starts_with(line, ',') THEN line || '.' WHEN more = -1 AND ends_with(line, '.') AND line[1] IN (',', '(') THEN line[:-2]
WHEN more = -1 AND ends_with(line, '.') AND NOT contains(line, ',') THEN line[:-2] WHEN more = -1 THEN regexp_replace(line, '\.([^.]*)$', '\1') ELSE line END AS line FROM n"""
)
def balanced_rows(spark, d):
    """Commas as openings and stops as closings; no character cuts a row."""
    rows = doc_lines(spark, d).select("doc_id", "line_no", repair.balanced(F.col("line"), ",", ".", "\u0001", ",(").alias("p"))
    return rows.select("doc_id", "line_no", F.array_join("p", "\n").alias("line"))
