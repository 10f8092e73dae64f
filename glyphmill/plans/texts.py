"""Lines, characters, n-grams and markup."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import joins, ledger, lines, resolve
from glyphmill.plans.registry import LINES, query, table
from glyphmill.session import durable


def doc_lines(spark, d):
    return lines.lines(table(spark, d, "documents"))


@query(f"WITH {LINES} SELECT doc_id, line_no, line FROM l")
def lines_explode(spark, d):
    return doc_lines(spark, d)


@query(f"WITH {LINES} SELECT ch, count(*) AS n, min(line_no) AS first_line FROM (SELECT line_no, unnest(string_split(line, '')) AS ch FROM l) WHERE ch <> '' GROUP BY ch")
def charset_ledger(spark, d):
    return ledger.charset(doc_lines(spark, d))


@query(
    f"""WITH {LINES}, c AS (SELECT ch, count(*) AS n, min(line_no) AS first_line FROM (SELECT line_no, unnest(string_split(line, '')) AS ch FROM l) WHERE ch <> '' GROUP BY ch),
f AS (SELECT ch, n, first_line, min(line) AS line FROM c JOIN l ON line_no = first_line AND contains(line, ch) GROUP BY ALL)
SELECT ch, n, first_line, substr(line, greatest(strpos(line, ch) - 8, 1), strpos(line, ch) + 9 - greatest(strpos(line, ch) - 8, 1)) AS context FROM f"""
)
def charset_context(spark, d):
    rows = doc_lines(spark, d)
    return ledger.with_context(ledger.charset(rows), rows, 8)


@query(
    f"""WITH {LINES}, c AS (SELECT line_no, unnest(string_split(line, '')) AS ch FROM l), b AS (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM benchmark)
SELECT ch, count(*) AS n, min(line_no) AS first_line FROM c WHERE ch <> '' AND ch NOT IN (SELECT ch FROM b) GROUP BY ch"""
)
def charset_fresh(spark, d):
    approved = table(spark, d, "benchmark").select(F.explode(F.split("text", "")).alias("ch"))
    return ledger.fresh(ledger.charset(doc_lines(spark, d)), approved)


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]')) AS BIGINT) AS controls, CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS latin FROM documents")
def control_chars(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.count_of(c, T.CONTROLS).alias("controls"), T.count_of(c, "[A-Za-z]").alias("latin"))


@query(f"WITH {LINES} SELECT doc_id, count(*) AS n FROM l WHERE regexp_matches(line, '[A-Za-z]') GROUP BY doc_id")
def latin_lines(spark, d):
    return doc_lines(spark, d).where(F.col("line").rlike("[A-Za-z]")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '</?[A-Za-z][^>]{0,24}>')) AS BIGINT) AS tags FROM pages")
def markup_residue(spark, d):
    return table(spark, d, "pages").select("page_id", T.count_of(F.col("html"), T.MARKUP).alias("tags"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages")
def strip_markup(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.col("html")).alias("plain"))


@query(
    """WITH t AS (SELECT page_id, regexp_extract_all(html, '<(/?[A-Za-z][A-Za-z0-9]*)(?:[^>"'']|"[^"]*"|''[^'']*'')*>', 1) AS tags FROM pages)
SELECT page_id, unnest(tags) AS tag, CAST(generate_subscripts(tags, 1) AS BIGINT) AS pos FROM t"""
)
def page_tags(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(T.tag_names(F.col("html"))).alias("at", "tag")).select("page_id", (F.col("at") + 1).cast("long").alias("pos"), "tag")


@query(
    """SELECT page_id, list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)).len()::BIGINT AS links,
trim(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&')) AS body FROM pages"""
)
def html_to_text(spark, d):
    body = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    for k, v in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        body = F.replace(body, F.lit(k), F.lit(v))
    links = F.size(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)))
    return table(spark, d, "pages").select("page_id", links.cast("long").alias("links"), F.trim(body).alias("body"))


@query(f"WITH {LINES}, w AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM l) SELECT doc_id, line_no, line FROM w WHERE line = before")
def adjacent_dups(spark, d):
    return lines.adjacent_duplicates(doc_lines(spark, d))


@query(f"WITH {LINES} SELECT line, arg_min(doc_id, (doc_id, line_no)) AS doc_id, arg_min(line_no, (doc_id, line_no)) AS line_no FROM l GROUP BY line")
def first_occurrence_lines(spark, d):
    return lines.first_occurrences(doc_lines(spark, d), ["line"], ["doc_id", "line_no"])


@query(f"WITH {LINES} SELECT doc_id, line, count(*) AS times, min(line_no) AS first_line FROM l GROUP BY doc_id, line HAVING count(*) >= 2")
def plate_repeat(spark, d):
    return lines.repeated_in_document(doc_lines(spark, d))


@query("SELECT doc_id, CAST(length(replace(text, ')', '')) - length(replace(text, '(', '')) AS BIGINT) AS round, CAST(length(replace(text, ']', '')) - length(replace(text, '[', '')) AS BIGINT) AS square FROM documents")
def bracket_balance(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.pair_difference(c, "(", ")").alias("round"), T.pair_difference(c, "[", "]").alias("square"))


@query(
    """WITH c AS (SELECT page_id, unnest(s) AS ch, generate_subscripts(s, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '[<>]') AS s FROM pages)),
s AS (SELECT *, sum(CASE ch WHEN '<' THEN 1 ELSE -1 END) OVER (PARTITION BY page_id ORDER BY i) AS s FROM c), m AS (SELECT *, least(0, min(s) OVER (PARTITION BY page_id ORDER BY i)) AS m FROM s),
d AS (SELECT *, s - m AS depth, coalesce(lag(s - m) OVER (PARTITION BY page_id ORDER BY i), 0) AS before FROM m)
SELECT page_id, CAST(coalesce(arg_max(depth, i), 0) AS INTEGER) AS depth, CAST(coalesce(max(depth), 0) AS INTEGER) AS deepest, CAST(count(*) FILTER (ch = '>' AND before = 1) AS INTEGER) AS top, CAST(count(*) FILTER (ch = '>' AND before = 0) AS INTEGER) AS stray
FROM pages LEFT JOIN d USING (page_id) GROUP BY page_id"""
)
def bracket_depths(spark, d):
    return table(spark, d, "pages").select("page_id", T.bracket_depth(F.col("html"), "<", ">").alias("b")).select("page_id", "b.*")


@query(
    f"""WITH {LINES}, k AS (SELECT source, doc_id, CASE WHEN line LIKE '%|%' THEN 1 ELSE 0 END AS bars, CASE WHEN regexp_matches(line, '[.!?]$') THEN 1 ELSE 0 END AS ends, CASE WHEN trim(line) = '' THEN 1 ELSE 0 END AS blanks FROM l JOIN documents USING (doc_id))
SELECT source, lang, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(ends) AS BIGINT) AS ends, CAST(sum(blanks) AS BIGINT) AS blanks, count(*) AS n
FROM k JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY ROLLUP (source, lang)"""
)
def structure_rollup(spark, d):
    rows = lines.lines(table(spark, d, "documents").withColumn("key", F.struct("source", "lang")), "key").select("key.source", "key.lang", "line")
    c = F.col("line")
    return rows.rollup("source", "lang").agg(
        F.count_if(c.contains("|")).alias("bars"), F.count_if(c.rlike("[.!?]$")).alias("ends"), F.count_if(F.trim(c) == "").alias("blanks"), F.count("*").alias("n")
    )


@query(
    f"""WITH {LINES}, w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY length(line)) AS k, count(*) OVER (PARTITION BY doc_id) AS n, length(line) AS width FROM l)
SELECT doc_id, CAST(max(width) AS BIGINT) AS widest, CAST(max(width) FILTER (k = n // 2 + 1) AS BIGINT) AS median FROM w GROUP BY doc_id"""
)
def width_stats(spark, d):
    widths = F.sort_array(F.collect_list(F.length("line")))
    rows = doc_lines(spark, d).groupBy("doc_id").agg(widths.alias("w"))
    return rows.select("doc_id", F.array_max("w").cast("long").alias("widest"), F.get("w", F.floor(F.size("w") / 2).cast("int")).cast("long").alias("median"))


@query("SELECT source, round(quantile_cont(length(text), 0.5), 6) AS p50, round(quantile_cont(length(text), 0.95), 6) AS p95, max(length(text))::BIGINT AS longest FROM documents GROUP BY source")
def len_percentiles(spark, d):
    # Lengths are counted first, so no task holds every length of a source.
    counts = table(spark, d, "documents").where("text is not null").groupBy("source", F.length("text").cast("long").alias("n")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("source").orderBy("n"))
    rows = counts.withColumn("upto", upto).withColumn("every", F.sum("k").over(Window.partitionBy("source")))

    def quantile(p):
        at = p * (F.col("every") - 1)
        value = lambda k: F.min(F.when(F.col("upto") > k, F.col("n")))
        return value(F.floor(at)), value(F.ceil(at)), F.first(at - F.floor(at))

    made = {name: quantile(p) for name, p in (("p50", 0.5), ("p95", 0.95))}
    sums = rows.groupBy("source").agg(*(c.alias(f"{name}_{k}") for name, own in made.items() for k, c in enumerate(own)), F.max("n").alias("longest"))
    between = lambda name: F.round(F.col(f"{name}_0") + F.col(f"{name}_2") * (F.col(f"{name}_1") - F.col(f"{name}_0")), 6).alias(name)
    return sums.select("source", between("p50"), between("p95"), "longest")


@query(
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS bits FROM c JOIN t USING (doc_id) GROUP BY doc_id"""
)
def entropy(spark, d):
    # One shuffle: counts by document and character, then by document.
    counts = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    n = F.col("n")
    return counts.groupBy("doc_id").agg(F.round(F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n), 6).alias("bits"))


@query(
    r"""WITH w AS (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM documents)
SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 25"""
)
def topk_terms(spark, d):
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
    return words.groupBy(F.lower("w").alias("term")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(25)


@query(
    f"""WITH {LINES}, s AS (
  SELECT doc_id, line_no, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3 FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
), h AS (SELECT *, min(doc_id) OVER (PARTITION BY l1, l2, l3) AS keeper FROM s WHERE l3 IS NOT NULL), r AS (
  SELECT doc_id, keeper, line_no, line_no - row_number() OVER (PARTITION BY doc_id, keeper ORDER BY line_no) AS run FROM h WHERE doc_id > keeper
) SELECT doc_id, keeper, min(line_no) AS first_line, max(line_no) + 2 AS last_line FROM r GROUP BY doc_id, keeper, run"""
)
def shingle_common_blocks(spark, d):
    return lines.shared_blocks(doc_lines(spark, d), 3)


@query(
    f"""WITH {LINES}, w AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS next FROM l), f AS (
  SELECT *, coalesce(least(length(line), length(next)) >= 10 AND line <> next AND (starts_with(line, next) OR starts_with(next, line)), false) AS fits FROM w
), g AS (SELECT *, sum(CASE WHEN lag_fits THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT *, coalesce(lag(fits) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS lag_fits FROM f)
), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS place FROM g)
SELECT doc_id, line_no, line, next FROM p WHERE fits AND place % 2 = 1"""
)
def prefix_variants(spark, d):
    return lines.prefix_variants(doc_lines(spark, d))


@query(
    """WITH g AS (SELECT DISTINCT item_id, length(text) AS len, substr(text, i, 12) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 10)) AS i FROM benchmark WHERE length(text) >= 12)),
c AS (SELECT DISTINCT doc_id, substr(text, i, 12) AS gram FROM (SELECT doc_id, text, unnest(range(1, length(text) - 10)) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents) WHERE length(text) >= 12)),
z AS (SELECT item_id, count(*) AS size FROM g GROUP BY item_id), h AS (SELECT item_id, doc_id, count(*) AS hits FROM g JOIN c USING (gram) GROUP BY ALL)
SELECT item_id AS line_id, arg_min(doc_id, (-hits, doc_id)) AS item_id, max(hits) AS hits, round(max(hits) / max(size), 9) AS share FROM h JOIN z USING (item_id) GROUP BY item_id"""
)
def gram_containment(spark, d):
    items = table(spark, d, "benchmark").where(F.length("text") >= 12).select(F.col("item_id").alias("line_id"), F.col("text").alias("line"))
    corpus = doc_lines(spark, d).where(F.length("line") >= 12).select(F.col("doc_id").alias("item_id"), F.col("line").alias("text"))
    return joins.containment(items, corpus, 12).withColumn("share", F.round("share", 9))


@query(
    """WITH g AS (SELECT item_id, substr(text, i, 5) AS gram FROM (SELECT item_id, text, unnest(range(1, length(text) - 3)) AS i FROM benchmark))
SELECT item_id, coalesce((SELECT count(*) > count(DISTINCT gram) FROM g WHERE g.item_id = b.item_id), false) AS repeats FROM benchmark b"""
)
def repeated_grams(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.repeats_gram(F.col("text"), 5).alias("repeats"))


@query("SELECT doc_id, sha256(text) AS digest, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_doc FROM documents")
def digest_reuse(spark, d):
    # The first document of a digest is found by an aggregation that starts in the map tasks.
    docs = durable(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest")))
    return docs.join(docs.groupBy("digest").agg(F.min("doc_id").alias("first_doc")), "digest")


@query(
    """SELECT doc_id, CASE WHEN starts_with(text, '<!DOCTYPE') OR starts_with(text, '<html') THEN 'html' WHEN starts_with(text, '{') OR starts_with(text, '[') THEN 'json' WHEN contains(left(text, 200), ' | ') THEN 'table'
WHEN contains(left(text, 200), '%%%') OR contains(left(text, 200), '$$$') THEN 'junk' ELSE 'prose' END AS kind FROM documents"""
)
def signature_sniff(spark, d):
    from glyphmill.sources.identify import TEXT_SIGNATURES, sniff_text

    return table(spark, d, "documents").select("doc_id", sniff_text(F.col("text"), TEXT_SIGNATURES, "prose").alias("kind"))


@query(
    """WITH h AS (SELECT doc_id, trim(regexp_replace(lower(string_split(text, chr(10))[1]), '[^\\p{L}\\p{N}\\s_-]', '', 'g')) AS s FROM documents)
SELECT doc_id, replace(s, ' ', '-') || CASE WHEN n > 1 THEN '-' || (n - 1) ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id) AS n FROM h)""".replace("\\\\", "\\")
)
def anchors(spark, d):
    head = F.trim(F.regexp_replace(F.lower(F.split("text", "\n")[0]), r"[^\p{L}\p{N}\s_-]", ""))
    rows = table(spark, d, "documents").select("doc_id", head.alias("s"))
    return resolve.numbered_within(rows, ["s"], [F.col("doc_id")], "n").select("doc_id", F.concat(F.replace("s", F.lit(" "), F.lit("-")), F.when(F.col("n") > 1, F.concat(F.lit("-"), F.col("n") - 1)).otherwise("")).alias("anchor"))


@query(
    """WITH b AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), d AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM documents)
SELECT w, 'documents' AS missing_from FROM b ANTI JOIN d USING (w) UNION ALL SELECT w, 'benchmark' FROM d ANTI JOIN b USING (w)"""
)
def vocabulary_coverage(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w")).select(F.lower("w").alias("w")).distinct()
    return joins.coverage(words("benchmark"), words("documents"), ["w"]).replace({"covered": "documents", "expected": "benchmark"}, subset="missing_from")


@query(
    f"""WITH {LINES}, a AS (SELECT line, count(*) AS want FROM l GROUP BY line), b AS (SELECT line, count(DISTINCT doc_id) AS got FROM l GROUP BY line) SELECT line, want, got FROM a JOIN b USING (line) WHERE got < want"""
)
def line_conservation(spark, d):
    rows = doc_lines(spark, d)
    return ledger.conservation(rows, rows.select("doc_id", "line").distinct())


@query(
    """WITH r AS (SELECT doc_id, unnest(range(0, length(text), 64)) AS k, text FROM documents) SELECT doc_id, CAST(k // 64 AS BIGINT) AS record, substr(text, CAST(k + 1 AS BIGINT), 16) AS head, substr(text, CAST(k + 17 AS BIGINT), 48) AS body FROM r"""
)
def fixed_records(spark, d):
    # One pass over each text; substring() at growing places would start from the front each time.
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("(?s)(.{1,64})"), 1)).alias("record", "r"))
    return rows.select("doc_id", F.col("record").cast("long").alias("record"), F.substring("r", 1, 16).alias("head"), F.substring("r", 17, 48).alias("body"))


@query(
    """WITH c AS (SELECT doc_id, ch, CAST(i AS BIGINT) AS i FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents)), m AS (SELECT * FROM c WHERE ch = '|'), b AS (SELECT * FROM c WHERE ch = chr(10))
SELECT m.doc_id, m.i AS place, 1 + (SELECT count(*) FROM b WHERE b.doc_id = m.doc_id AND b.i < m.i) AS line_no FROM m"""
)
def offset_lines(spark, d):
    """The line of every bar, by its place in the text: an as-of join with the places where lines start."""
    rows = doc_lines(spark, d).withColumn("n", F.length("line") + 1)
    rows = rows.withColumn("start", F.sum("n").over(lines.in_order().rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") + 1)
    # Pieces between bars, so that no text is scanned from its front for each bar.
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", r"\|")).alias("k", "piece"))
    place = F.sum(F.length("piece") + 1).over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    last = F.lead("k").over(Window.partitionBy("doc_id").orderBy("k")).isNull()
    bars = pieces.select("doc_id", place.alias("place"), last.alias("last")).where("not last").drop("last")
    starts = rows.select("doc_id", F.col("start").alias("place"), "line_no")
    return joins.asof(bars, starts, "doc_id", "place", "line_no")


@query("SELECT conv_id, turn, role, CAST(length(text) AS BIGINT) AS n FROM conversations WHERE role <> 'system'")
def json_commands(spark, d):
    """Conversations as nested JSON and back: commands by code, as script documents hold them."""
    own = F.struct("turn", F.when(F.col("role") == "system", 0).otherwise(401).alias("code"), F.struct("role", "text").alias("parameters"))
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(own)).alias("doc"))
    schema = "array<struct<turn:long,code:int,parameters:struct<role:string,text:string>>>"
    rows = docs.select("conv_id", F.explode(F.from_json("doc", schema)).alias("c")).where("c.code = 401")
    return rows.select("conv_id", "c.turn", "c.parameters.role", F.length("c.parameters.text").cast("long").alias("n"))
