"""Event streams of `conversations` to segments, pages and speakers.

A turn is an event stream of its own: each line is a text event and ends a segment, and the
end of the turn clears the page.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import assemble, lines, similarity
from glyphmill.plans.registry import query, table


def turn_events(spark, d):
    """doc_id (conv_id), pos, kind, text: each line a text and a wait, each turn a clear."""
    own = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    kinds = F.array(F.struct(F.lit(0).alias("k"), F.lit("text").alias("kind"), F.col("line").alias("text")), F.struct(F.lit(1).alias("k"), F.lit("wait").alias("kind"), F.lit("").alias("text")))
    rows = own.select("doc_id", "turn", "at", F.explode(kinds).alias("e")).select("doc_id", (F.col("turn") * 1_000_000 + F.col("at") * 2 + F.col("e.k")).alias("pos"), "e.kind", "e.text")
    ends = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") * 1_000_000 + 999_999).alias("pos"), F.lit("clear").alias("kind"), F.lit("").alias("text"))
    return rows.unionByName(ends)


_EVENTS = """t AS (SELECT conv_id AS doc_id, turn, unnest(s) AS text, generate_subscripts(s, 1) AS k FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS s FROM conversations)),
g AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY turn) AS page, row_number() OVER (PARTITION BY doc_id, turn ORDER BY k) AS segment, text, turn * 1000000 + (k - 1) * 2 AS first_pos FROM t WHERE text <> '')"""
_DUAL = f"""{_EVENTS}, m AS (SELECT doc_id, page, segment, 'segment' AS kind, text FROM g UNION ALL SELECT doc_id, page, max(segment) + 1, 'page', string_agg(text, '' ORDER BY segment) FROM g GROUP BY doc_id, page HAVING count(*) > 1),
dual AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, segment) AS line_no, kind, page, text FROM m)"""


@query(f"WITH {_EVENTS} SELECT * FROM g")
def page_segments(spark, d):
    return assemble.segments(turn_events(spark, d), assemble.Layout())


@query(f"WITH {_DUAL} SELECT * FROM dual")
def dual_layout(spark, d):
    return assemble.dual_lines(assemble.segments(turn_events(spark, d), assemble.Layout()))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS page, count(*) AS turns FROM conversations GROUP BY conv_id")
def page_merge(spark, d):
    own = F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(own["s"], "\n").alias("page"), F.count("*").alias("turns"))


@query(
    """WITH w AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS b FROM conversations), g AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM w)
SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, run"""
)
def speaker_runs(spark, d):
    rows = table(spark, d, "conversations").withColumn("b", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = lines.islands(rows, ~F.coalesce(F.col("role") == F.col("b"), F.lit(False)), "conv_id", "turn", "run")
    own = F.sort_array(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.array_join(own["text"], "\n").alias("text"))


@query(
    """WITH w AS (SELECT conv_id, turn, role, coalesce(lead(role, 1) OVER o, '') AS n1, coalesce(lead(role, 2) OVER o, '') AS n2, coalesce(lead(role, 3) OVER o, '') AS n3, coalesce(lead(role, 4) OVER o, '') AS n4 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, CASE WHEN n1 <> '' AND n1 <> 'system' THEN n1 WHEN n2 <> '' AND n2 <> 'system' THEN n2 WHEN n3 <> '' AND n3 <> 'system' THEN n3 WHEN n4 <> '' AND n4 <> 'system' THEN n4 END AS next_speaker FROM w"""
)
def lookahead_name(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return lines.look_ahead(rows, F.when(F.col("role") != "system", F.col("role")), "next_speaker", 4, "conv_id", "turn")


@query(
    f"""WITH RECURSIVE {_DUAL}, b(doc_id, line_no, place, rest, parts) AS (SELECT doc_id, line_no, line_no, text, 0 FROM dual WHERE text <> '' UNION ALL
SELECT b.doc_id, b.line_no, p.line_no, left(b.rest, length(b.rest) - length(p.text)), b.parts + 1 FROM b JOIN dual p ON p.doc_id = b.doc_id AND p.line_no = b.place - 1 AND p.text <> '' AND b.rest <> '' AND ends_with(b.rest, p.text))
SELECT doc_id, line_no, CAST(parts AS BIGINT) AS parts FROM b WHERE rest = '' AND parts >= 2"""
)
def concat_candidates(spark, d):
    rows = dual_layout(spark, d)
    return lines.concatenations(rows, "doc_id", "line_no", "text").select("doc_id", "line_no", "parts")


@query(
    f"""WITH {_DUAL}, p AS (SELECT doc_id, page, list(line_no ORDER BY line_no) FILTER (kind = 'segment') AS s, max(line_no) FILTER (kind = 'page') AS m FROM dual GROUP BY ALL HAVING m IS NOT NULL),
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s, m) - 1 AS page, len(s) AS n FROM p)
SELECT doc_id, CAST(page AS INTEGER) AS page, 'merged line not after the last segment' AS error FROM q WHERE page % 3 = 1"""
)
def pagemap_validate(spark, d):
    """Maps of the dual lines; every third page is given a wrong merged line and must be found."""
    segs = assemble.segments(turn_events(spark, d), assemble.Layout())
    rows = assemble.dual_lines(segs).withColumnRenamed("text", "line")
    maps = assemble.page_maps(segs).select("doc_id", F.from_json("map", assemble.PAGE_MAP).alias("m"))
    spoilt = F.transform("m.pages", lambda p, i: F.when(i % 3 == 1, p.withField("merged", p["merged"] - 1)).otherwise(p))
    maps = maps.select("doc_id", F.to_json(F.struct(spoilt.alias("pages"))).alias("map"))
    return assemble.validate_page_maps(maps, rows)


@query(
    """WITH w AS (SELECT conv_id, turn, text, regexp_extract(text, '^([A-Za-z]+)', 1) AS label FROM conversations), good AS (SELECT DISTINCT label FROM w WHERE label <> '' AND text LIKE '%?%')
SELECT conv_id, turn, label, label IN (SELECT label FROM good) AS asks FROM w WHERE label <> ''"""
)
def label_two_pass(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.regexp_extract("text", "^([A-Za-z]+)", 1).alias("label")).where("label <> ''")
    good = rows.where(F.col("text").contains("?")).select("label").distinct().withColumn("asks", F.lit(True))
    return rows.join(good, "label", "left").select("conv_id", "turn", "label", F.coalesce("asks", F.lit(False)).alias("asks"))


@query("SELECT conv_id, turn, replace(replace(text, ' the ', ' [' || role || '] '), ' the', '{the}') AS filled FROM conversations")
def macro_fill(spark, d):
    rows = table(spark, d, "conversations").withColumn("marked", F.replace("text", F.lit(" the "), F.concat(F.lit(" ["), F.col("role"), F.lit("] "))))
    return rows.select("conv_id", "turn", T.substitute(F.col("marked"), {" the": "{the}"}).alias("filled"))


@query(
    """WITH p AS (SELECT conv_id, turn, string_split(text, ', ') AS s, role FROM conversations)
SELECT conv_id, turn, s[1] || coalesce(' <' || role || '> ' || s[2], '') || coalesce(' <' || turn || '> ' || s[3], '') || coalesce(array_to_string(s[4:], ''), '') AS filled FROM p"""
)
def slot_fill(spark, d):
    values = F.array(F.concat(F.lit(" <"), F.col("role"), F.lit("> ")), F.concat(F.lit(" <"), F.col("turn").cast("string"), F.lit("> ")))
    return table(spark, d, "conversations").select("conv_id", "turn", T.fill_slots(F.col("text"), values, ", ").alias("filled"))


@query()
def similarity_adjacent(spark, d):
    return similarity.similar_neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text", 0.3).select("conv_id", "turn", F.round("ratio", 9).alias("ratio"))
