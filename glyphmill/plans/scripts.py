"""Markup, tokens, tables of codes and signatures on the driver's texts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphmill.functions import codecs, lexers
from glyphmill.functions import text as T
from glyphmill.operators import dedupe, lines
from glyphmill.plans.registry import LINES, query, table
from glyphmill.sources import archives, identify


def doc_lines(spark, d):
    return lines.lines(table(spark, d, "documents"))


@query(r"""SELECT page_id, regexp_replace(replace(replace(html, '<a href=', '<ruby='), '</a>', '</ruby>'), '<ruby=[^>]*>(.*?)</ruby>', '\1', 'g') AS base FROM pages""")
def ruby_bases(spark, d):
    """Links as readings over their text."""
    marked = F.replace(F.replace("html", F.lit("<a href="), F.lit("<ruby=")), F.lit("</a>"), F.lit("</ruby>"))
    return table(spark, d, "pages").select("page_id", T.keep_ruby_base(marked).alias("base"))


@query(r"""SELECT doc_id, regexp_replace(replace(text, ', ', '\n '), '(\\n)+[ \x{3000}]*', '', 'g') AS text FROM documents""")
def soft_breaks(spark, d):
    """Commas as literal break marks with an indent after them."""
    return table(spark, d, "documents").select("doc_id", T.merge_soft_breaks(F.replace("text", F.lit(", "), F.lit("\\n "))).alias("text"))


@query(
    f"""WITH {LINES}, f AS (SELECT *, starts_with(line, 'The') AS fence FROM l), n AS (SELECT *, sum(fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM f) SELECT doc_id, line_no, NOT fence AND n % 2 = 1 AS inside FROM n"""
)
def fenced_lines(spark, d):
    return lines.fence_state(doc_lines(spark, d), "^The").select("doc_id", "line_no", "inside")


@query(
    f"""WITH {LINES}, t AS (SELECT doc_id, line_no * 2 AS line_no, line FROM l UNION ALL SELECT doc_id, line_no * 2 + 1, replace(line, ' the ', ' @t ') FROM l WHERE contains(line, ' the ')),
w AS (SELECT *, regexp_matches(line, '[@%{{]') AS m, replace(line, ' @t ', ' the ') AS r FROM t), n AS (SELECT *, lag(r) OVER o AS r1, lag(m) OVER o AS m1, lead(r) OVER o AS r2, lead(m) OVER o AS m2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, line FROM n WHERE NOT (NOT m AND (coalesce(r1 = r AND m1, false) OR coalesce(r2 = r AND m2, false)))"""
)
def macro_twins(spark, d):
    """Each line with ' the ' twice, once as a macro; of such twins the macro stays."""
    rows = doc_lines(spark, d)
    both = rows.select("doc_id", (F.col("line_no") * 2).alias("line_no"), "line").unionByName(
        rows.where(F.col("line").contains(" the ")).select("doc_id", (F.col("line_no") * 2 + 1).alias("line_no"), F.replace("line", F.lit(" the "), F.lit(" @t ")).alias("line"))
    )
    return dedupe.prefer_macro_twins(both, F.replace("line", F.lit(" @t "), F.lit(" the ")))


@query(
    f"""WITH {LINES}, h AS (SELECT *, split_part(line, ',', 1) AS head FROM l), f AS (SELECT *, contains(line, ',') AND ends_with(line, '.') AND length(head) BETWEEN 1 AND 12 AS fits FROM h)
SELECT doc_id, line_no, CASE WHEN fits THEN head END AS name, CASE WHEN fits THEN substr(line, length(head) + 1) ELSE line END AS text, length(head) BETWEEN 1 AND 6 AND regexp_matches(head, '^[A-Z][a-z]*$') AS named FROM f"""
)
def name_splits(spark, d):
    """A short head before the first comma of a line that ends with a stop, as a speaker's name would stand."""
    rows = doc_lines(spark, d).withColumn("s", T.split_name(F.col("line"), ",", ".", 12))
    return rows.select("doc_id", "line_no", "s.name", "s.text", T.looks_like_name(F.substring_index("line", ",", 1), "^[A-Z][a-z]*$", 6).alias("named"))


@query("SELECT conv_id, turn, CASE WHEN role = 'user' AND NOT (starts_with(text, '<') AND ends_with(text, '>')) THEN '<' || text || '>' WHEN role = 'assistant' AND NOT (starts_with(text, '(') AND ends_with(text, ')')) THEN '(' || text || ')' ELSE text END AS text FROM conversations")
def channel_quotes(spark, d):
    marks = {"user": ("<", ">"), "assistant": ("(", ")")}
    return table(spark, d, "conversations").select("conv_id", "turn", T.quoted(F.col("text"), F.col("role"), marks).alias("text"))


@query(
    """WITH w AS (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: length(x)) AS n FROM benchmark) SELECT item_id, array_to_string(list_transform(n, lambda k: CASE WHEN k < 8 THEN 'abcdefgh'[k + 1] ELSE printf('<%04X>', k) END), '') AS decoded FROM w"""
)
def code_tables(spark, d):
    """Lengths of words as codes of a table of eight characters."""
    codes = F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), F.length)
    return table(spark, d, "benchmark").select("item_id", codecs.decode_table(codes, F.lit("abcdefgh")).alias("decoded"))


_AT_START = [s for s in identify.SIGNATURES if s.offset == 0]
_KINDS = ", ".join(f"({k}, '{s.label}')" for k, s in enumerate(_AT_START))


@query(f"SELECT doc_id, kind FROM documents LEFT JOIN (VALUES {_KINDS}) v(k, kind) ON k = doc_id % {len(_AT_START) + 1} AND text IS NOT NULL")
def byte_signatures(spark, d):
    """What each text is told to be behind the bytes of a signature in turn; one in so many stands behind a blank only. Signatures without a fixed place are sought in the texts, too."""
    magic = F.element_at(F.array(*[F.unhex(F.lit(s.magic)) for s in _AT_START], F.unhex(F.lit("20"))), (F.col("doc_id") % (len(_AT_START) + 1) + 1).cast("int"))
    files = table(spark, d, "documents").select("doc_id", F.concat(magic, F.encode("text", "UTF-8")).alias("content"))
    return identify.identify(files).select("doc_id", "kind")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(ceil(l_quantity / 16) * 16 AS BIGINT) AS padded FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(sum(padded) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, padded ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM s"""
)
def member_offsets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.struct("l_linenumber", "l_partkey", F.ceil(F.col("l_quantity") / 16)).alias("pos"))
    return archives.aligned_offsets(rows, 16, "l_orderkey", "pos", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "off")


@query(
    """WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '<([^<>]*)>', 1), lambda x: regexp_extract(trim(x), '^(\\S*)', 1)) AS names FROM pages), n AS (SELECT page_id, unnest(names) AS name FROM t) SELECT page_id, name, count(*) AS n FROM n GROUP BY ALL""".replace("\\\\", "\\")
)
def bracket_tags(spark, d):
    """Markup as a bracket-tag script."""
    rows = table(spark, d, "pages").select("page_id", F.translate(F.replace(F.replace("html", F.lit("["), F.lit("(")), F.lit("]"), F.lit(")")), "<>", "[]").alias("script"))
    tokens = rows.lateralJoin(lexers.TagTokens(F.col("script").outer())).where("kind = 'tag'")
    return tokens.groupBy("page_id", "name").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT item_id, unnest(regexp_extract_all(text, '[\\x20-\\x7e\\t]{8,}')) AS run FROM benchmark) SELECT item_id, count(*) AS runs, max(length(run))::BIGINT AS longest FROM r GROUP BY item_id""")
def printable_runs(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("content"))
    runs = rows.lateralJoin(lexers.PrintableRuns(F.col("content").outer(), F.lit(8))).where("encoding = 'ascii'")
    return runs.groupBy("item_id").agg(F.count("*").alias("runs"), F.max(F.length("text")).cast("long").alias("longest"))


@query(
    """WITH e AS (SELECT doc_id, lang, source, text FROM documents), k AS (SELECT lang, source, max(length(text)) AS n FROM e GROUP BY ALL) SELECT lang, source, n::BIGINT AS longest, rank() OVER (PARTITION BY lang ORDER BY n DESC, source) AS place FROM k"""
)
def longest_by_source(spark, d):
    own = table(spark, d, "documents").groupBy("lang", "source").agg(F.max(F.length("text")).cast("long").alias("longest"))
    return own.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("longest"), "source")).cast("long"))
