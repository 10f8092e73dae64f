"""Layers, nested blocks, chains of records and conditions, on the driver's tables."""

import hashlib

from pyspark.sql import functions as F

from glyphmill.operators import anchors, blocks, graph, inline, intervals, joins, layouts, lines, names, resolve, variants
from glyphmill.plans.registry import query, table
from glyphmill.sources import archives, identify, nested, records, streams


@query(
    """WITH r AS (SELECT l_suppkey, datediff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS lo, CAST(l_quantity AS BIGINT) AS n, l_extendedprice AS price, l_orderkey * 8 + l_linenumber AS line FROM lineitem),
d AS (SELECT l_suppkey, unnest(range(lo, lo + n)) AS day, price, line FROM r), w AS (SELECT l_suppkey, day, arg_max(line, (price, line)) AS line FROM d GROUP BY l_suppkey, day),
g AS (SELECT *, day - row_number() OVER (PARTITION BY l_suppkey, line ORDER BY day) AS run FROM w)
SELECT l_suppkey, min(day) AS first_day, max(day) + 1 AS end_day, line FROM g GROUP BY l_suppkey, line, run"""
)
def dearest_open_line(spark, d):
    """Each line is open for as many days as its quantity from its shipping date on: which is a supplier's dearest open one, from when to when."""
    lines = table(spark, d, "lineitem")
    first = F.unix_date(F.col("l_shipdate").cast("date")).cast("long")
    ranges = lines.select("l_suppkey", first.alias("first_day"), (first + F.col("l_quantity").cast("long")).alias("end_day"), "l_extendedprice", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line"))
    return intervals.overlay(ranges, "l_suppkey", "first_day", "end_day", "l_extendedprice", "line")


#: Words whose blocks are skipped.
_SKIPPED = ("the", "de", "la", "der", "a")


@query(
    f"""WITH RECURSIVE x AS (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
y AS (SELECT doc_id, line_no, repeat(' ', 2 * (length(l) % 5)) || l AS l FROM x WHERE trim(l, ' ' || chr(9) || chr(13)) <> ''),
n AS (SELECT doc_id, line_no, length(regexp_extract(l, '^[ \\t]*')) + 3 * length(replace(regexp_extract(l, '^[ \\t]*'), ' ', '')) AS indent, trim(l, ' ' || chr(9) || chr(13)) AS line FROM y),
p AS (SELECT a.doc_id, a.line_no, any_value(a.indent) AS indent, any_value(a.line) AS line, max(b.line_no) FILTER (b.line_no < a.line_no AND b.indent < a.indent) AS parent, min(b.line_no) FILTER (b.line_no > a.line_no AND b.indent <= a.indent) AS after
  FROM n a JOIN n b ON a.doc_id = b.doc_id GROUP BY a.doc_id, a.line_no),
e AS (SELECT p.doc_id, p.line_no, max(n.line_no) AS block_end FROM p JOIN n ON n.doc_id = p.doc_id AND n.line_no < coalesce(p.after, 1000000000) GROUP BY p.doc_id, p.line_no),
t AS (SELECT *, 0 AS depth, regexp_extract(line, '^[A-Za-z0-9_]*') IN {_SKIPPED} AS skipped FROM p WHERE parent IS NULL
  UNION ALL SELECT p.*, t.depth + 1, t.skipped OR regexp_extract(p.line, '^[A-Za-z0-9_]*') IN {_SKIPPED} FROM t JOIN p ON p.doc_id = t.doc_id AND p.parent = t.line_no)
SELECT t.doc_id, t.line_no, CAST(indent AS INTEGER) AS indent, line, parent, CAST(depth AS INTEGER) AS depth, block_end, skipped FROM t JOIN e ON t.doc_id = e.doc_id AND t.line_no = e.line_no"""
)
def indent_blocks(spark, d):
    """Lines with blanks in front by their length are a script; blocks below some words are skipped."""
    indented = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.repeat(F.lit(" "), 2 * (F.length(x) % 5)), x))
    scripts = table(spark, d, "documents").select("doc_id", F.array_join(indented, "\n").alias("text"))
    return blocks.indent_blocks(scripts, _SKIPPED, blocks.Signs(comment="", quotes="", opening="", closing="")).drop("last_no")


_DAMAGE = b"\xff" * 5


@query(
    f"""WITH x AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS i FROM (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)) WHERE line <> ''),
y AS (SELECT *, CAST(4 + strlen(line) AS BIGINT) AS size, CASE WHEN i % 7 = 3 THEN 5 ELSE 0 END AS lost FROM x),
z AS (SELECT *, CAST(sum(size + lost) OVER (PARTITION BY doc_id ORDER BY i) - size - lost AS BIGINT) AS place FROM y)
SELECT doc_id, 'record' AS kind, place, size, md5(line) AS payload FROM z UNION ALL SELECT doc_id, 'skipped', place + size, 5, '{hashlib.md5(_DAMAGE).hexdigest()}' FROM z WHERE lost > 0"""
)
def record_chains(spark, d):
    """Each document's lines as records behind their lengths, with foreign bytes behind some of them: what a reader of chains gets back."""
    size = lambda x: F.lpad(F.hex(F.octet_length(x)), 8, "0")
    little = lambda h: F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1)))
    record = lambda x, i: F.concat(little(size(x)), F.hex(F.encode(x, "UTF-8")), F.when(i % 7 == 3, _DAMAGE.hex()).otherwise(""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x != "")
    files = table(spark, d, "documents").select("doc_id", F.unhex(F.array_join(F.transform(lines, record), "")).alias("content"))
    found = records.record_chains(files, records.Prefix(high=1 << 24), key="doc_id", inner=True)
    return found.withColumn("payload", F.md5("payload"))


_SCRIPTS = """n AS (SELECT c_nationkey AS script, c_custkey AS pos, CASE c_custkey % 4 WHEN 1 THEN 'jump' WHEN 2 THEN 'choose' WHEN 3 THEN CASE WHEN c_custkey % 16 = 3 THEN 'stop' END END AS kind,
  CASE WHEN c_custkey % 3 = 0 THEN 'L' || c_custkey % 97 END AS label, 'L' || (c_custkey * 5) % 110 AS target,
  CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN c_mktsegment WHEN 2 THEN 'BUILDING' ELSE CAST(c_nationkey AS VARCHAR) END AS lhs,
  CASE c_custkey % 5 WHEN 0 THEN '==' WHEN 1 THEN '!=' WHEN 2 THEN '<' WHEN 3 THEN '>=' END AS op, CASE WHEN c_custkey % 11 = 5 THEN 'MACHINERY' ELSE '10' END AS rhs FROM customer),
v AS (SELECT *, coalesce(TRY_CAST(lhs AS BIGINT), CASE lhs WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 12 END) AS a, coalesce(TRY_CAST(rhs AS BIGINT), CASE rhs WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 12 END) AS b FROM n),
h AS (SELECT *, lead(pos) OVER (PARTITION BY script ORDER BY pos) AS after, CASE WHEN op IS NULL THEN CASE WHEN lhs IS NULL THEN true ELSE a <> 0 END ELSE CASE op WHEN '==' THEN a = b WHEN '!=' THEN a <> b WHEN '<' THEN a < b WHEN '>=' THEN a >= b END END AS holds FROM v),
l AS (SELECT script, label, min(pos) AS aim FROM h WHERE label IS NOT NULL GROUP BY script, label),
j AS (SELECT h.script, h.pos, h.target, l.aim FROM h LEFT JOIN l ON l.script = h.script AND l.label = h.target WHERE kind IN ('jump', 'choose') AND coalesce(holds, true)),
e AS (SELECT script, pos, after AS dst FROM h WHERE after IS NOT NULL AND NOT (coalesce(kind, '') IN ('jump', 'stop') AND coalesce(holds, false)) UNION SELECT script, pos, aim FROM j WHERE aim IS NOT NULL),
r(script, pos) AS (SELECT script, min(pos) FROM n GROUP BY script UNION SELECT e.script, e.dst FROM r JOIN e ON e.script = r.script AND e.pos = r.pos)"""


def _scripts(spark, d):
    """The customers of a nation as a script of jumps, choices and stops; what is to be reached, and what must be missing."""
    k = F.col("c_custkey")
    pick = lambda by, *xs: F.get(F.array(*(F.lit(x) for x in xs)), (k % by).cast("int"))
    nodes = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("script"), k.alias("pos"),
        F.when(k % 4 == 1, "jump").when(k % 4 == 2, "choose").when(k % 16 == 3, "stop").alias("kind"),
        F.when(k % 3 == 0, F.concat(F.lit("L"), k % 97)).alias("label"), F.concat(F.lit("L"), (k * 5) % 110).alias("target"),
        F.when(k % 7 == 0, None).when(k % 7 == 1, F.col("c_mktsegment")).when(k % 7 == 2, "BUILDING").otherwise(F.col("c_nationkey").cast("string")).alias("lhs"),
        pick(5, "==", "!=", "<", ">=", None).alias("op"), F.when(k % 11 == 5, "MACHINERY").otherwise("10").alias("rhs"),
    )
    constants = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 12)], "name string, value long")
    return graph.reachable_if(nodes, constants, nodes.groupBy("script").agg(F.min("pos").alias("pos")))


@query(f"WITH RECURSIVE {_SCRIPTS} SELECT script, pos FROM r")
def conditional_reach(spark, d):
    return _scripts(spark, d)[0]


@query(f"WITH RECURSIVE {_SCRIPTS} SELECT j.script, j.pos, j.target FROM j JOIN r ON r.script = j.script AND r.pos = j.pos WHERE aim IS NULL")
def missing_labels(spark, d):
    return _scripts(spark, d)[1]


@query()
def anchored_blocks(spark, d):
    """Each document beside the smallest one that holds one of its lines of ten characters or more: the blocks of lines that both have."""
    rows = lines.lines(table(spark, d, "documents").where("doc_id IS NOT NULL"))
    known = rows.where(F.length("line") >= 10).groupBy(F.md5("line").alias("h"), "doc_id").agg(F.count("*").alias("k"))
    first = known.groupBy("h").agg(F.min("doc_id").alias("first"))
    pairs = known.join(first, "h").where("first < doc_id").groupBy(F.col("doc_id").alias("b")).agg(F.min("first").alias("a"))
    return anchors.matching_blocks(rows, pairs)


#: Literal, name and tail: none of the names holds another rule's literal.
_NAMES = [("ka", "kaleto", None), ("mi", "MI-", "ra"), ("mira", "Mira", ""), ("zo", "zo", None), ("q", "", None)]


@query(
    """WITH x AS (SELECT doc_id, text, replace(replace(replace(text, 'kaleto', chr(1)), 'ka', 'kaleto'), chr(1), 'kaleto') AS a FROM documents),
y AS (SELECT *, replace(replace(replace(replace(a, 'mira', chr(1)), 'mi', 'MI-'), chr(1), 'Mira'), 'q', '') AS b FROM x)
SELECT doc_id, md5(b) AS names, CAST((length(replace(text, 'kaleto', chr(1))) - length(replace(replace(text, 'kaleto', chr(1)), 'ka', ''))) / 2 + (length(text) - length(replace(text, 'mi', ''))) / 2 + length(text) - length(replace(text, 'q', '')) AS BIGINT) AS changed FROM y"""
)
def full_names(spark, d):
    """Some beginnings of words as names to be written out, in one pass over each text."""
    rules = spark.createDataFrame(_NAMES, "literal string, name string, tail string")
    rows = names.full_names(table(spark, d, "documents").select("doc_id", "text"), rules)
    return rows.select("doc_id", F.md5("text").alias("names"), "changed")


@query()
def variant_rows(spark, d):
    """Every third line as it might come out of two versions in one row; the rest as it is."""
    rows = lines.lines(table(spark, d, "documents"))
    twice = F.concat(F.lit("「"), "line", F.lit("「"), F.regexp_replace("line", "(?<=.{20})[aeiou]", ""), F.lit("」"))
    rows = rows.withColumn("line", F.when((F.col("line_no") % 3 == 0) & (F.length("line") >= 12), twice).otherwise(F.col("line")))
    return variants.repaired(rows, ["mi", "zo"], "mira")


@query()
def layout_cover(spark, d):
    """Orders as pages of parts: orders that share no part and leave none out that fits, and orders that others make up."""
    return layouts.cover(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").alias("atom"))).withColumn("parts", F.array_join("parts", ","))


@query(
    """WITH m AS (SELECT user_id, ts, event_type AS kind FROM events WHERE event_type IN ('signup', 'purchase')), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type NOT IN ('signup', 'purchase'))
SELECT e.event_id, e.user_id, CASE WHEN m.ts + INTERVAL 12 HOUR >= e.ts THEN m.kind END AS state FROM e ASOF LEFT JOIN m ON e.user_id = m.user_id AND e.ts >= m.ts"""
)
def asof_within(spark, d):
    events = table(spark, d, "events")
    sets = F.col("event_type").isin("signup", "purchase")
    right = events.where(sets).select("user_id", "ts", F.col("event_type").alias("state"))
    left = events.where(~sets).select("event_id", "user_id", "ts")
    return joins.asof(left, right, "user_id", "ts", "state", within="INTERVAL 12 HOUR").select("event_id", "user_id", "state")


def _transcribed(spark, d):
    people = table(spark, d, "customer").where("c_acctbal > 1000").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("text"))
    return resolve.transcribed(table(spark, d, "orders").select("o_orderkey", "o_custkey"), people, "o_custkey")


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, '[missing ' || o_custkey || ']') AS text, c_name IS NULL AS missing FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 1000")
def transcribed_orders(spark, d):
    """Orders with the names of their customers, of whom only some are known."""
    return _transcribed(spark, d)[0]


@query("SELECT o_custkey, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 1000 WHERE c_name IS NULL GROUP BY o_custkey")
def transcript_misses(spark, d):
    return _transcribed(spark, d)[1]


@query(
    """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN NULL WHEN regexp_matches(o_orderpriority, '^[45]-') THEN 'system' WHEN regexp_matches(o_orderstatus, 'P') THEN 'debug'
WHEN regexp_matches(o_orderpriority, 'MED') THEN 'menu' END AS reason FROM orders"""
)
def excluded_options(spark, d):
    """Orders as options that are left out by pattern, each with the first reason; dear ones stay in any case."""
    rules = [("o_orderpriority", "^[45]-", "system"), ("o_orderstatus", "P", "debug"), ("o_orderpriority", "MED", "menu")]
    return resolve.excluded(table(spark, d, "orders"), rules, "o_totalprice >= 400000").select("o_orderkey", "reason")


_UTF8 = streams.Widths(leads=((0xC2, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xF4, 4)), dropped={ord("."): 1}, controls={ord("\n"): 0, ord(","): 1})


@query(
    r"""WITH t AS (SELECT doc_id, unnest(s) AS tok, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[^.,\n]|\..|\n|,.|[.,]$') AS s FROM documents)),
k AS (SELECT *, tok[1] IN (',', chr(10)) OR tok = '.' AS ctl, starts_with(tok, '.') AS gone FROM t), g AS (SELECT *, coalesce(sum(ctl::INTEGER) OVER w, 0) AS seq, coalesce(sum(strlen(tok)) OVER w, 0) AS o FROM k
WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, CAST(seq AS INTEGER) AS seq, CAST(min(o) AS BIGINT) AS place, md5(coalesce(string_agg(tok, '' ORDER BY i) FILTER (NOT ctl AND NOT gone), '')) AS text, hex(encode(max(tok[1]) FILTER (ctl))) AS control,
hex(encode(max(tok[2:]) FILTER (ctl))) AS operands, coalesce(bool_or(ctl AND tok IN ('.', ',')), false) AS cut FROM g GROUP BY doc_id, seq"""
)
def mixed_streams(spark, d):
    """Texts in UTF-8 as streams: a stop takes the next byte away, a comma has one byte of operands, and both it and a line's end close a run."""
    rows = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    runs = streams.mixed_width(rows, _UTF8, "doc_id")
    return runs.select("doc_id", "seq", "place", F.md5("text").alias("text"), F.hex("control").alias("control"), F.hex("operands").alias("operands"), F.col("error").isNotNull().alias("cut"))


_MAGIC = "41524330"


def _archive(names, datas):
    """Hex of an archive: signature, count, then names of 32 bytes with places and sizes, then the members. From arrays of names and of hex digits."""
    little = lambda n: F.concat(*(F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1)))
    zero = F.struct(F.lit("").alias("head"), (8 + 40 * F.size(names)).cast("long").alias("at"))
    entry = lambda a, m: F.concat(a["head"], F.rpad(F.hex(F.encode(m["n"], "UTF-8")), 64, "0"), little(a["at"]), little(F.length(m["d"]) / 2))
    step = lambda a, m: F.struct(entry(a, m).alias("head"), (a["at"] + F.length(m["d"]) / 2).cast("long").alias("at"))
    members = F.zip_with(names, datas, lambda n, d: F.struct(n.alias("n"), d.alias("d")))
    return F.concat(F.lit(_MAGIC), little(F.size(names)), F.aggregate(members, zero, step)["head"], F.array_join(datas, ""))


@query(
    """WITH l AS (SELECT doc_id, doc_id % 3 AS d, unnest(s) AS line, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents))
SELECT doc_id || repeat('!inner', d) AS path, CAST(i AS VARCHAR) AS name, CAST(d + 1 AS INTEGER) AS depth, md5(line) AS data FROM l
UNION ALL SELECT doc_id || repeat('!inner', k), 'note', CAST(k + 1 AS INTEGER), md5(coalesce(source, '')) FROM (SELECT doc_id, source, unnest(range(0, doc_id % 3)) AS k FROM documents WHERE text IS NOT NULL)"""
)
def nested_members(spark, d):
    """Each document's lines as members of an archive, which lies in up to two others beside a note: all that comes out again."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.split("text", "\n", -1).alias("s"))
    hexed = lambda c: F.hex(F.encode(c, "UTF-8"))
    docs = docs.withColumn("h", _archive(F.transform("s", lambda x, i: (i + 1).cast("string")), F.transform("s", hexed)))
    for level in (1, 2):
        outer = _archive(F.array(F.lit("note"), F.lit("inner")), F.array(hexed(F.col("source")), F.col("h")))
        docs = docs.withColumn("h", F.when(F.col("doc_id") % 3 >= level, outer).otherwise(F.col("h")))
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.unhex("h").alias("content"))
    return nested.descend(files, [(_MAGIC, archives.LAYOUTS["name-offset-size"])]).select("path", "name", "depth", F.md5("data").alias("data"))


@query(
    """WITH l AS (SELECT doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
x AS (SELECT doc_id, n, n % 4 = 0 AS ends, CASE WHEN n % 6 = 1 THEN 'to ' || n END AS choice, CASE WHEN n % 5 = 2 THEN '' ELSE trim(split_part(regexp_replace(line, '<[^>]*(>|$)', '', 'g'), '//', 1), ' ' || chr(9) || chr(13)) END AS t FROM l
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT starts_with(trim(line, ' ' || chr(9) || chr(13)), '//')),
g AS (SELECT *, coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM x),
m AS (SELECT doc_id, max(n) AS n, 1 AS r, 'message' AS kind, trim(string_agg(t, '' ORDER BY n), ' ' || chr(9) || chr(13)) AS text FROM g GROUP BY doc_id, part), b AS (SELECT * FROM m WHERE text <> '' UNION ALL SELECT doc_id, n, 0, 'choice', choice FROM g WHERE choice IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, r) AS seq, kind, text FROM b"""
)
def inline_messages(spark, d):
    """Lines between tags, some of which hold brackets in quotes; some lines pause, some offer a choice, some name a speaker."""
    quiet = lambda x: F.regexp_replace(x, r"^[\\s\u3000]+", "")

    def tagged(x, i):
        n = i + 1
        line = F.concat(F.when(n % 5 == 2, "<b>＠").otherwise('<t if="a > b">'), x, F.when(n % 4 == 0, "<PB>").otherwise(""))
        line = F.concat(F.when(n % 6 == 1, F.concat(F.lit('<case if="1 > 0" value=" to '), n.cast("string"), F.lit(' ">'))).otherwise(""), line)
        return F.when((quiet(x) == "") | quiet(x).startswith("//"), x).otherwise(line)

    return inline.messages(table(spark, d, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), tagged), "\n").alias("text")))


@query(
    """SELECT c_custkey AS k, CASE c_custkey % 7 WHEN 0 THEN c_name WHEN 1 THEN '【' || c_name || '】' WHEN 2 THEN c_name WHEN 3 THEN '名' || c_name END AS shown FROM customer WHERE c_custkey % 7 < 4"""
)
def macro_names(spark, d):
    """Customers' names in macros of seven shapes, of which four show them and the others hold code, other tags or ASCII only."""
    k, n = F.col("c_custkey"), F.col("c_name")
    around = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    bodies = [
        around('[hr][label][ch text="', '"][r]\r\n[playse x]'), around("[eval exp=%name|f.name='", "'] [nowait]　【[emb exp=f.name]】[endnowait]"), around("[font][nowait]", "[r] [endnowait][eval x]"), around("\n[nowait]名", "[endnowait][r]\n"),
        around('[ch text="', '"]名'), around("名[wait]", ""), around("", "[r]"),
    ]
    body = F.get(F.array(*bodies), (k % 7).cast("int"))
    name = F.when(k % 7 == 2, F.concat(F.lit("【"), k, F.lit("】"))).otherwise(F.concat(F.lit("m"), k))
    shown = inline.name_macros(table(spark, d, "customer").select(name.alias("name"), body.alias("body")))
    return shown.select(F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("k"), "shown")


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN strlen(text) + 1000 WHEN 1 THEN 2000000 + length(text) WHEN 2 THEN length(text) + 5000 END AS rows FROM documents WHERE doc_id % 4 < 3 AND text IS NOT NULL"""
)
def reported_rows(spark, d):
    """Reports of each document's size, among the document's own lines: on the line of the finished text, in bold, or first."""
    k, long = F.col("doc_id") % 4, F.length("text")
    comma = lambda n: F.format_number(n, 0)
    first = F.when(k == 3, F.concat(F.lit("999 行 "), long % 1000, F.lit(" 行"))).otherwise(F.concat(F.lit("全 "), comma(long + 5000), F.lit(" 行")))
    bold = F.when(k == 1, F.concat(F.lit("计 1234 行，**"), (long + 2000000).cast("string"), F.lit(" 行**"))).otherwise("")
    done = F.when(k == 0, F.concat(F.lit("成品 "), comma(F.octet_length("text") + 1000), F.lit("行"))).otherwise("")
    report = F.concat_ws("\n", first, F.when(k == 2, "").otherwise(bold), F.replace("text", F.lit("行"), F.lit("")), done)
    return inline.declared_rows(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", report.alias("text")))


@query(
    """WITH p AS (SELECT DISTINCT 'x/' || (p_partkey % 50) AS folder, 'eboot.bin' AS name FROM part WHERE p_size % 5 = 0 UNION SELECT DISTINCT 'x', 'sce_pfs' FROM part WHERE p_size % 5 = 1 UNION SELECT DISTINCT 'x/' || (p_partkey % 50) || '/' || p_size, 'data.rom' FROM part WHERE p_size % 5 = 2)
SELECT folder, name, CASE name WHEN 'eboot.bin' THEN 'application' WHEN 'sce_pfs' THEN 'protected files' ELSE 'rom2 archive' END AS kind FROM p"""
)
def folder_hints(spark, d):
    """Parts as paths, some of which go through names that tell what a folder holds."""
    size, at = F.col("p_size"), (F.col("p_partkey") % 50).cast("string")
    path = F.when(size % 5 == 0, F.concat(F.lit("x/"), at, F.lit("/eboot.bin"))).when(size % 5 == 1, F.concat(F.lit("x/sce_pfs/"), at, F.lit("/a"))).when(size % 5 == 2, F.concat(F.lit("x/"), at, F.lit("/"), size.cast("string"), F.lit("/data.rom")))
    return identify.directory_hints(table(spark, d, "part").select(F.coalesce(path, F.lit("x/other/eboot.bin.txt")).alias("path")), identify.FOLDER_HINTS)
