"""The rules engine: findings of finished texts as one table.

A rule is data: an id, a severity and a condition.  Line rules look at the line, the
line before it and what the whole document holds; document rules look at sums over the lines.
A document is one row, judged in one pass over the array of its lines in the task that reads it: no
line becomes a row, only findings do, and nothing is shuffled.  A `Profile` holds what depends on the
script and on the work: the rules are the same for all.

What is declared elsewhere (allowed lines, ledgers, reports, claims) is brought to one row per document
and joined once, by document.  Page maps are checked against rows of lines.  All findings decide
the verdict together.

Defined results: a document without text tells only of its layout and reports; rows that repeat a doc_id are judged
one by one; equal declarations count once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import assemble
from glyphmill.operators.reports import declared_layouts


@dataclass(frozen=True)
class Profile:
    """What rules take from the script and the work; the defaults are those of Japanese texts."""

    #: A class of one character of the script; a text with fewer than `least_share` of it is relaxed.
    script: str = T.JAPANESE
    least_share: float = 0.01
    period: str = "。"
    comma: str = "、"
    pairs: tuple[tuple[str, str], ...] = (("「", "」"), ("『", "』"), ("（", "）"), ("(", ")"))
    #: Lines from which on a text's periods are judged, and whether the work is known to end lines without one.
    least_lines: int = 300
    no_final_period: bool = False
    widest: float = 200.0
    #: Name plates: a whole line, a line's head, heads that are none, characters that no name has, symbols.
    plate: str = T.PLATE
    head: str = T.HEAD
    no_head: str = T.NO_HEAD
    no_name: str = T.HIRAGANA
    body: str = T.BODY_START
    symbols: str = T.SYMBOLS
    #: `name:` at the start of a line, what it must hold, and labels, chapters and times that are no names.
    colon: str = T.COLON
    colon_holds: str = T.NAME_LETTER
    colon_not: tuple[str, ...] = (T.FIELD_LABEL, T.CHAPTER)
    colon_time: str = T.CLOCK
    #: Characters that need no place in a ledger, and those that are at home in the script.
    unlisted: str = T.CJK
    native: str = T.NATIVE
    names: tuple[str, ...] = ()
    dual: bool = False
    expect_dual: bool = False
    #: rule_id to another severity, or to '' to leave a rule out.
    severities: Mapping[str, str] = field(default_factory=dict)

    def severity(self, rule_id: str, usual: str) -> str:
        return self.severities.get(rule_id, usual)


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    severity: str
    #: The condition on a line and the line before it.
    when: Callable[[Column, Column], Column]
    allowable: bool = True
    #: What a document needs for any of its lines to hit, over `text`, `plates` and `heads`, if that tells anything.
    needs: Column | None = None


#: Of the classes of residue the character that each hit holds.
_RESIDUE_NEEDS = {"resource label": "_", "inline code": ":", "resource path": "/", "numbered resource": "|", "upper code": "_"}


def line_rules(p: Profile) -> list[LineRule]:
    """Conditions on a line, the one before, and `plates` and `heads` (those that the document has twice or more)."""
    fits = lambda pattern: lambda c, _: c.rlike(pattern)

    def plate(c: Column) -> Column:
        return c.rlike(p.plate) & F.array_contains("plates", c) & ~c.rlike(p.no_name)

    def only_symbols(c: Column) -> Column:
        return F.regexp_replace(F.regexp_extract(c, p.plate, 1), p.symbols, "") == ""

    def named(c: Column) -> Column:
        head = F.regexp_extract(c, p.head, 0)
        rest = F.substring(c, F.length(head) + 1, F.length(c))
        return c.rlike(p.head) & ~c.rlike(p.plate) & ~c.rlike(p.no_head) & ~head.rlike(p.no_name) & F.array_contains("heads", head) & rest.rlike(p.body)

    def colon(c: Column) -> Column:
        label = F.regexp_extract(c, p.colon, 0)
        found = c.rlike(p.colon) & label.rlike(p.colon_holds) & ~c.rlike(p.colon_time)
        for other in p.colon_not:
            found = found & ~label.rlike(other)
        return found

    def residue(pattern: str) -> Callable[[Column, Column], Column]:
        return lambda c, _: (c.contains("/") & c.rlike(pattern)) if "/" in pattern else c.rlike(pattern)

    # A search for one character or byte in a whole text is far cheaper than a pattern on each line.
    holds = lambda chars: reduce(or_, (F.col("text").contains(ch) for ch in chars))
    # The first byte in UTF-8 of what lies from U+E000 or U+F000 on.
    byte = lambda b: F.contains(F.encode("text", "UTF-8"), F.unhex(F.lit(b)))
    plates, heads = F.size("plates") > 0, F.size("heads") > 0
    return [
        LineRule("Q3_replacement_character", "E", lambda c, _: c.contains("�"), False, holds("�")),
        LineRule("Q4_geta_mark", "E", lambda c, _: c.contains("〓"), needs=holds("〓")),
        LineRule("Q5_control_character", "E", fits(T.CONTROLS), False),
        LineRule("Q6_half_width_kana", "E", fits(T.HALF_KANA), needs=byte("EF")),
        LineRule("Q7_half_width_punctuation", "W", fits(T.HALF_PUNCTUATION), False, byte("EF")),
        LineRule("Q8_private_use", "E", fits(T.PRIVATE_USE), False, byte("EE") | byte("EF")),
        LineRule("Q10_unbalanced_quote", "W", lambda c, _: c.startswith("「") & (T.pair_difference(c, "「", "」") > 0), needs=holds("「")),
        *(LineRule(f"Q11_{k.replace(' ', '_')}", "E", residue(r), needs=holds(_RESIDUE_NEEDS[k]) if k in _RESIDUE_NEEDS else None) for k, r in T.RESIDUE.items()),
        LineRule("Q12_inline_markup", "E", fits(T.MARKUP), needs=holds("<")),
        LineRule("Q13_latin_letters", "W", fits("[A-Za-z]")),
        LineRule("Q14_double_quote", "W", lambda c, _: c.contains('"'), False, holds('"')),
        LineRule("Q15_leading_punctuation", "W", fits(T.LEADING)),
        LineRule("Q20_symbol_plate", "W", lambda c, _: plate(c) & only_symbols(c), needs=plates),
        LineRule("Q21_repeated_plate", "E", lambda c, _: plate(c) & ~only_symbols(c), needs=plates),
        LineRule("Q22_plate_and_body", "E", lambda c, _: named(c), needs=heads),
        LineRule("Q23_name_prefix", "E", lambda c, _: colon(c)),
        LineRule("Q29_blank_line", "W", lambda c, _: T.is_blank(c), False),
        # No character is wider than one, none narrower than half, and wide ones take three bytes: only lines that their bytes allow are measured.
        LineRule("Q30_wide_line", "W", lambda c, _: (F.length(c) > p.widest) & ((F.length(c) > 2 * p.widest) | ((F.octet_length(c) + F.length(c) > 4 * p.widest) & (T.display_width(c) > p.widest))), False),
        LineRule("Q31_adjacent_duplicate", "W", lambda c, before: (c == before) & (c != ""), False),
        LineRule("Q32_unresolved_macro", "E", lambda c, _: c.rlike(T.MACRO_MARKS) & c.rlike(T.MACRO), needs=holds("@%\\＆&*#$<{")),
    ]


def _with_repeated(docs: DataFrame, name: str, items: Column) -> DataFrame:
    """docs with what an array holds twice or more, once each: equal neighbours in sorted order.

    The sorted array is a column of its own, since a function over it would sort it anew for every item.
    """
    docs = docs.withColumn("_sorted", F.array_sort(items))
    return docs.withColumn(name, F.array_distinct(F.filter("_sorted", lambda x, i: (i > 0) & (x == F.get("_sorted", i - 1))))).drop("_sorted")


def declarations(allowed: DataFrame | None = None, ledger: DataFrame | None = None, reports: DataFrame | None = None, claims: DataFrame | None = None) -> DataFrame | None:
    """One row per doc_id of allowed(doc_id, line), ledger(doc_id, ch), reports(doc_id, text) and claims(doc_id, rows, sha256).

    doc_id, and for each table given an array of what it holds, null where it has no row: allowed, ledger (first characters), reports
    (the layouts that each declares), claims. Arrays hold different items only.
    """
    items = {
        "allowed": None if allowed is None else allowed.select("doc_id", F.col("line").alias("item")),
        "ledger": None if ledger is None else ledger.select("doc_id", F.substring("ch", 1, 1).alias("item")),
        "reports": None if reports is None else reports.select("doc_id", declared_layouts(F.col("text")).alias("item")),
        "claims": None if claims is None else claims.select("doc_id", F.struct("rows", "sha256").alias("item")),
    }
    given, out = {k: v for k, v in items.items() if v is not None}, None
    for k, own in given.items():
        part = own.where("doc_id is not null").select("doc_id", F.lit(k).alias("kind"), F.col("item").alias(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        return None
    return out.groupBy("doc_id").agg(*(F.when(F.count_if(F.col("kind") == k) > 0, F.collect_set(k)).alias(k) for k in given))


def _case(when: Column, rule_id: str, severity: str, count: Column, line: Column | None = None, sample: Column | None = None) -> Column:
    fields = (F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), count.cast("long").alias("count"))
    place = (F.lit(None).cast("long") if line is None else line).alias("first_line"), (F.lit(None).cast("string") if sample is None else sample).alias("sample")
    return F.when(when, F.struct(*fields, *place))


def _told(rows: DataFrame, found: Column) -> DataFrame:
    """doc_id and the findings of an array, a row each.

    explode() would have Spark filter by the array's size first, which builds it twice.
    """
    out = rows.select("doc_id", F.explode_outer(found).alias("r"))
    return out.where("r.rule_id is not null").select("doc_id", "r.rule_id", "r.severity", "r.count", "r.first_line", "r.sample")


def annotated(docs: DataFrame, p: Profile) -> DataFrame:
    """docs(doc_id, text, declared columns) with own (its lines, without the empty one after a last line end), plates, heads, and `lines`: own as structs of line_no, line, excused."""
    every = F.split("text", "\n", -1)
    own = F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)
    docs = docs.withColumn("own", own)
    heads = F.transform(F.filter("own", lambda x: x.rlike(p.head)), lambda x: F.regexp_extract(x, p.head, 0))
    docs = _with_repeated(_with_repeated(docs, "plates", F.filter("own", lambda x: x.rlike(p.plate))), "heads", heads)
    if "allowed" in docs.columns:
        docs = docs.withColumn("_allowed", F.coalesce(F.array_intersect("own", "allowed"), F.array().cast("array<string>")))
        excused = lambda x: F.array_contains("_allowed", x)
    else:
        excused = lambda x: F.lit(False)
    return docs.withColumn(
        "lines", F.transform("own", lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"), excused(x).alias("excused")))
    )


def with_line_hits(rows: DataFrame, rules: list[LineRule]) -> tuple[DataFrame, list[Column]]:
    """Annotated rows with what each rule hits (number of lines, the first one's number and start), and the rules' cases over that."""
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("line_no"), F.lit(None).cast("string").alias("sample"))

    def hits(r: LineRule) -> Column:
        def step(a: Column, x: Column) -> Column:
            on = r.when(x["line"], F.get("own", x["line_no"] - 2))
            first = a["n"] == 0
            now = F.struct(
                (a["n"] + 1).alias("n"), F.when(first, x["line_no"]).otherwise(a["line_no"]).alias("line_no"), F.when(first, F.substring(x["line"], 1, 40)).otherwise(a["sample"]).alias("sample")
            )
            return F.when(on & ~x["excused"] if r.allowable else on, now).otherwise(a)

        every = F.aggregate("lines", none, step)
        return every if r.needs is None else F.when(r.needs, every).otherwise(none)

    rows = rows.select("*", *(hits(r).alias(f"_hits{k}") for k, r in enumerate(rules)))
    of = [(r, F.col(f"_hits{k}")) for k, r in enumerate(rules)]
    return rows, [_case(h["n"] > 0, r.rule_id, r.severity, h["n"], h["line_no"].cast("long"), h["sample"]) for r, h in of]


def with_sums(rows: DataFrame, p: Profile) -> tuple[DataFrame, list[Column]]:
    """Annotated rows with sums over lines, and the cases over them: pairs (lines with faces and allowed lines don't count), periods."""
    many = lambda c, ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))
    text = F.col("text")
    # Only lines that hold one of the pairs are looked at for faces.
    paired = lambda c: reduce(or_, (c.contains(ch) for pair in p.pairs for ch in pair), F.lit(False))
    counted = F.filter("lines", lambda x: paired(x["line"]) & ~x["excused"] & ~x["line"].rlike(T.FACES))
    rows = rows.select(
        "*", F.size("own").alias("_n"), many(text, p.period).alias("_periods"), F.size(F.filter("own", lambda x: x.endswith(p.period))).alias("_ends"), many(text, p.comma).alias("_commas"),
        F.array_join(counted["line"], "\n").alias("_counted"),
    )
    chars = F.length(text) - many(text, "\n") + F.col("_n")
    # Characters of the script are counted only where there are lines enough for periods to be judged, by taking out runs of them.
    script = F.length(text) - F.length(F.regexp_replace(text, f"{p.script}++", ""))
    judged = F.when(F.col("_n") >= p.least_lines, script >= p.least_share * chars).otherwise(False)
    pairs = [many(F.col("_counted"), a) - many(F.col("_counted"), b) for a, b in p.pairs]
    rows = rows.select("*", ((F.col("_n") > 0) & judged).alias("_judged"), *(d.alias(f"_pair{k}") for k, d in enumerate(pairs)))
    told = "_declared" if p.no_final_period else ""
    n, judged, periods, ends, commas = (F.col(c) for c in ("_n", "_judged", "_periods", "_ends", "_commas"))
    cases = [(F.col(f"_pair{k}") != 0, f"Q9_pair_{a}{b}", F.abs(F.col(f"_pair{k}"))) for k, (a, b) in enumerate(p.pairs)]
    cases += [
        (judged & (periods == 0), f"Q16_no_periods{told}", n),
        (judged & (periods > 0) & (ends == 0), f"Q17_no_final_periods{told}", n),
        (judged & (ends > 0) & (20 * periods < n), "Q18_few_periods", periods),
        (judged & (periods > 0) & (commas > 5 * periods), "Q19_many_commas", commas),
    ]
    return rows, [_case(when, i, p.severity(i, "W"), k) for when, i, k in cases if p.severity(i, "W")]


def with_characters(rows: DataFrame, p: Profile) -> tuple[DataFrame, list[Column]]:
    """Annotated rows with kinds of characters, and the cases over them: those from elsewhere (Q33), and where rows have `ledger`, documents without one and kinds that it hasn't (Q34)."""
    # Runs of characters that don't matter go before the text is taken apart.
    kinds = lambda but: F.filter(F.array_distinct(F.split(F.regexp_replace("text", but, ""), "")), lambda x: (x != "") & (x != "\n"))
    rows = rows.withColumn("_far", F.size(F.filter(kinds(r"[\x{00}-\x{7F}]+"), lambda x: ~x.rlike(p.native) & ~x.rlike(p.symbols))))
    cases = [(F.col("_far") > 0, "Q33_foreign_characters", p.severity("Q33_foreign_characters", "W"), F.col("_far"))]
    if "ledger" in rows.columns:
        fresh = F.size(F.array_except(kinds(f"{p.unlisted}++"), F.col("ledger")))
        rows, has = rows.withColumn("_fresh", fresh), F.col("ledger").isNotNull()
        cases += [(~has & (F.size("own") > 0), "Q34_ledger_missing", p.severity("Q34_ledger_missing", "E"), F.lit(1)), (has & (F.col("_fresh") > 0), "Q34_unregistered_characters", p.severity("Q34_unregistered_characters", "E"), F.col("_fresh"))]
    return rows, [_case(when, i, s, k) for when, i, s, k in cases if s]


def joined_rows(own: str) -> Column:
    """Lines of an array that are the concatenation of two or more lines right before them, none of them empty.

    A line ends with the one before it or is none; then those before are taken off its end one by one. Each takes a
    character at least, so a line looks back over no more lines than it has characters.
    """

    def left(x: Column, i: Column) -> Column:
        back = F.least(i, F.length(x))
        return F.aggregate(F.reverse(F.slice(own, i + 1 - back, back)), x, lambda rest, b: F.when(rest == "", rest).when((b != "") & rest.endswith(b), F.substring(rest, F.lit(1), F.length(rest) - F.length(b))))

    def joined(x: Column, i: Column) -> Column:
        before = F.get(own, i - 1)
        return F.when((i > 1) & (before != "") & x.endswith(before) & (F.length(x) > F.length(before)), left(x, i) == "").otherwise(False)

    return F.filter(own, joined)


def with_layout(rows: DataFrame, p: Profile, mapped: bool) -> tuple[DataFrame, list[Column], list[Column]]:
    """Annotated rows, the cases of the declared layout against joined rows (Q25, Q27; page maps tell more, where there are any), and arrays of cases of `reports` (Q28)."""
    cases, reported = [(F.lit(p.expect_dual and not p.dual), "Q25_dual_expected", "E", F.lit(1))], []
    if not mapped:
        rows = rows.withColumn("_joined", F.coalesce(F.size(joined_rows("own")), F.lit(0)))
        cases += [(F.lit(p.dual) & (F.col("_joined") == 0), "Q27_dual_without_joined_rows", "W", F.lit(1)), (F.lit(not p.dual) & (F.col("_joined") > 0), "Q27_joined_rows_in_single", "W", F.col("_joined"))]
    if "reports" in rows.columns:
        want = "dual" if p.dual else "single"

        def told(m: Column) -> Column:
            of = (
                (F.coalesce(F.size(m), F.lit(0)) <= 0, "Q28_layout_missing", F.lit(1)), (F.size(m) > 1, "Q28_layout_conflict", F.size(m)),
                ((F.size(m) == 1) & (F.get(m, F.lit(0)) != want), "Q28_layout_mismatch", F.lit(1)),
            )
            return _array([_case(when, i, p.severity(i, "E"), k) for when, i, k in of if p.severity(i, "E")])

        each = F.coalesce("reports", F.array(F.lit(None).cast("array<string>")))
        reported.append(F.flatten(F.transform(each, told)))
    return rows, [_case(when, i, p.severity(i, s), k) for when, i, s, k in cases if p.severity(i, s)], reported


def map_findings(docs: DataFrame, p: Profile, maps: DataFrame) -> DataFrame:
    """Page maps(doc_id, map) against the rows of docs (Q26)."""
    lines = annotated(docs.select("doc_id", "text"), p).select("doc_id", F.explode("lines").alias("r")).select("doc_id", F.col("r.line_no").cast("long").alias("line_no"), "r.line")
    wrong = assemble.validate_page_maps(maps, lines).where("error <> 'no pages'").groupBy("doc_id").agg(F.count("*").alias("wrong"))
    pages = maps.select("doc_id", F.coalesce(F.size(F.from_json("map", assemble.PAGE_MAP)["pages"]), F.lit(-1)).alias("pages"))
    cases = (
        (F.col("wrong") > 0, "Q26_page_map", F.col("wrong")), (F.col("pages") < 0, "Q26_page_map_unreadable", F.lit(1)),
        (F.lit(not p.dual) & (F.col("pages") > 0), "Q26_pages_in_single", F.col("pages")), (F.lit(p.expect_dual) & (F.col("pages") == 0), "Q26_no_pages", F.lit(1)),
    )
    rows = docs.select("doc_id").join(pages, "doc_id", "left").join(wrong, "doc_id", "left")
    return _told(rows, _array([_case(when, i, p.severity(i, "E"), k) for when, i, k in cases if p.severity(i, "E")]))


def text_cases(rows: DataFrame, p: Profile) -> tuple[list[Column], list[Column]]:
    """What a document's text tells by itself: its mark (if rows have `marked`), carriage returns, expected names; and arrays of cases of `claims`; a null claims nothing."""
    c = F.col("text")
    cases = [(c.contains("\r"), "Q2_carriage_return", "E", T.count_of(c, "\r"))]
    if "marked" in rows.columns:
        cases.append((c.isNotNull() & ~F.col("marked"), "Q1_mark_missing", "E", F.lit(1)))
    cases += [(~c.contains(name), f"Q24_name_absent_{name}", "W", F.lit(1)) for name in p.names]
    claimed = []
    if "claims" in rows.columns:
        own = T.count_of(c, "\n") + (~c.endswith("\n") & (c != "")).cast("long")

        def told(claim: Column) -> Column:
            of = ((claim["rows"] != own, "Q35_declared_rows", own), (claim["sha256"] != F.sha2(c, 256), "Q36_digest_mismatch", F.lit(1)))
            return _array([_case(when, i, p.severity(i, "E"), k) for when, i, k in of if p.severity(i, "E")])

        claimed.append(F.flatten(F.transform(F.coalesce("claims", F.array().cast("array<struct<rows:bigint,sha256:string>>")), told)))
    return [_case(when, i, p.severity(i, s), k) for when, i, s, k in cases if p.severity(i, s)], claimed


def _array(cases: list[Column]) -> Column:
    """The cases that hold."""
    none = F.lit(None).cast("struct<rule_id:string,severity:string,count:bigint,first_line:bigint,sample:string>")
    return F.filter(F.array(*(cases or [none])), lambda x: x.isNotNull())


def layout_findings(docs: DataFrame, p: Profile, maps: DataFrame | None = None, reports: DataFrame | None = None) -> DataFrame:
    """Only what is found about layouts (Q25 to Q28)."""
    declared = declarations(reports=reports)
    rows = docs if declared is None else docs.join(declared, "doc_id", "left")
    rows, cases, reported = with_layout(annotated(rows, p), p, maps is not None)
    found = _told(rows, F.concat(_array(cases), *reported))
    return found if maps is None else found.unionByName(map_findings(docs, p, maps))


def findings(
    docs: DataFrame, profile: Profile = Profile(), allowed: DataFrame | None = None, ledger: DataFrame | None = None, maps: DataFrame | None = None,
    reports: DataFrame | None = None, claims: DataFrame | None = None, declared: DataFrame | None = None,
) -> DataFrame:
    """doc_id, rule_id, severity, count, first_line, sample: all findings of docs(doc_id, text, and `marked` where the file's mark is known).

    Rows of docs that tell their own declarations, in columns as `declarations()` has them, are judged where they are read.
    declared: what `declarations()` gives, for callers that have it as one table already, in place of the other four.
    """
    if declared is None:
        declared = declarations(allowed, ledger, reports, claims)
    rows = docs.select("doc_id", "text", *(c for c in ("marked", "allowed", "ledger", "reports", "claims") if c in docs.columns))
    rows = annotated(rows if declared is None else rows.join(declared, "doc_id", "left"), profile)
    rules = [LineRule(r.rule_id, profile.severity(r.rule_id, r.severity), r.when, r.allowable, r.needs) for r in line_rules(profile)]
    rows, of_lines = with_line_hits(rows, [r for r in rules if r.severity])
    rows, of_sums = with_sums(rows, profile)
    rows, of_characters = with_characters(rows, profile)
    rows, of_layout, reported = with_layout(rows, profile, maps is not None)
    of_text, claimed = text_cases(rows, profile)
    found = _told(rows, F.concat(_array(of_lines + of_sums + of_characters + of_layout + of_text), *reported, *claimed))
    return found if maps is None else found.unionByName(map_findings(docs, profile, maps))


def verdicts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, errors, warnings, passed."""
    n = found.groupBy("doc_id").agg(F.count_if(F.col("severity") == "E").alias("errors"), F.count_if(F.col("severity") == "W").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", zero("errors"), zero("warnings"), (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))
