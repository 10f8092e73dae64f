"""URL filters: pattern rules found through their rarest literal token.

Every rule is a regular expression with the literal tokens that any URL it fits
must contain.  Over the distinct URLs the tokens of the rules are counted, each
rule is filed under its rarest token, and the tokens of a URL fetch the few rules
whose expression is then run.  Rules without a literal token are filed under the
empty token, which every URL has, so none is lost.

Defined results: a null URL or one without ``://`` has an empty host and path and
fits no site rule; pattern rules look at the whole URL, so they may still fit the
latter.  Repeated rows each get their row.  Of several site rules the longest wins,
then the smaller string; of several pattern rules a block wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import ascii_lower

TOKEN_BREAK = r"[^0-9a-z]+"
#: Rule sets are counted; those up to this many rows are broadcast, larger ones are joined by shuffle, and the results agree.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    kind: str  # site: on host and path; pattern: on the whole URL
    label: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits `host`, its subdomains, and every path that starts with `path`."""
    host, text = host.lower(), host.lower() + path
    tokens = re.split(TOKEN_BREAK, text.lower())
    # The last piece may go on in the URL ("en/1" fits "en/12"), so it is no whole token.
    return Rule("site", text, verdict, r"^(?:[^/]*\.)?" + _quote(host) + _quote(path), tuple(dict.fromkeys(t for t in tokens[:-1] if t)))


def pattern_rule(verdict: str, label: str, regex: str) -> Rule:
    """Its tokens come from the expression, so no URL that fits can lack one."""
    return Rule("pattern", label, verdict, regex, tuple(whole_tokens(regex)))


def whole_tokens(regex: str) -> list[str]:
    """Runs of letters and digits, in lower case, that stand in every text the expression fits, and there as a whole: fenced on both sides by something else.

    An expression that Python can't read has none, and is tried on every URL.
    """
    try:
        parts = list(_parser.parse(regex))
    except re.error:
        return []
    plain = [op is _parser.LITERAL and chr(x).isascii() and chr(x).isalnum() for op, x in parts]
    out, at = [], 0
    while at < len(parts):
        end = at
        while end < len(parts) and plain[end]:
            end += 1
        if end > at and _fenced(parts[:at], -1) and _fenced(parts[end:], 0):
            out.append("".join(chr(x) for _, x in parts[at:end]).lower())
        at = max(end, at + 1)
    return list(dict.fromkeys(out))


def _fenced(parts: list, side: int) -> bool:
    """Whether a text that the parts fit has, at that side (0: its start, -1: its end), a character that no token holds, or the text's own end."""
    if not parts:
        return False
    op, x = parts[side]
    outside = lambda c: c < 128 and not chr(c).isalnum()
    rest = parts[1:] if side == 0 else parts[:-1]
    if op is _parser.LITERAL:
        return outside(x)
    if op is _parser.IN:
        return all(kind is _parser.LITERAL and outside(c) for kind, c in x)
    if op is _parser.AT:
        return x is (_parser.AT_END if side == 0 else _parser.AT_BEGINNING)
    if op is _parser.SUBPATTERN:
        return _fenced(list(x[-1]), side)
    if op is _parser.BRANCH:
        return all(_fenced(list(p), side) for p in x[1])
    if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
        return _fenced(list(x[2]), side) and (x[0] > 0 or _fenced(rest, side))
    return False


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z/])", r"\\\1", text)


#: The rules of the contract.
SITE_RULES = (
    site_rule("allow", "org"),
    site_rule("block", "example.org", "/es/"),
    site_rule("block", "example.org", "/en/1"),
    site_rule("allow", "com", "/fr/"),
    site_rule("block", "com", "/de/"),
)
#: What holds where no site rule fits: pages that carry no running text, and sessions.
PATTERN_RULES = (
    *(pattern_rule("block", f"file .{x}", rf"(?i)^[^?#]*\.{x}(?:[?#]|$)") for x in ("zip", "exe", "iso", "dmg", "apk", "mp3", "mp4")),
    *(pattern_rule("block", f"session {x}", rf"(?i)[?&;]{x}=") for x in ("phpsessid", "jsessionid", "sessionid")),
    pattern_rule("block", "login page", r"(?i)^[^?#]*/wp-login\.php"),
    pattern_rule("block", "checkout", r"(?i)^[^?#]*/cart/checkout(?:[/?#]|$)"),
    pattern_rule("block", "tracking host", r"(?i)://(?:[^/?#]*\.)?doubleclick\.net(?:[:/?#]|$)"),
)


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _rest(url: Column) -> Column:
    return F.expr("substring(url, instr(url, '://') + 3)")


def index_rules(rules: DataFrame, url_tokens: DataFrame, small: bool = False) -> DataFrame:
    """rules with `token`, the rarest of its tokens in url_tokens(url, token). small: whether the rules may be broadcast."""
    wanted = rules.select("rule_id", F.explode("tokens").alias("token"))
    seen = url_tokens.join(_sized(wanted.select("token").distinct(), small), "token", "left_semi").groupBy("token").count()
    rarest = wanted.join(seen, "token", "left").groupBy("rule_id").agg(
        F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), -F.length("token"), "token")).alias("token")
    )
    return rules.join(rarest, "rule_id", "left").withColumn("token", F.coalesce("token", F.lit("")))


def _sized(rules: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(rules) if small else rules


def rule_table(spark, rules) -> DataFrame:
    """The rules as a table."""
    rows = [(i, r.kind, r.label, r.verdict, r.regex, list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rule_id int, kind string, label string, verdict string, regex string, tokens array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of `pages`: page_id, url, host, path, rule, verdict, pattern."""
    pages = pages.select("page_id", "url")
    urls = pages.where(F.col("url").isNotNull()).select("url").distinct()
    small = rules.count() <= BROADCAST_RULES
    parts = urls.select("url", F.concat(host_of(F.col("url")), path_of(F.col("url"))).alias("place"), F.instr("url", "://").alias("at"))
    tokens = parts.select(
        "url", "place", "at",
        F.explode(F.array_union(F.split(ascii_lower(F.col("url")), TOKEN_BREAK), F.array(F.lit("")))).alias("token"),
    )
    index = index_rules(rules, tokens.select("url", "token"), small)
    index = index.select("token", "rule_id", "kind", "label", F.col("verdict").alias("said"), "regex")
    found = tokens.join(_sized(index, small), "token").where(
        F.when(F.col("kind") == "site", (F.col("at") > 0) & F.regexp_like("place", F.col("regex"))).otherwise(F.regexp_like("url", F.col("regex")))
    )
    rank = lambda kind, *by: F.min_by(F.struct("label", "said"), F.when(F.col("kind") == kind, F.struct(*by)))
    best = found.groupBy("url").agg(
        rank("site", -F.length("label"), "label").alias("site"), rank("pattern", F.col("said") != "block", "label").alias("pattern")
    )
    return pages.join(best, "url", "left").select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("site.label").alias("rule"),
        F.coalesce("site.said", "pattern.said", F.lit(default)).alias("verdict"), F.col("pattern.label").alias("pattern"),
    )
