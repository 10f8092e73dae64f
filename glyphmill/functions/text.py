"""Text functions as column expressions, evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes, patterns and symbols of the rules.
IDEOGRAPHIC_SPACE = r"\x{3000}"
JAPANESE = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
HIRAGANA = r"[\x{3040}-\x{309F}]"
NAME_LETTER = r"[ぁ-んァ-ヶ一-龯]"
CONTROLS = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]"
HALF_KANA = r"[\x{FF66}-\x{FF9F}]"
HALF_PUNCTUATION = r"[\x{FF61}-\x{FF65}]"
PRIVATE_USE = r"[\x{E000}-\x{F8FF}]"
WIDE = r"[\x{1100}-\x{115F}\x{2E80}-\x{303E}\x{3041}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A000}-\x{A4CF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FE30}-\x{FE6F}\x{FF00}-\x{FF60}\x{FFE0}-\x{FFE6}]"
#: Characters that need no place in a ledger, those at home in Japanese texts, and symbols.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}\x{FFE0}-\x{FFEE}]"
NATIVE = r"[\x{3000}-\x{30FF}\x{4E00}-\x{9FFF}\x{FF01}-\x{FF60}\x{2010}-\x{203B}\x{2190}-\x{21FF}\x{2460}-\x{24FF}\x{2500}-\x{25FF}\x{0100}\x{00D7}\x{00F7}]"
SYMBOLS = r"[　、。・…‥—―‐−─～〜「」『』（）()［］\[\]｛｝{}〈〉《》【】〔〕！？!?，,．.：:；;／/＼＊*＃#＠@＆&％%＋+＝=＜＞＄￥￠￡№♪☆★○●◎◇◆□■△▲▽▼※→←↑↓〒〆々〻ヽヾゝゞ０１２３４５６７８９]"
#: Characters of faces, whose brackets don't pair.
FACES = r"[￣￢ω∀дДσΣ＾´｀ﾟ▽△ヮ⌒]"
LEADING = r"^[、。，．,.）)」』】〕]"
#: Name plates: a whole line, a line's head, heads of shops and goods, and what stands after a head.
PLATE = r"^[!！]?【([^】。、…‥]{1,20})】$"
HEAD = r"^[!！]?【[^】。、…‥]{1,20}】"
NO_HEAD = r"^[!！]?【[^】]*[・＠][^】]*】"
BODY_START = r"^(?:\z|[「『（( \x{3000}])"
#: `name:` at the start of a line; labels, chapters and times that look like it.
COLON = r"^[^\s。「、！？…‥（(【『」』）)〔〕［］《》〈〉—―‐−─～〜Ａ-Ｚａ-ｚ０-９]{1,8}[：:]"
FIELD_LABEL = r"送信者|受信者|件名|宛先|差出人|本文|注意|追伸|ＰＳ|Ｑ|Ａ|コメント|返信|投稿者|作成者|タイトル|日時|日程|予定|場所|日付|時刻"
CHAPTER = r"^[第＃#]?[0-9一二三四五六七八九十０-９]{0,3}[幕章話節]"
CLOCK = r"^.{0,8}[0-9０-９][：:][0-9０-９]"
#: Classes of residue that a finished text must not hold.
RESIDUE = {
    "resource label": r"^[a-z][a-z0-9]*_[a-z0-9_]+$",
    "inline code": r":[A-Za-z_][A-Za-z0-9_]*(?:\s[^:」』]*)?:",
    "script code": r"^\s*(?:if|goto|gosub|resume|lsp|csp|mov|textclear)\b",
    "resource path": r"(?i)[A-Za-z0-9_]+/[A-Za-z0-9_.]+\.(?:png|bmp|jpg|gif|wav|ogg|mp3)",
    "command and numbers": r"^\s*[A-Za-z_]\w*\s+\d[\d,]*\s*$",
    "numbered resource": r"\|[A-Za-z0-9]{1,10}/[A-Za-z0-9_]{1,24}",
    "upper code": r"^[A-Z][A-Z0-9]*_[A-Z0-9_]+$",
}
MARKUP = r"</?[A-Za-z][^>]{0,24}>"
#: Shapes of macros that nothing has filled in, and the characters of which each has one.
MACRO_MARKS = r"[@%\\＆&*#$<{]"
MACRO = "|".join(
    (
        r"@[A-Za-z_]\w*", r"%[-0-9.$*]*[A-Za-z]", r"\\[A-Za-z]+", r"＆{2,}", r"&&", r"\*\*[A-Z]{2,}",
        r"#\s*[Nn]ame\[\d+\]", r"\$\{[^}]{1,24}\}", r"%[a-z][a-z_]{2,}%", r"<[a-z]{3,12}>", r"\{[A-Za-z_]\w*\}",
    )
)


def strip_blanks(c: Column) -> Column:
    """Without white space at both ends, the ideographic space included."""
    return F.regexp_replace(c, rf"^[\s{IDEOGRAPHIC_SPACE}]+|[\s{IDEOGRAPHIC_SPACE}]+$", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(rf"[^\s{IDEOGRAPHIC_SPACE}]")


def has_japanese(c: Column) -> Column:
    return c.rlike(JAPANESE)


def share_of(c: Column, pattern: str) -> Column:
    """Share of the characters that fit a one-character class; 0 for an empty text."""
    return F.when(F.length(c) > 0, F.regexp_count(c, F.lit(pattern)) / F.length(c)).otherwise(F.lit(0.0))


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def display_width(c: Column) -> Column:
    """Wide characters count 1, all others half."""
    return 0.5 * F.length(c) + 0.5 * F.regexp_count(c, F.lit(WIDE))


def strip_markup(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def tag_names(c: Column) -> Column:
    """Names of the tags in order, with the slash of closing ones; a `>` inside quotes ends no tag."""
    return F.regexp_extract_all(c, F.lit(r"""<(/?[A-Za-z][A-Za-z0-9]*)(?:[^>"']|"[^"]*"|'[^']*')*+>"""), 1)


def strip_indent(c: Column) -> Column:
    """Without blanks, tabs and ideographic spaces at the start of the line; white space elsewhere stays."""
    return F.regexp_replace(c, rf"^[ \t{IDEOGRAPHIC_SPACE}]+", "")


def keep_ruby_base(c: Column) -> Column:
    """<ruby=reading>base</ruby> to base."""
    return F.regexp_replace(c, "<ruby=[^>]*>(.*?)</ruby>", "$1")


def merge_soft_breaks(c: Column, mark: str = r"\\n") -> Column:
    """A literal break mark and the indent after it go."""
    return F.regexp_replace(c, rf"(?:{mark})+[ {IDEOGRAPHIC_SPACE}]*", "")


def strip_controls(c: Column) -> Column:
    return F.regexp_replace(c, CONTROLS, "")


def residue_classes(c: Column, classes: Mapping[str, str] = RESIDUE) -> Column:
    """Names of the classes that a line holds, in the order of the table."""
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(k)) for k, p in classes.items()]), lambda x: x.isNotNull())


def pair_difference(c: Column, opening: str, closing: str) -> Column:
    """Number of opening characters less that of closing ones."""
    return (F.length(F.replace(c, F.lit(closing), F.lit(""))) - F.length(F.replace(c, F.lit(opening), F.lit("")))).cast("long")


def bracket_depth(c: Column, opening: str, closing: str) -> Column:
    """struct(depth at the end, deepest, top: pairs closed at level one, stray: closings without opening)."""
    zero = F.struct(*[F.lit(0).alias(k) for k in ("depth", "deepest", "top", "stray")])

    def step(a: Column, ch: Column) -> Column:
        up, down = ch == opening, (ch == closing) & (a["depth"] > 0)
        depth = F.when(up, a["depth"] + 1).when(down, a["depth"] - 1).otherwise(a["depth"])
        return F.struct(
            depth.alias("depth"), F.greatest(a["deepest"], depth).alias("deepest"),
            (a["top"] + (down & (a["depth"] == 1)).cast("int")).alias("top"), (a["stray"] + ((ch == closing) & (a["depth"] == 0)).cast("int")).alias("stray"),
        )

    # Only the brackets matter, so the fold runs over those.
    return F.aggregate(F.regexp_extract_all(c, F.lit(f"([\\{opening}\\{closing}])"), 1), zero, step)


def substitute(c: Column, names: Mapping[str, str]) -> Column:
    """Macro names to values, the longest name first."""
    for k in sorted(names, key=lambda k: (-len(k), k)):
        c = F.replace(c, F.lit(k), F.lit(names[k]))
    return c


def fill_slots(c: Column, values: Column, mark: str = "%s") -> Column:
    """Positional marks to the items of an array, in order; marks without an item vanish."""
    parts = F.split(c, mark)
    filled = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(values, i - 1), F.lit("")), p)))
    return F.array_join(filled, "")


def sortable_number(digits: Column) -> Column:
    """Digits as text that sorts as the number does, however long: the number's length in four digits, and its digits."""
    plain = F.regexp_replace(digits, r"^0+(?=\d)", "")
    return F.concat(F.lpad(F.length(plain).cast("string"), 4, "0"), plain)


def natural_key(c: Column) -> Column:
    """An array that sorts names with their numbers as numbers; of numbers that differ in leading zeros only, the longer comes later."""
    parts = F.regexp_extract_all(c, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    key = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), sortable_number(p)).otherwise(p))
    return F.concat(key, F.array(F.lit(""), F.lpad(F.length(c).cast("string"), 10, "0")))


def slug(c: Column) -> Column:
    """The anchor of a heading."""
    return F.replace(F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}\s_-]", ""), F.lit(" "), F.lit("-"))


def gram_list(c: Column, n: int) -> Column:
    """Character n-grams in order, found in one pass; the whole text where it is shorter, none of an empty one."""
    whole = F.when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(c) < n, whole).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))."), 1))


def grams(c: Column, n: int) -> Column:
    """Distinct character n-grams; the whole text where it is shorter."""
    return F.array_distinct(gram_list(c, n))


def repeats_gram(c: Column, n: int) -> Column:
    """Whether some n-gram stands twice in a text."""
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return (F.length(c) > n) & (F.size(every) > F.size(F.array_distinct(every)))


def first_fitting(c: Column, cases: Iterable[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first case that holds: a disposition is always given."""
    out = None
    for when, label in cases:
        out = F.when(when, F.lit(label)) if out is None else out.when(when, F.lit(label))
    return out.otherwise(F.lit(otherwise))


# Half-width kana and punctuation, and their full-width forms in the same order.
HALF_WIDTH = "｡｢｣､･ｦｧｨｩｪｫｬｭｮｯｰｱｲｳｴｵｶｷｸｹｺｻｼｽｾｿﾀﾁﾂﾃﾄﾅﾆﾇﾈﾉﾊﾋﾌﾍﾎﾏﾐﾑﾒﾓﾔﾕﾖﾗﾘﾙﾚﾛﾜﾝﾞﾟ"
FULL_WIDTH = "。「」、・ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン゛゜"


def full_width_kana(c: Column) -> Column:
    return F.translate(c, HALF_WIDTH, FULL_WIDTH)


def looks_like_name(c: Column, pattern: str = r"^[ぁ-んァ-ヶ一-龯々・ー？?]+$", most: int = 10) -> Column:
    """Whether a text is short and made of name characters only."""
    return F.coalesce((F.length(c) > 0) & (F.length(c) <= most) & c.rlike(pattern), F.lit(False))


def unescape(c: Column, table: Mapping[str, str], mark: str = "\\") -> Column:
    """Escapes (a mark and one character) to what the table says, in one pass from the left; unknown ones stay."""
    parts = F.regexp_extract_all(c, F.lit(rf"(?s)(\{mark}.|[^\{mark}]+|\{mark})"), 1)
    known = F.create_map(*[F.lit(x) for k, v in table.items() for x in (mark + k, v)])
    return F.when(F.length(c) > 0, F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(known, p), p)), "")).otherwise(c)


def split_name(c: Column, opening: str = "「", closing: str = "」", most: int = 12) -> Column:
    """struct(name, text): a short head before a quote that closes the row is its speaker's name, else null."""
    head = F.substring_index(c, opening, 1)
    fits = c.contains(opening) & c.endswith(closing) & (F.length(head) > 0) & (F.length(head) <= most)
    return F.struct(F.when(fits, head).alias("name"), F.when(fits, F.substring(c, F.length(head) + 1, F.length(c))).otherwise(c).alias("text"))


def quoted(c: Column, channel: Column, marks: Mapping[str, tuple[str, str]]) -> Column:
    """The text in the quotes of its channel; a text that has them already, or whose channel has none, stays."""
    out = c
    for name, (a, b) in marks.items():
        out = F.when((channel == name) & ~(c.startswith(a) & c.endswith(b)), F.concat(F.lit(a), c, F.lit(b))).otherwise(out)
    return out
