"""Chat formatting with a grammar that is parsed back (DataFrame functions only).

A turn is ``<|turn|>role<|body|>text</s>`` and a conversation is its turns in
order.  The parser is deterministic: it splits at ``</s>``, takes the part before
``<|body|>`` as role and the rest as text, and takes one backslash off every
escaped control string.  Each turn is first rendered as it is and parsed back; if
the parser doesn't recover the same role and text, it is rendered again with one
backslash put into every control string (and one more into those that look
escaped already), and parsed once more.  A row that still differed would raise an
error; `round_trip` reports the check of the whole conversation.

Defined results: null roles and texts count as empty; rows are ordered by turn
(null first), then role, then text; repeated rows are kept; a null conv_id is a
conversation of its own.  Only a conversation's own rows meet in one task, since
its rendered string is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<|turn|>", "<|body|>", "</s>"
#: Control strings of this template and of common public templates. Each begins with < or [ and has neither further on.
CONTROLS = (OPEN, BODY, CLOSE, "<s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")


def _tails(first: str) -> str:
    return "|".join(c[1:].replace("|", r"\|").replace("]", r"\]") for c in CONTROLS if c[0] == first)


_ANY = rf"(<(?=\\*(?:{_tails('<')}))|\[(?=\\*(?:{_tails('[')})))"
_ESCAPED = rf"(<(?=\\+(?:{_tails('<')}))|\[(?=\\+(?:{_tails('[')})))\\"

_MARK = rf"<(?:{_tails('<')})|\[(?:{_tails('[')})"


def escape(c: Column) -> Column:
    """A backslash after the first character of every control string, escaped ones included."""
    return F.regexp_replace(c, _ANY, r"$1\\")


def unescape(c: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(c, _ESCAPED, "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(BODY), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """A rendered string to an array of (role, text); a null for each piece that the grammar doesn't have."""
    pieces = F.split(formatted, CLOSE.replace("/", r"\/"), -1)
    inner = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        at = F.locate(BODY, p)
        role = F.substring(p, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(p, at + len(BODY), F.length(p))
        # Any further control string in a piece is a mark, not content.
        fits = p.startswith(OPEN) & (at > 0) & ~role.rlike(_MARK) & ~text.rlike(_MARK)
        return F.when(fits, F.struct(unescape(role).alias("role"), unescape(text).alias("text")))

    return F.transform(inner, turn)


def render_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, body (the text as rendered), piece (the turn as rendered), escaped (boolean)."""
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("plain", render(F.col("role"), F.col("text")))
    same = lambda rendered: parse(F.col(rendered)).eqNullSafe(F.array(F.struct("role", "text")))
    rows = rows.withColumn("escaped", ~same("plain"))
    rows = rows.withColumn("careful", F.when(F.col("escaped"), render(escape(F.col("role")), escape(F.col("text")))))
    sure = F.when(same("careful"), F.col("careful")).otherwise(F.raise_error(F.lit("a turn isn't read back as it was")).cast("string"))
    return rows.select(
        "conv_id", "turn", "role", "text", "escaped",
        F.when(F.col("escaped"), escape(F.col("text"))).otherwise(F.col("text")).alias("body"),
        F.when(F.col("escaped"), sure).otherwise(F.col("plain")).alias("piece"),
    )


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, length in code points), n_escaped, round_trip.

    The spans of `loss` cover the rendered text of each turn of `loss_role`.
    """
    turns = render_turns(conversations)
    own = F.struct("turn", "role", "text", "body", "piece", "escaped")
    convs = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    convs = convs.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["piece"]), ""))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["piece"])).alias("at"),
            F.when(
                t["role"] == loss_role,
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(t["piece"]) - len(CLOSE) - F.length(t["body"])).alias("start"), F.length(t["body"]).alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    same = parse(F.col("formatted")).eqNullSafe(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    return convs.select(
        "conv_id", "formatted", spans.alias("loss"), F.size(F.filter("turns", lambda t: t["escaped"])).cast("long").alias("n_escaped"), same.alias("round_trip")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted strings hold, read back from them alone."""
    turns = parse(F.col("formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss_text"), "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_escaped",
        "round_trip",
    )
