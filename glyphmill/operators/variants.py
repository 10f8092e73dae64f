"""Rows that hold one sentence twice, in two versions: aligned merging, and repair until nothing changes any more."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators.names import Names
from glyphmill.session import durable

# Brackets around and inside rows, what may stand before a second version, and how alike versions must be.
OPENING, CLOSING = "「（(", "」）)"
STOPS = "。，、！？…―ー　 \t"
BLANK = " 　\t"
LEAST_SIDE, LEAST_COMMON, COMMON_SHARE = 4, 6, 0.35
WHOLE_SHARE, WHOLE_BONUS, LOST_RUN = 0.8, 6, 8
LEAST_ONE, LEAST_MERGED, LEAST_LINE = 0.45, 0.75, 0.4
#: Rows of the table of common subsequences that are held at once.
ROWS = 4096


def _rows(x: str, signs: dict[str, int], row: int, full: int) -> list[int]:
    """A row of the table for each character of x, from the row before on."""
    out = []
    for c in x:
        if both := row & signs.get(c, 0):
            row = (row + both | row - both) & full
        out.append(row)
    return out


def common_places(a: str, b: str) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. What both begin and end with is in one; between, a row of the table is one number, whose zero bits are where it rises.

    Rows are held in blocks of `ROWS`: the way back makes each block again from the row before it.
    """
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = next((k for k in range(short - head) if a[-1 - k] != b[-1 - k]), short - head)
    x, y = (t[head : len(t) - tail] for t in (a, b))
    signs: dict[str, int] = {}
    for j, c in enumerate(y):
        signs[c] = signs.get(c, 0) | 1 << j
    full = (1 << len(y)) - 1
    before = [full]
    for k in range(0, len(x) - ROWS, ROWS):
        before.append(_rows(x[k : k + ROWS], signs, before[-1], full)[-1])
    out, i, j = [], len(x), len(y)
    while before and j:
        first = len(before) * ROWS - ROWS
        rows = [before[-1], *_rows(x[first:i], signs, before.pop(), full)]
        value = j - (rows[i - first] & ((1 << j) - 1)).bit_count()
        while value and i > first:
            if (rows[i - first - 1] & ((1 << j) - 1)).bit_count() == j - value:
                i -= 1
            elif rows[i - first] >> (j - 1) & 1:
                j -= 1
            else:
                i, j, value = i - 1, j - 1, value - 1
                out.append((head + i, head + j))
        if not value:
            break
    return [*((k, k) for k in range(head)), *out[::-1], *((len(a) - k, len(b) - k) for k in range(tail, 0, -1))]


def aligned(a: str, b: str) -> tuple[str, int, int]:
    """Both texts as one, how many characters they share, and the longest run that only a has: what both have once, what b has instead of or beside a, and of a what isn't blank where b has nothing."""
    places = common_places(a, b)
    out, lost, i, j = [], 0, 0, 0
    for x, y in [*places, (len(a), len(b))]:
        own, other = a[i:x], b[j:y]
        if not other and own.strip(BLANK):
            lost = max(lost, len(own.strip(BLANK)))
            out.append(own)
        out.append(other)
        out.append(b[y : y + 1])
        i, j = x + 1, y + 1
    return "".join(out), len(places), lost


class Repair:
    """One round of repair for rows with these names. `full` is the name that stays."""

    def __init__(self, names: Iterable[str], full: str, least: int):
        names = sorted({full, *names} - {""}, key=len, reverse=True)
        self.least, self.sign = least, re.compile("|".join(map(re.escape, names)) + r"|[\s\S]" if names else r"[\s\S]")
        self.known = re.compile("|".join(map(re.escape, names))) if names else None
        self.names = set(names)
        self.full = Names([(x, full, full[len(x) :] if full.startswith(x) else "") for x in names if full])

    def plain(self, line: str) -> str:
        """A row's characters with each name as one sign and no blanks."""
        return "".join((self.known.sub("@", line) if self.known else line).split())

    def place(self, line: str, k: int) -> int:
        """Where the k-th sign of the plain row stands in the row."""
        signs = (m.start() for m in self.sign.finditer(line) if m[0] in self.names or not m[0].isspace())
        return next(islice(signs, k, None))

    def repeat(self, line: str) -> int | None:
        """Where the first run of `least` signs that stood before begins."""
        text, least = self.plain(line), self.least
        runs = [text[k : k + least] for k in range(len(text) - least + 1)]
        if len(set(runs)) == len(runs):
            return None
        seen = set()
        for k, own in enumerate(runs):
            if own in seen:
                # Its first appearance comes first in the order of appearances; the earliest second one is this.
                return self.place(line, k)
            seen.add(own)
        return None

    def joined(self, body: str, cut: int, seen: set) -> tuple[int, str, str] | None:
        """Score, text and way of the two versions on both sides of a cut, if they are versions; `seen` are those that have been looked at."""
        before, after = body[cut - 1], body[cut]
        if before not in STOPS + OPENING + CLOSING and after not in OPENING:
            return None
        a, b = body[:cut].strip(BLANK), body[cut:].strip(BLANK)
        a = re.sub(f"(?<=..)[{re.escape(OPENING + CLOSING + BLANK)}]+$", "", a, flags=re.S)
        b = re.sub(f"^[{re.escape(OPENING + CLOSING + BLANK)}]+(?=..)", "", b, flags=re.S)
        if min(len(a), len(b)) < LEAST_SIDE or (a, b) in seen:
            return None
        seen.add((a, b))
        # As many characters as both have at all bound what they share in order.
        least = max(LEAST_COMMON, COMMON_SHARE * min(len(a), len(b)))
        if (Counter(a) & Counter(b)).total() < least:
            return None
        both, common, lost = aligned(a, b)
        if common < least:
            return None
        one = b if len(b) >= len(a) and common >= WHOLE_SHARE * len(a) else a if len(a) >= len(b) and common >= WHOLE_SHARE * len(b) else None
        if one is None:
            return (common, both, "merged") if lost < LOST_RUN and len(both) >= LEAST_MERGED * len(body) else None
        if len(one) < LEAST_ONE * len(body) or self.repeat(one) is not None:
            return None
        return common + WHOLE_BONUS, one, "second" if one is b else "first"

    def once(self, line: str) -> tuple[str, str | None]:
        """The row after one round, and what was done; the row itself where nothing is better."""
        head = line[: len(line) - len(line.lstrip(OPENING))]
        tail = line[len(head) :][len(line[len(head) :].rstrip(CLOSING)) :]
        body = line[len(head) : len(line) - len(tail)]
        cuts = [] if (at := self.repeat(body)) is None else [at]
        cuts += [k + 1 for k, c in enumerate(body) if c in "「」"]
        seen: set = set()
        found = [x for cut in cuts if 0 < cut < len(body) and (x := self.joined(body, cut, seen))]
        if not found:
            return line, None
        _, text, how = max(found, key=lambda x: x[0])
        new = head + self.full.replace(text)[0].strip(BLANK) + tail
        even = all(new.count(a) == new.count(b) for a, b in zip(OPENING[:2], CLOSING[:2]))
        return (new, how) if even and new != line and new.strip(OPENING + CLOSING) else (line, None)


def repaired(rows: DataFrame, names: Iterable[str], full: str, least: int = 10, rounds: int = 3, key: str = "doc_id") -> DataFrame:
    """key, line_no, line, how of rows(key, line_no, line): rows that hold two versions of one sentence as one; how tells what each round did, null what stays.

    `names` are other forms of the name `full`.  Where a run of `least` characters comes again (names count as one, blanks as none), or at an
    inner quote, a row is cut in two.  If one side holds four fifths of the other it is taken, else both are aligned character by character.
    A round looks only at rows that the one before has changed.  A row that still repeats itself at the end, isn't balanced or has
    lost more than three fifths of its length stays as it was.
    """
    repair = Repair(names, full, least)

    @F.pandas_udf("line string, how string")
    def run(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in lines:
            yield pd.DataFrame([repair.once(x) for x in some], columns=["line", "how"])

    # A filter on what it gives would run it once more for the rows that stay.
    run = run.asNondeterministic()

    @F.pandas_udf("boolean")
    def repeats(lines: pd.Series) -> pd.Series:
        return lines.map(lambda x: repair.repeat(x) is not None)

    # Only what holds a quote inside or is long enough to repeat itself can change.
    rows = rows.select(key, "line_no", "line")
    may = (F.length("line") >= 2 * least) | F.col("line").rlike("(?s).[「」].")
    open_ = durable(rows.where(may).withColumn("_id", F.monotonically_increasing_id()).select("_id", key, "line_no", F.col("line").alias("before"), F.col("line").alias("line"), F.lit("").alias("how")))
    changed = None
    for turn in range(rounds):
        told = open_.withColumn("s", run("line")).where("s.how IS NOT NULL")
        open_ = durable(told.select("_id", key, "line_no", "before", F.col("s.line").alias("line"), F.concat_ws("+", F.when(F.col("how") != "", F.col("how")), "s.how").alias("how"), F.lit(turn).alias("round")))
        changed = open_ if changed is None else changed.unionByName(open_)
        if open_.isEmpty():
            break
    even = F.lit(True)
    for a, b in zip(OPENING[:2], CLOSING[:2]):
        even = even & (T.pair_difference(F.col("line"), a, b) == 0)
    last = changed.groupBy("_id", key, "line_no", "before").agg(F.max(F.struct("round", "line", "how")).alias("s")).select("_id", key, "line_no", "before", "s.line", "s.how")
    good = last.where(even & (F.length("line") >= LEAST_LINE * F.length("before"))).where(~repeats("line"))
    good = durable(good.select(key, "line_no", "before", F.col("line").alias("new"), "how").distinct())
    own = good.select(key, "line_no", F.col("before").alias("line"), "new", "how")
    return rows.join(own, [key, "line_no", "line"], "left").select(key, "line_no", F.coalesce("new", "line").alias("line"), "how")
