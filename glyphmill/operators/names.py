"""Many names at once: each literal becomes its full name where the rest of that name doesn't follow already."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that are shipped to the tasks; more are refused.
MOST = 1_000_000


class Names:
    """A trie of literals. A match is the longest literal at a place whose tail doesn't follow; the search goes on behind it."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for literal, name, tail in rules:
            node = self.root
            for c in literal:
                node = node.setdefault(c, {})
            # Of equal literals the smallest rule counts.
            node[""] = min((name, tail), node.get("", (name, tail)))
        self.starts = re.compile("[" + "".join(map(re.escape, sorted(self.root))) + "]") if self.root else re.compile("(?!)")

    def replace(self, text: str) -> tuple[str, int]:
        """The text with full names, and how many literals have changed."""
        out, done, changed, at = [], 0, 0, 0
        while found := self.starts.search(text, at):
            at = place = found.start()
            node, best = self.root, None
            while place < len(text) and (node := node.get(text[place])) is not None:
                place += 1
                if (rule := node.get("")) and not (rule[1] and text.startswith(rule[1], place)):
                    best = place, rule[0]
            if best is None:
                at += 1
                continue
            out += [text[done:at], best[1]]
            changed += text[at : best[0]] != best[1]
            at = done = best[0]
        return "".join([*out, text[done:]]), changed


def full_names(rows: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """rows with `text` in full names and `changed`, how many places of it are new.

    rules(literal, name, tail): a literal stays where `tail` follows it; a null tail is what the name has behind the literal, if it
    begins with it, else nothing.  Literals are looked for from the left, at each place the longest first; what was put in isn't
    looked at again.  A name that is longer than its literals is safe as a literal of itself.  All rules are tried in one pass,
    and the time hardly depends on their number.  Empty and null literals are none, a null name is the literal; a null text stays null.
    """
    tail = F.coalesce("tail", F.when(F.expr("startswith(name, literal)"), F.expr("substring(name, length(literal) + 1)")).otherwise(""))
    own = rules.where("literal <> ''").select("literal", F.coalesce("name", "literal").alias("name"), "tail").select("literal", "name", tail.alias("tail")).distinct()
    known = [tuple(r) for r in own.limit(MOST + 1).toLocalIterator()]
    if len(known) > MOST:
        raise ValueError(f"more than {MOST} names; join them by words instead")

    @F.pandas_udf("text string, changed long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = Names(known)
        for texts in batches:
            done = [(None, None) if t is None else names.replace(t) for t in texts]
            yield pd.DataFrame(done, columns=["text", "changed"]).astype({"changed": "Int64"})

    return rows.withColumn("_named", run(F.col(text))).withColumn(text, F.col("_named.text")).withColumn("changed", F.col("_named.changed")).drop("_named")
