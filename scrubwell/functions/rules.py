"""Ordered rewriting rules, folded into Column expressions; the same rules as SQL for other engines.

A rule is ("sub", pattern, replacement) or, for lines, ("drop", pattern).
Patterns keep to what Java and RE2 share; replacements name groups as \\1.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[str, ...]


def _java(replacement: str) -> str:
    return replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2").replace("\\3", "$3").replace("\\4", "$4")


def substitute(text: Column, rules: list[Rule]) -> Column:
    for _, pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, _java(replacement))
    return text


#: Stands for a dropped line until the rules are through.
DROPPED = "\x00"


def rewrite_lines(text: Column, rules: list[Rule], guard: str | None = None) -> Column:
    """Applies the rules to each line; dropped lines go with their line break.

    ``guard``: a pattern that every line a rule can change matches; other lines are
    left at once.
    """

    def one(x: Column) -> Column:
        steps = [("sub", f"^.*(?:{r[1]}).*$", DROPPED) if r[0] == "drop" else r for r in rules]
        done = substitute(x, steps)
        return done if guard is None else F.when(x.rlike(guard), done).otherwise(x)

    return F.array_join(F.filter(F.transform(F.split(text, "\n"), one), lambda x: x != DROPPED), "\n")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_substitute(text: str, rules: list[Rule]) -> str:
    for _, pattern, replacement in rules:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(replacement)}, 'g')"
    return text


def sql_rewrite_lines(text: str, rules: list[Rule]) -> str:
    lines = f"string_split({text}, chr(10))"
    for kind, group in groupby(rules, key=lambda r: r[0]):
        group = list(group)
        if kind == "sub":
            lines = f"list_transform({lines}, lambda x: {sql_substitute('x', group)})"
        else:
            lines = f"list_filter({lines}, lambda x: NOT regexp_matches(x, {sql_text('|'.join(f'(?:{r[1]})' for r in group))}))"
    return f"array_to_string({lines}, chr(10))"
