"""Findings by a table of rules: data that is compiled into one array of structs and exploded, in one pass."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule(NamedTuple):
    """A finding: its section and code, when it holds, its figures (SQL expressions over the row), and a sentence
    with {0}, {1}, ... for the figures as whole numbers, or {name} for a column's text."""

    section: str
    code: str
    when: str
    figures: tuple[str, ...]
    text: str


def whole(c: Column) -> Column:
    """A figure in words: rounded half up, thousands apart."""
    return F.format_number(F.round(c, 0), 0)


def sentence(rule: Rule) -> Column:
    parts: list[Column] = []
    for i, piece in enumerate(rule.text.replace("}", "{").split("{")):
        if i % 2 == 0:
            parts.append(F.lit(piece))
        elif piece.isdigit():
            parts.append(whole(F.expr(rule.figures[int(piece)]).cast("decimal(38,6)")))
        else:
            parts.append(F.col(piece).cast("string"))
    return F.concat(*parts)


def found(rows: DataFrame, keys: list[str], rules: tuple[Rule, ...], start: int = 0) -> DataFrame:
    """keys, section, place, code, figures, text of the rules that hold for each row; place: the rule's number in
    the table, from start on. A rule whose condition is null does not hold; a null figure stays null."""
    each = []
    for place, rule in enumerate(rules, start + 1):
        figures = F.array(*[F.expr(x).cast("decimal(29,2)") for x in rule.figures]) if rule.figures else F.array().cast("array<decimal(29,2)>")
        made = F.struct(F.lit(rule.section).alias("section"), F.lit(place).alias("place"), F.lit(rule.code).alias("code"), figures.alias("figures"), sentence(rule).alias("text"))
        each.append(F.when(F.expr(rule.when), made))
    return rows.select(*keys, F.inline(F.array_compact(F.array(*each))))
