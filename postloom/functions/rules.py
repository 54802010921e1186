"""Rule tables: domain words are data, the engine is the same for each board."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern over a field; what it says where it holds. ``unless`` must not hold, ``scrub`` is taken out of the text first."""

    pattern: str
    label: str | None = None
    points: int = 0
    reason: str | None = None
    field: str = "text"
    unless: str | None = None
    scrub: tuple[str, ...] = ()


def holds(rule: Rule, inputs: dict[str, Column]) -> Column:
    """Whether the rule holds of the row; a null field holds nothing."""
    text = F.coalesce(inputs[rule.field], F.lit(""))
    for s in rule.scrub:
        text = F.regexp_replace(text, s, " ")
    hit = text.rlike(rule.pattern)
    return hit & ~text.rlike(rule.unless) if rule.unless else hit


def first_value(rules: Sequence[Rule], inputs: dict[str, Column], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    return F.coalesce(*[F.when(holds(r, inputs), F.lit(r.label)) for r in rules], F.lit(default))


def all_values(rules: Sequence[Rule], inputs: dict[str, Column]) -> Column:
    """Distinct labels of all rules that hold, in their order."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(holds(r, inputs), F.lit(r.label)) for r in rules])))


def total(rules: Sequence[Rule], inputs: dict[str, Column]) -> Column:
    """The sum of points of the rules that hold."""
    return sum((F.when(holds(r, inputs), r.points).otherwise(0) for r in rules), F.lit(0))


def reasons(rules: Sequence[Rule], inputs: dict[str, Column], k: int = 3) -> Column:
    """The first k distinct reasons of the rules that hold."""
    said = [F.when(holds(r, inputs), F.lit(r.reason)) for r in rules if r.reason]
    return F.slice(F.array_distinct(F.array_compact(F.array(*said))), 1, k) if said else F.array().cast("array<string>")


def apply_rules(df: DataFrame, rules: Sequence[Rule], inputs: dict[str, str], *, mode: str = "all", into: str = "label", k: int = 3) -> DataFrame:
    """df with what the rules say: ``first`` the label, ``all`` the labels, ``sum`` the score and up to k reasons."""
    cols = {name: F.col(c) for name, c in inputs.items()}
    if mode == "first":
        return df.withColumn(into, first_value(rules, cols))
    if mode == "all":
        return df.withColumn(into, all_values(rules, cols))
    if mode == "sum":
        return df.withColumn(into, total(rules, cols)).withColumn(f"{into}_reasons", reasons(rules, cols, k))
    raise ValueError(f"mode is first, all or sum, not {mode}")


_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_NO_WORD_AFTER = "(?![A-Za-z0-9_])"
_WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
_BLANK = r"[\s 　]"


def js(pattern: str) -> str:
    """A browser's case-blind pattern in Java's dialect: word edges are ASCII, white space includes the ideographic space."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not inside:
            into, out_of = pattern[i + 2 : i + 3], pattern[i - 1 : i] if pattern[i - 2 : i - 1] != "\\" else ""
            if into and into in _WORD and pattern[i + 3 : i + 4] not in ("?", "*", "{"):
                out.append(f"{into}(?<![A-Za-z0-9_]{into})")  # the letter first, as most places fail by it
                i += 1
            else:
                out.append(_NO_WORD_AFTER if out_of and out_of in _WORD else _EDGE)
            i += 2
        elif two == r"\s":
            out.append(r"\s 　" if inside else _BLANK)
            i += 2
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[:1] == "[") and two[:1] != "]"
            out.append(pattern[i])
            i += 1
    return "(?i)" + "".join(out)


HANGUL = "[가-힣]"


def _alternatives(pattern: str) -> list[tuple[str, bool]]:
    """The alternatives of a pattern, and whether each can't hold without a Hangul letter.

    It can't if it has such a letter, or a group all of whose alternatives can't, that no quantifier follows. Classes and
    lookarounds tell nothing.
    """
    out, opened, start, inside, needs, i = [], [], 0, False, False, 0
    must = lambda i: pattern[i : i + 1] not in ("?", "*", "{")
    while i <= len(pattern):
        c = pattern[i : i + 1]
        if c == "" or (c == "|" and not opened and not inside):
            out.append((pattern[start:i], needs))
            start, needs = i + 1, False
        elif c == "\\":
            i += 1
        elif inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "(":
            opened.append(i)
        elif c == ")":
            body = pattern[opened.pop() + 1 : i]
            body = body[2:] if body.startswith("?:") else body
            needs = needs or (not opened and must(i + 1) and not body.startswith("?") and all(n for _, n in _alternatives(body)))
        elif not opened and "가" <= c <= "힣":
            needs = needs or must(i + 1)
        i += 1
    return out


def without_hangul(pattern: str) -> str | None:
    """The alternatives of a pattern that a text without Hangul may hold, or null if there is none."""
    kept = [p for p, needs in _alternatives(pattern) if not needs]
    return "|".join(kept) if kept else None


def _one_of(text: Column, pattern: str, lowered: bool) -> Column:
    """Whether the text holds a browser's pattern; of a text in lower case plain words are looked for as such."""
    parts = [p for p, _ in _alternatives(pattern)] if lowered else []
    words = [re.fullmatch(r"(?:\\b)?([a-z ]+)(?:\\b)?", p) for p in parts]
    if not parts or not all(words):
        return text.rlike(js(pattern))
    out = F.lit(False)
    for p, word in zip(parts, words, strict=True):
        out |= text.contains(word[1]) if p == word[1] else text.contains(word[1]) & text.rlike(js(p))
    return out


def found(text: Column, pattern: str, *, lowered: bool = False) -> Column:
    """Whether the text, which may be known to be in lower case, holds a browser's pattern.

    A text without Hangul is asked only for the alternatives that it can hold.
    """
    rest = without_hangul(pattern)
    if rest == pattern:
        return _one_of(text, pattern, lowered)
    return F.when(text.rlike(HANGUL), text.rlike(js(pattern))).otherwise(F.lit(False) if rest is None else _one_of(text, rest, lowered))
