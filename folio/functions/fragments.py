"""Expressions that both dialects read alike, as functions of expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable


def any_of(text: str, parts: Iterable[str]) -> str:
    """Does the text hold any of the parts? (Plain substrings, no word boundaries.)"""
    return "(" + " or ".join(f"contains({text}, {literal(p)})" for p in parts) + ")"


def hits(text: str, parts: Iterable[str]) -> str:
    """How many of the parts the text holds."""
    return "(" + " + ".join(f"case when contains({text}, {literal(p)}) then 1 else 0 end" for p in parts) + ")"


def literal(text: str) -> str:
    """A string literal; quotes and braces come from chr, as dialects and templates give them meanings."""
    parts = [f"'{p}'" if len(p) != 1 or p not in "'{}" else f"chr({ord(p)})" for p in re.split("(['{}])", text)]
    return parts[0] if len(parts) == 1 else "(" + " || ".join(parts) + ")"


def word(words: str) -> str:
    """A pattern for any of the words (alternatives joined by |) between ASCII word boundaries, for an operator's text."""
    return f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$$)"


def clamp(x: str, low: str = "0e0", high: str = "1e0") -> str:
    return f"greatest({low}, least({high}, {x}))"


def share(part: str, whole: str) -> str:
    """A ratio that is 0 where the whole is 0."""
    return f"coalesce({part} * 1e0 / nullif({whole}, 0), 0e0)"


def marked(text: str) -> str:
    """Quotation marks of segments: straight double and single, and guillemets."""
    return any_of(text, ['"', "'", "«", "»"])


def dialogue(text: str) -> str:
    """Marks of dialogue for validation: quotation marks, dashes, colon."""
    return any_of(text, ['"', "'", "—", "–", ":"])


def likely_dialogue(text: str) -> str:
    return any_of(text, ['"', "'", "—", "–"])


#: Speakers that name no one.
META = "('unknown', 'AMBIGUOUS', 'narrator')"


def n_words(text: str) -> str:
    """Number of pieces between white space: runs of other characters."""
    return f"length(regexp_replace(regexp_replace({text}, '[^ \t\n\r]+', 'x'$g), '[ \t\n\r]+', ''$g))"
