"""Speakers of single lines by rules in their order: script, tags, presence, actions, thoughts, possessives, proximity.

A rule is a list of patterns and three confidences: for a name that is known, for one that is like a known name, and for
one that only looks like a name. Known names are those of the line's own conversation.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

from folio.functions import fuzzy

#: Verbs of speech, of action beside speech, and of thought.
TAGS = [
    "said",
    "replied",
    "asked",
    "whispered",
    "shouted",
    "muttered",
    "cried",
    "exclaimed",
    "sighed",
    "laughed",
    "continued",
    "added",
    "answered",
    "responded",
    "declared",
    "announced",
    "stated",
    "mentioned",
    "noted",
    "called",
    "yelled",
    "screamed",
    "gasped",
    "breathed",
    "hissed",
    "growled",
    "barked",
    "snapped",
    "drawled",
    "chuckled",
    "giggled",
    "sobbed",
    "wailed",
    "moaned",
    "groaned",
    "nodded",
    "smiled",
    "grinned",
    "frowned",
    "shrugged",
    "gestured",
    "pointed",
    "waved",
    "turned",
    "looked",
    "glanced",
    "stared",
    "thought",
    "wondered",
    "realized",
    "remembered",
    "considered",
    "decided",
    "concluded",
    "assumed",
    "believed",
    "knew",
    "felt",
]
#: Words that are no names, and parts of what names no one in a story.
NO_NAMES = set(
    "the and but for with from into then here there this that what where when why how chapter section part book page "
    "prologue epilogue volume appendix index glossary contents preface foreword introduction author writer editor publisher "
    "translator narrator reader note notes title language credits file unfixable ambiguous unknown unclear missing it he she "
    "they we you i now who or if so text content version draft document".split()
)
NO_NAME_PARTS = ["title", "release", "date", "language", "credits", "produced", "gutenberg", "critic", "analysis", "publisher", "edition", "copyright", "printed", "professor", "scholar", "academic", "reviewer", "editor"]
PARTICLES = {"de", "la", "le", "du", "von", "van", "da", "di", "del"}
_kinds = {
    "N": r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)",
    "T": f"({'|'.join(TAGS)})",
    "S": f"({'|'.join(TAGS[:10])})",
    "A": f"(?:{'|'.join(TAGS[:15])})",
    "K": r"(Kim\s+Dokja|Yoo\s+Sangah|Jung\s+Heewon|Lee\s+Hyunsung|Han\s+Sooyoung|Yu\s+Jonghyuk)",
    "R": r"([A-Z][a-z]*\s+(?:dok|sang|hee|hyun)[a-z]*)",
    "Q": r"[\"'“”]",
}


def _patterns(*texts: str) -> list[re.Pattern]:
    """Patterns with ``<N>`` and the like for their kinds."""
    return [re.compile(re.sub("<([A-Z])>", lambda m: _kinds[m[1]], t), re.IGNORECASE) for t in texts]


#: The forms of dialogue tags, in the order in which they are tried.
TAGGED = _patterns(
    r'"([^"]*),"\s+<N>\s+<T>',
    r'"([^"]*)\.\s*"\s+<N>\s+<T>',
    r'"([^"]*)[!?]\s*"\s+<N>\s+<T>',
    r'<N>\s+<T>,\s*"([^"]*)"',
    r'"([^"]*),"\s+<T>\s+<N>',
    r"<N>\s*[':s]+\s*\"([^\"]*)\"",
    r'<N>\s+<S>[^.]*\.\s*"([^"]*)"',
    r'"([^"]*)",\s*[-–—]\s*<N>',
    r'[–—]\s*"?([^"]*?)"?,?\s+<N>\s+<T>',
    r'"([^"]*)",\s*<K>\s+<T>',
    r'<K>\s+<T>,\s*"([^"]*)"',
    r'"([^"]*)",\s*<R>\s+<T>',
    r'<R>\s+<T>,\s*"([^"]*)"',
    r'I\s+<T>,\s*"([^"]*)"',
    r'"([^"]*)",\s*I\s+<T>',
)
SCRIPT = re.compile(r"^[-–\s]?\s*([A-Z][a-zA-Z0-9_\s\-'.]{1,50}?)(?:,\s*(?:aside|to\s+\w+|from\s+\w+))?\s*:")


@dataclass(frozen=True)
class Rule:
    name: str
    patterns: list[re.Pattern]
    known: float
    like: float
    other: float | None  # None: a name must be known or like a known one
    above: int  # what a ratio must exceed to be like a known name


ACTION = Rule("action", _patterns(r"<N>\s+<A>[^.]*?\.\s*<Q>", r"<N>\s+(?:turned|looked|glanced|stepped|moved|walked)[^.]*?\.\s*<Q>", r"<N>\s+(?:paused|hesitated|waited)[^.]*?\.\s*<Q>"), 0.85, 0.75, 0.65, 80)
THOUGHT = Rule(
    "thought",
    _patterns(r"<N>\s+(?:thought|wondered|realized|remembered|considered|decided|knew|felt|believed)", r"<N>\s+(?:was thinking|had thought|could think|would think)", r"<N>'s\s+(?:mind|thoughts|brain)"),
    0.8,
    0.7,
    0.6,
    75,
)
POSSESSIVE = Rule("possessive", _patterns(r"<N>'s\s+(?:voice|words|response|reply|answer)", r"<N>'s\s+(?:question|statement|comment|remark)"), 0.75, 0.7, None, 80)
TAG = Rule("tag", TAGGED, 0.9, 0.8, 0.7, 80)

Found = tuple[str, float] | None


def name_like(name: str) -> bool:
    """Two to fifty letters, capitals at the start of words but for particles, and nothing that names no one."""
    words = name.split()
    if not 2 <= len(name) <= 50 or not words or name.lower() in NO_NAMES or any(p in name.lower() for p in NO_NAME_PARTS):
        return False
    return bool(re.fullmatch(r"[A-Za-z\s'.-]+", name)) and all(w[0].isupper() or (i and w.lower() in PARTICLES) for i, w in enumerate(words))


def like_known(name: str, known: Iterable[str], above: int, score: Callable = fuzzy.token_set_ratio) -> tuple[str, int] | None:
    """The known name with the best ratio over ``above``; of equal ones the first by name."""
    scored = [(-score(name, k), k) for k in sorted(known)]
    best = min(scored, default=(0, ""))
    return (best[1], -best[0]) if -best[0] > above else None


def _named(rule: Rule, name: str, known: set[str]) -> Found:
    if name in known:
        return name, rule.known
    if found := like_known(name, known, rule.above):
        return found[0], rule.like
    return (name, rule.other) if rule.other is not None and name_like(name) else None


def by_pattern(rule: Rule, text: str, known: set[str]) -> Found:
    """The first pattern whose first group that is a name, and no tag, names someone."""
    for pattern in rule.patterns:
        if m := pattern.search(text):
            groups = [g.strip() for g in m.groups() if g]
            if rule is TAG:
                groups = [g for g in groups if not any(t in g.lower() for t in TAGS) and name_like(g)]
            if groups and (found := _named(rule, groups[0], known)):
                return found
    return None


def by_script(text: str, known: set[str]) -> Found:
    """NAME: text, with 0.2 more than a name in script form has by itself, at most 1."""
    m = SCRIPT.match(text)
    if not m:
        return None
    name = re.sub(r"\s*[\[(].*?[\])]", "", m[1]).strip()
    name = name.title() if name.isupper() and len(name) > 3 else name
    if name in known:
        return name, 1.0
    if found := like_known(name, known, 85):
        return found[0], 1.0
    return (name, 1.0) if name_like(name) else None


def is_dialogue(text: str) -> bool:
    return any(m in text for m in "\"“”'—–")


def by_presence(text: str, known: set[str]) -> Found:
    """The known name with the best ratio over 70 with the whole of a line of dialogue; the confidence is capped."""
    found = like_known(text.lower(), {k.lower() for k in known}, 70) if is_dialogue(text) else None
    return (next(k for k in sorted(known) if k.lower() == found[0]), min(found[1] / 100, 0.6)) if found else None


def by_proximity(text: str, known: set[str]) -> Found:
    """A known name, or a word of it, that a line of dialogue holds, or a stretch of the line that is like it."""
    if not is_dialogue(text):
        return None
    low, found = text.lower(), []
    for name in sorted(known):
        if name.lower() in low:
            found.append((0.85, name))
            continue
        if any(len(p) > 2 and p.lower() in low for p in name.split()):
            found.append((0.7, name))
        if (r := fuzzy.partial_ratio(name.lower(), low)) > 85:
            found.append((r / 100 * 0.6, name))
    best = max(found, key=lambda x: x[0], default=None)
    return (best[1], best[0]) if best else None


def attribute(text: str | None, known: Iterable[str]) -> tuple[str, float, str]:
    """(speaker, confidence, rule) of a line; without a speaker AMBIGUOUS for dialogue and the narrator for the rest."""
    text, known = (text or "").strip(), set(known)
    rules = [("script", by_script), ("tag", lambda t, k: by_pattern(TAG, t, k)), ("presence", by_presence)]
    rules += [(r.name, lambda t, k, r=r: by_pattern(r, t, k)) for r in (ACTION, THOUGHT, POSSESSIVE)] + [("proximity", by_proximity)]
    for rule, f in rules:
        if found := f(text, known):
            return found[0], found[1], rule
    if is_dialogue(text):
        return "AMBIGUOUS", 0.3, "dialogue"
    told = sum(w in text.lower() for w in TAGS[:8]) < 2
    return ("narrator", 0.85, "narrative") if text and len(text) <= 200 and told else ("narrator", 0.6, "other")


def attributed():
    """A column function of texts and arrays of the names that are known to each: struct of speaker, confidence and rule."""

    @F.pandas_udf("struct<speaker: string, confidence: double, rule: string>")
    def run(texts: pd.Series, known: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([attribute(t, [] if k is None else k) for t, k in zip(texts, known)], columns=["speaker", "confidence", "rule"])

    return run
