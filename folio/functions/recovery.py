"""Speakers for segments that no rule could give one: six strategies, each more careful than the one before."""

from __future__ import annotations

import re
from collections import Counter

from folio.functions import fuzzy
from folio.functions.cascade import is_dialogue, like_known

NOBODY = ("AMBIGUOUS", "UNFIXABLE", "narrator", "unknown", "")
SPOKE = "(?:said|asked|replied|whispered|shouted)"
NAME = r"([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)"
STRONG = [re.compile(p) for p in (rf'"[^"]*",?\s+{NAME}\s+{SPOKE}', rf'{NAME}\s+{SPOKE}[^.]*\.\s*"[^"]*"', rf'"[^"]*",?\s*[-–—]\s*{NAME}')]
OWNED = re.compile(rf"{NAME}'s\s+(?:voice|words|response|question)")
#: Marks and words that count for dialogue and for narrative.
DIALOGUE = ['"', "“", "”", "'", "—", "–"]
NARRATIVE = [" was ", " were ", " had ", " the ", " then ", " while "]
NARRATIVE_FORMS = [re.compile(p, re.I) for p in (r"\b(?:he|she|they)\s+(?:was|were|had|would|could)\b", r"\bthe\s+\w+\s+(?:walked|looked|turned|stepped|moved)\b", r"\b(?:was|were)\s+\w+ing\b")]
LIKE, NEAR, HABIT = 85, 60, 15


def by_name(text: str, names: list[str]) -> str | None:
    """A tag or a possessive that names someone known, or someone like them."""
    for m in filter(None, (p.search(text) for p in STRONG)):
        if m[1] in names:
            return m[1]
        if found := like_known(m[1], names, LIKE, fuzzy.ratio):
            return found[0]
    m = OWNED.search(text)
    return m[1] if m and m[1] in names else None


def by_context(text: str, before: list[str], after: list[str]) -> str | None:
    """Dialogue alternates: the latest other speaker than the last of the two before. Else the most frequent one around, the first to come."""
    around = [s for s in before + after if s not in NOBODY]
    last = [s for s in before[-2:] if s not in NOBODY]
    if is_dialogue(text) and last and (others := [s for s in around if s != last[-1]]):
        return others[-1]
    return Counter(around).most_common(1)[0][0] if around else None


def by_content(text: str) -> str | None:
    talk = sum(text.count(m) for m in DIALOGUE)
    prose = sum(text.lower().count(w) for w in NARRATIVE) + 2 * sum(len(p.findall(text)) for p in NARRATIVE_FORMS)
    if not talk + prose:
        return None
    share = prose / (talk + prose)
    if share > 0.7 or (share > 0.5 and not any(m in text for m in '"“”')):
        return "narrator"
    return "AMBIGUOUS" if talk > prose else None


def by_nearness(text: str, before: list[dict], after: list[dict]) -> str | None:
    """The speaker of the neighbour that is most like the segment, less 5 a step, 20 more if both are dialogue or neither."""
    best, found = NEAR, None
    for step in range(1, 6):
        for near in ([before[-step]] if step <= len(before) else []) + ([after[step - 1]] if step <= len(after) else []):
            if near["speaker"] in ("AMBIGUOUS", "UNFIXABLE", ""):
                continue
            like = fuzzy.partial_ratio(text.lower(), (near["text"] or "").lower()) + 20 * (is_dialogue(text) == is_dialogue(near["text"] or "")) - 5 * step
            if like > best:
                best, found = like, near["speaker"]
    return found


def by_habit(text: str, habits: list[dict]) -> str | None:
    """The speaker whose words, length and kind of lines the segment shares most, over 15 points."""
    words = set(re.findall(r"\w+", text.lower()))
    points = [(2 * len(words & set([] if h["words"] is None else h["words"])) + 5 * (abs(len(text) - h["size"]) < 50) + 10 * (is_dialogue(text) == (h["talk"] > 0.5)), h["speaker"]) for h in habits]
    best = max(points, key=lambda p: p[0], default=(0, None))
    return best[1] if best[0] > HABIT else None


def fallback(text: str) -> str | None:
    if any(m in text for m in '"“”'):
        return "AMBIGUOUS"
    return "narrator" if any(p.search(text) for p in NARRATIVE_FORMS) or not any(m in text for m in "'—") else None


def recover(text: str, before: list[dict], after: list[dict], habits: list[dict]) -> tuple[str, str]:
    """(speaker, strategy); UNFIXABLE if none of the six has an answer. Neighbours have speaker and text, habits words, size and talk too."""
    names = sorted({h["speaker"] for h in habits})
    first, last = ([n["speaker"] or "" for n in x] for x in (before, after))
    tries = [
        ("name", lambda: by_name(text, names)),
        ("context", lambda: by_context(text, first, last)),
        ("content", lambda: by_content(text)),
        ("nearness", lambda: by_nearness(text, before, after)),
        ("habit", lambda: by_habit(text, habits)),
        ("fallback", lambda: fallback(text)),
    ]
    return next(((found, name) for name, f in tries if (found := f())), ("UNFIXABLE", "none"))
