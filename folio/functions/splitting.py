"""Splitting of text that keeps state: sentences outside quotations, packing by size, long lines."""

from __future__ import annotations

import re
from collections.abc import Callable

LONGEST, SHORTEST, LONG_LINE = 350, 10, 500
BREAK = re.compile(r"[.!?]+")


def sentences(text: str) -> list[str]:
    """Pieces that end in . ! or ? before white space and a capital or quotation mark, never inside a quotation."""
    out, start, inside = [], 0, False
    for i, c in enumerate(text):
        if c == '"':
            inside = not inside
        ends = c in ".!?" or (c == '"' and not inside and i and text[i - 1] in ".!?,")
        if not ends or inside:
            continue
        rest = text[i + 1 :].lstrip() if i + 1 < len(text) and text[i + 1].isspace() else None
        if rest and (rest[0].isupper() or rest[0] == '"'):
            out.append(text[start : i + 1].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [p for p in out if p]


def packed(parts: list[str], most: int = LONGEST) -> list[str]:
    """Neighbours joined by a space as long as they stay within ``most`` characters."""
    out: list[str] = []
    for p in parts:
        if out and len(out[-1]) + 1 + len(p) <= most:
            out[-1] = f"{out[-1]} {p}"
        else:
            out.append(p)
    return out


def by_quotation(text: str) -> list[str]:
    return [p.strip() for p in re.split(r'("[^"]*")', text) if p.strip()]


def by_speaker(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"(?<=[.!?\"])\s+(?=[A-Z][a-z]+ (?:said|asked|replied)\b)", text) if p.strip()]


def by_action(text: str) -> list[str]:
    return [p.strip() for p in re.split(r"(?<=[.!?])\s+(?=(?:Then|Suddenly|Meanwhile|Later)\b)", text) if p.strip()]


def good(parts: list[str], text: str) -> bool:
    """Two to six parts, most of them of some length, none over the longest by a fifth, and nothing lost."""
    kept = sum(map(len, parts))
    return 2 <= len(parts) <= 6 and 0.9 * len(text) <= kept <= 1.1 * len(text) and sum(len(p) >= SHORTEST for p in parts) >= 0.8 * len(parts) and max(map(len, parts)) <= 1.2 * LONGEST


CASCADE: list[Callable[[str], list[str]]] = [by_quotation, by_speaker, by_action, sentences]


def split_segment(text: str) -> list[str]:
    """A segment that is too long, by the first strategy whose parts are good; else by packed sentences."""
    text = text.strip()
    if len(text) <= LONGEST:
        return [text] if text else []
    for strategy in CASCADE:
        if good(parts := strategy(text), text):
            return parts
    return packed(sentences(text))


def split_line(text: str, most: int = 250) -> list[str]:
    """A line over 500 characters: at quotations, else at commas, else at words."""
    if len(text) <= LONG_LINE:
        return [text]
    if '"' in text:
        return by_quotation(text)
    parts = [f"{p.strip()}," for p in text.split(",")] if "," in text else text.split()
    return [p.rstrip(",") for p in packed([p for p in parts if p], most)]


DIALOGUE_MARKS = '"“”\'—–'
MIXED_FROM, MIXED_SHARE, ADVANCED_FROM, LONG_DIALOGUE = 150, 0.2, 100, 300
TRANSITIONS = [
    re.compile(r'"[^"]*",?\s+[A-Z][a-z]+\s+(?:said|asked|replied|whispered|shouted)'),
    re.compile(r'[A-Z][a-z]+\s+(?:said|asked|replied|whispered|shouted)[^.]*\.\s*"'),
    re.compile(r'"[^"]*"\s*[-–—]\s*[A-Z][a-z]+'),
]


def _parted(text: str, marks: str) -> tuple[list[str], list[str]]:
    """Sentences with a mark of dialogue, and those without."""
    with_marks, without = [], []
    for s in sentences(text):
        (with_marks if any(m in s for m in marks) else without).append(s)
    return with_marks, without


def mixed(text: str) -> bool:
    """Over 150 characters of which dialogue and narrative have over a fifth each."""
    talk, prose = (sum(map(len, x)) for x in _parted(text, DIALOGUE_MARKS))
    return len(text) > MIXED_FROM and min(talk, prose) > MIXED_SHARE * (talk + prose)


def needs_advanced(text: str) -> bool:
    """Two changes of speaker, two sentences of either kind, or dialogue in a segment of over 300 characters."""
    if len(text) < ADVANCED_FROM:
        return False
    talk, prose = map(len, _parted(text, DIALOGUE_MARKS.replace("–", "")))
    return sum(len(p.findall(text)) for p in TRANSITIONS) >= 2 or min(talk, prose) >= 2 or (talk > 0 and len(text) > LONG_DIALOGUE)


def _soft_end(piece: str, last: int) -> int | None:
    """The last end of a paragraph, else of a sentence, among the ``last`` characters of a piece."""
    for pattern, after in ((r"\n\n", 2), (r"[.!?]\s+", 1)):
        found = [m.start() for m in re.finditer(pattern, piece[max(0, len(piece) - last) :])]
        if found:
            return max(0, len(piece) - last) + found[-1] + after
    return None


def scene_chunks(text: str, breaks: list[int], size: int = 2500, shared: int = 500) -> list[str]:
    """Chunks of at most ``size`` characters.

    One ends at the first break in its last fifth or its last ``shared`` characters, and the next begins there.
    Others end at the last paragraph or sentence of their last ``shared`` characters, and the next begins
    ``shared`` characters before the full size.
    """
    chunks, at, n = [], 0, len(text)
    breaks = sorted(set(breaks))
    while at < n:
        full = min(at + size, n)
        scene = next((b for b in breaks if at < b < full and (b > at + 0.8 * size or b > full - shared)), None)
        piece = text[at : scene or full]
        soft = _soft_end(piece, shared) if scene is None and full < n else None
        chunks.append(piece[:soft].strip())
        at = scene or (full if full == n else full - shared)
    return chunks
