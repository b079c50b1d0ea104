"""Prompts for a language model, a ladder of them, and what its answers are read as."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

#: What a prompt says before and after the numbered lines, by family.
FAMILIES = {
    "standard": ("Name the speaker of each of these {n} lines.{known}", "Answer with a JSON array of {n} names."),
    "pov": ("The text is told in the {pov} person. Name the speaker of each of these {n} lines.{known}", "Lines of the one who tells are theirs, not the narrator's. Answer with a JSON array of {n} names."),
    "batch": ("Several passages follow, {n} lines in all. Name the speaker of each line.{known}", "Keep the order. Answer with one JSON array of {n} names."),
    "reasoning": ("STEP 1: look for tags. STEP 2: look at who spoke before. STEP 3: decide for each of these {n} lines.{known}", "Give your confidence, then FINAL ANSWER: and a JSON array of {n} names."),
    "agentic": ("Plan, check and correct: first mark dialogue, then name the speaker of each of these {n} lines, then look for contradictions.{known}", "Answer with a JSON array of {n} names only."),
    "correction": ("The last answer did not have {n} names. Name the speaker of each of these {n} lines again.{known}", "Nothing but a JSON array of {n} names."),
}
#: The families that are tried one after the other.
LADDER = ["standard", "reasoning", "agentic", "correction"]
#: Below these scores of complexity: the families that begin; above the last one, the last family.
BY_COMPLEXITY = [(2.0, "standard"), (4.0, "pov"), (7.0, "reasoning")]
AMBIGUOUS = "AMBIGUOUS"


def prompt(family: str, lines: list[str], known: list[str] | None = None, pov: str = "third") -> str:
    head, tail = FAMILIES[family]
    names = f" Known: {', '.join(sorted(known))}." if known else ""
    numbered = "\n".join(f"{i}. {x}" for i, x in enumerate(lines, 1))
    return "\n".join((head.format(n=len(lines), known=names, pov=pov), numbered, tail.format(n=len(lines))))


def complexity(lines: list[str]) -> float:
    """Points for many lines, long ones, several quotations in one and dashes."""
    return len(lines) / 5 + sum(len(x) > 200 for x in lines) + sum(x.count('"') > 2 for x in lines) + sum("—" in x for x in lines) / 2


def first_family(lines: list[str]) -> str:
    points = complexity(lines)
    return next((f for below, f in BY_COMPLEXITY if points < below), "agentic")


def repaired(text: str) -> str:
    """JSON as models write it: curly or single quotation marks, commas before brackets, names without marks, a bracket that lacks."""
    text = re.sub(r"[“”]", '"', text.strip())
    text = re.sub(r"(?<=[\[,])\s*'((?:[^']|'(?=\w))*)'\s*(?=[,\]]|$)", r'"\1"', text)
    text = re.sub(r"(?<=[\[,])\s*([A-Za-z][\w .'-]*?)\s*(?=[,\]]|$)", r'"\1"', text)
    text = re.sub(r",\s*(?=\]|$)", "", text)
    return text if text.endswith("]") else text + "]"


def _names(values: list) -> list[str]:
    return [AMBIGUOUS if not isinstance(v, str) or v.strip().lower() in ("", "unknown", "unclear", "none") else v.strip() for v in values]


def parsed(answer: str | None) -> list[str]:
    """Names in an answer: the last array in it, an object's speakers, or a name a line; none if there is nothing of the kind."""
    answer = re.sub(r"```(?:json)?", "", answer or "")
    found = re.findall(r"\[[^\[\]]*\]?", answer)
    for part in reversed(found):
        for text in (part, repaired(part)):
            try:
                if isinstance(values := json.loads(text), list):
                    return _names(values)
            except ValueError:
                continue
    lines = [x.strip() for x in answer.splitlines() if x.strip() and not x.strip().startswith(("#", "//"))]
    named = [re.sub(r"^\d+[.)]\s*", "", x).partition(":")[0].strip() for x in lines]
    return _names(named) if named and all(re.fullmatch(r"[\w .'-]{1,50}", x) for x in named) else []


def through(model: Callable[[str], str], known: list[str] | None = None, most: int = 20) -> Callable[[list[str]], list[str]]:
    """A scorer that asks ``model`` with one prompt after the other until an answer has a name for each line.

    More than ``most`` lines are asked in parts. When no prompt of the ladder gets a name for each, two halves are asked
    for themselves; a line that is alone and stays without one is AMBIGUOUS.
    """

    def ask(lines: list[str]) -> list[str]:
        if len(lines) > most:
            return [x for i in range(0, len(lines), most) for x in ask(lines[i : i + most])]
        first = first_family(lines)
        for family in [first, *[f for f in LADDER if f != first]]:
            if len(found := parsed(model(prompt(family, lines, known)))) == len(lines):
                return found
        if len(lines) < 2:
            return [AMBIGUOUS] * len(lines)
        half = len(lines) // 2
        return ask(lines[:half]) + ask(lines[half:])

    return ask
