"""Typed questions: the small, driver-side description that column plans are made from."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from decidra.functions.text import label_alphabet

TYPES = ("bool", "choice", "score")
MOST_OPTIONS = 255
MOST_LEVELS = 10


class InvalidQuestion(ValueError):
    """A question that breaks the rules of its type."""


FIELDS = ("options", "levels", "yes", "no")
#: The other dialect: its names of types, and which fields its criteria stand for in each.
OTHER_NAMES = {"noul": "bool"}
CRITERIA = {
    "choice": lambda c: {"options": c},
    "score": lambda c: {"levels": c},
    "bool": lambda c: {"yes": c.get("true", c.get("yes")), "no": c.get("false", c.get("no"))} if isinstance(c, dict) else {},
}


@dataclass(frozen=True)
class Question:
    """type: bool, choice or score. options: (key, description or None) in order, choice only. levels: lowest
    first, score only. yes and no: descriptions, bool only."""

    type: str
    instructions: str
    options: tuple[tuple[str, str | None], ...] | None = None
    levels: tuple[str, ...] | None = None
    yes: str | None = None
    no: str | None = None

    def __post_init__(self) -> None:
        problem = self._problem()
        if problem:
            raise InvalidQuestion(problem)

    def _problem(self) -> str | None:
        if self.type not in TYPES:
            return f"{self.type!r} is no type of question"
        if not (self.instructions or "").strip():
            return "a question needs instructions"
        allowed = {"bool": (), "choice": ("options",), "score": ("levels",)}[self.type]
        for name in ("options", "levels"):
            if getattr(self, name) is not None and name not in allowed:
                return f"{name} have no place in a {self.type} question"
        if self.type != "bool" and (self.yes is not None or self.no is not None):
            return "only a bool question describes yes and no"
        if self.type != "bool":
            n, most = len(getattr(self, allowed[0]) or ()), MOST_OPTIONS if self.type == "choice" else MOST_LEVELS
            if not 2 <= n <= most:
                return f"{n} {allowed[0]} given, a {self.type} question has 2 to {most}"
        return None

    @property
    def keys(self) -> list[str]:
        if self.type == "bool":
            return ["yes", "no"]
        if self.type == "choice":
            return [k for k, _ in self.options]
        return [str(i) for i in range(len(self.levels))]

    @classmethod
    def parse(cls, raw: dict[str, Any]) -> Question:
        """From either dialect: options/levels/yes/no, or criteria; noul is another name of bool."""
        kind = OTHER_NAMES.get(raw["type"], raw["type"])
        given = {k: raw.get(k) for k in FIELDS} if raw.get("criteria") is None else CRITERIA.get(kind, lambda c: {})(raw["criteria"])
        options, levels = given.get("options"), given.get("levels")
        if options is not None:
            options = tuple(options.items() if isinstance(options, dict) else ((str(k), None) for k in options))
        return cls(kind, raw["instructions"], options, None if levels is None else tuple(levels), given.get("yes"), given.get("no"))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": self.type, "instructions": self.instructions}
        extra = {"options": dict(self.options or ()) or None, "levels": list(self.levels or ()) or None, "yes": self.yes, "no": self.no}
        return out | {k: v for k, v in extra.items() if v is not None}

    def option_texts(self, with_instructions: bool = False) -> list[str]:
        """One text for each key, for scorers that embed options. The wording is fixed: scorers were trained on it."""
        if self.type == "bool":
            found = [f"Yes: {(self.yes or 'the answer is yes').strip()}", f"No: {(self.no or 'the answer is no').strip()}"]
        elif self.type == "choice":
            found = [k.replace("_", " ") + (f": {d}" if d else "") for k, d in self.options]
        else:
            found = [f"Level {i} of {len(self.levels)}: {x}" for i, x in enumerate(self.levels, 1)]
        head = f"{self.instructions.strip()} " if with_instructions else ""
        return [head + x for x in found]

    def lines(self, order: list[int] | None = None) -> tuple[list[str], dict[int, int]]:
        """Lines of the question's block, and for lines that show an option its canonical index. order: canonical
        indices as displayed. The wording of the block is fixed: models were trained on it."""
        order = list(range(len(self.keys))) if order is None else order
        if sorted(order) != list(range(len(self.keys))):
            raise InvalidQuestion(f"{order} does not show each option once")
        out, shown = [f"\nQuestion: {self.instructions.strip()}"], {}
        if self.type == "bool":
            for i, (word, text) in enumerate((("yes", self.yes), ("no", self.no))):
                if text is not None:
                    shown[len(out)] = i
                    out.append(f"{word}: {text.strip()}")
            return [*out, "Answer (yes or no):"], shown
        out.append("Options:" if self.type == "choice" else "Levels (lowest to highest):")
        for label, i in zip(label_alphabet(len(order)), order, strict=True):
            shown[len(out)] = i
            out.append(f"{label}. {self._shown(i)}")
        return [*out, "Answer:"], shown

    def _shown(self, i: int) -> str:
        if self.type == "score":
            return self.levels[i].strip()
        key, text = self.options[i]
        text = (text or "").strip()
        return key.replace("_", " ") if not text else text if len(key) <= 2 else f"{key.replace('_', ' ')}: {text}"

    def render(self, order: list[int] | None = None) -> str:
        return "\n".join(self.lines(order)[0])


def load_questions(text: str) -> dict[str, Question]:
    """A non-empty JSON object of questions."""
    raw = json.loads(text)
    if not isinstance(raw, dict) or not raw:
        raise InvalidQuestion("a question set is a non-empty object")
    return {name: Question.parse(q) for name, q in raw.items()}


LIMITS = {"questions": 255, "requests": 128, "decisions": 512, "nodes": 256, "agents": 256}


def check_limits(**counts: int) -> None:
    for name, n in counts.items():
        if n > LIMITS[name]:
            raise ValueError(f"{n} {name}, the limit is {LIMITS[name]}")
