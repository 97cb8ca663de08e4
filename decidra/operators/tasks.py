"""Column helpers that turn the shapes of public datasets into questions, and questions by rule."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.functions.text import strip
from decidra.schema import Question


def label_name(names: list[str], index: Column) -> Column:
    """The readable name of a class index; null beyond the list."""
    return F.get(F.array(*[F.lit(n.replace("-", "_").replace(" ", "_").lower()) for n in names]), index)


def letters(n: int) -> list[str]:
    return [chr(97 + i) for i in range(n)]


def parsed_list(text: Column) -> Column:
    """A list of strings written with single or double quotes; null if it isn't one."""
    return F.coalesce(F.from_json(text, "array<string>"), F.from_json(F.translate(text, "'", '"'), "array<string>"))


def lettered(options: Column) -> Column:
    """(letter, text) of each of at most 26 options, in order."""
    names = F.array(*[F.lit(x) for x in letters(26)])
    return F.transform(options, lambda x, i: F.struct(F.get(names, i).alias("key"), x.alias("text")))


def entailment(label: Column, order: tuple[str, str, str] = ("entailment", "neutral", "contradiction")) -> Column:
    """Index among entailed, neutral and contradicted of an integer label in the given order, or of a word; null for
    unlabelled rows (-1)."""
    want = ["entailment", "neutral", "contradiction"]
    word = F.coalesce(F.get(F.array(*[F.lit(x) for x in order]), F.when(label.try_cast("int") >= 0, label.try_cast("int"))), F.lower(label.cast("string")))
    short = F.when(F.startswith(word, F.lit("entail")) | F.startswith(word, F.lit("support")), 0).when(F.startswith(word, F.lit("contra")) | F.startswith(word, F.lit("refut")), 2)
    return short.when(word.isin(want[1], "not enough info"), 1)


def last_turn(dialogue: Column, marker: str) -> tuple[Column, Column]:
    """The text before the last marker, and the text behind it. Without a marker all is before."""
    behind = F.when(F.instr(dialogue, marker) > 0, F.substring_index(dialogue, marker, -1)).otherwise(F.lit(""))
    before = F.when(F.instr(dialogue, marker) > 0, F.left(dialogue, F.length(dialogue) - F.length(behind) - len(marker))).otherwise(dialogue)
    return strip(before), strip(behind)


def vote_target(a: Column, b: Column) -> Column:
    """Shares of two vote counts; null without votes."""
    return F.when(a + b > 0, F.array(F.try_divide(a.cast("double"), a + b), F.try_divide(b.cast("double"), a + b)))


def value_target(value: Column, low: float, high: float, levels: int) -> Column:
    """A soft target around a value's place between low and high on a scale of levels."""
    return A.ordinal_target((value - low) / (high - low) * (levels - 1), F.lit(levels))


TRAITS = ["polite", "urgent", "formal", "factual", "angry"]
THINGS = ["message", "text", "request"]
SCALE = ("not at all", "a little", "clearly", "very")


def rubric_bank() -> dict[str, Question]:
    """Questions by rule: for each thing and trait a yes/no question and a score, and a choice of the main trait."""
    out = {}
    for thing, trait in product(THINGS, TRAITS):
        out[f"{thing}_{trait}"] = Question("bool", f"Is this {thing} {trait}?")
        out[f"{thing}_how_{trait}"] = Question("score", f"How {trait} is this {thing}?", levels=tuple(f"{s} {trait}" for s in SCALE))
    for thing in THINGS:
        out[f"{thing}_main"] = Question("choice", f"What is this {thing} most of all?", tuple((t, None) for t in TRAITS))
    return out
