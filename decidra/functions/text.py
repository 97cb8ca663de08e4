"""Column functions for texts that a scorer reads."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"


def strip(text: Column) -> Column:
    """Without white space (in Unicode's sense) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, BLANK, " "))


def clip_text(text: Column, most: int) -> Column:
    """White space collapsed; beyond most characters cut, the last partial word dropped, and `` ...`` added."""
    flat = collapse(text)
    head = F.regexp_replace(F.left(flat, F.lit(most)), " [^ ]*$", "")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(head, F.lit(" ...")))


def display_key(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(" "))


def option_line(label: Column, key: Column, desc: Column) -> Column:
    said = strip(F.coalesce(desc, F.lit("")))
    body = F.when(said == "", display_key(key)).when(F.length(key) <= 2, said).otherwise(F.concat(display_key(key), F.lit(": "), said))
    return F.concat(label, F.lit(". "), body)


def label_alphabet(n: int) -> list[str]:
    """The first n display labels: A..Z, then AA, AB, ... There are 702."""
    letters = [chr(65 + i) for i in range(26)]
    every = letters + [a + b for a in letters for b in letters]
    if n > len(every):
        raise ValueError(f"{n} labels, there are {len(every)}")
    return every[:n]


@dataclass(frozen=True)
class Alphabet:
    """Display labels that a tokenizer writes as one token each (behind a blank), their ids, and the ids of yes and no."""

    labels: tuple[str, ...]
    ids: tuple[int, ...]
    yes: int
    no: int

    @classmethod
    def of(cls, encode: Callable[[str], list[int]], size: int = 255) -> Alphabet:
        """The first ``size`` such labels. A tokenizer that has fewer of them, or needs several tokens for yes or no, is an error."""
        single = {word: ids[0] for word in [*label_alphabet(702), "yes", "no"] if len(ids := encode(f" {word}")) == 1}
        lost = {"yes", "no"} - single.keys()
        labels = [w for w in single if w not in ("yes", "no")][:size]
        if lost or len(labels) < size:
            raise ValueError(f"{len(labels)} labels of one token, {size} are needed; more than one for {sorted(lost)}")
        return cls(tuple(labels), tuple(single[w] for w in labels), single["yes"], single["no"])

    def option_ids(self, qtype: Column, n: Column) -> Column:
        """The ids whose logits answer a question of n options, for arrays.label_readout."""
        return F.when(qtype == "bool", F.array(F.lit(self.yes), F.lit(self.no))).otherwise(F.slice(F.array(*[F.lit(i) for i in self.ids]), F.lit(1), n))


def _rendered(value) -> str:
    return value.strip() if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def render_json(raw: str | None) -> str | None:
    """The text of a state given as JSON: text as it is, an object as ``key: value`` lines, a list as numbered lines."""
    if raw is None:
        return None
    state = json.loads(raw)
    if isinstance(state, dict):
        return "\n".join(f"{k}: {_rendered(v)}" for k, v in state.items())
    if isinstance(state, list):
        return "\n".join(f"{i}. {_rendered(v)}" for i, v in enumerate(state, 1))
    return _rendered(state)


def render_state(state_json: Column) -> Column:
    """Strings and scalars are rendered in the JVM's own JSON only for text; objects and lists go through Python,
    whose spacing and number format are part of the rendering."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([render_json(v) for v in values.to_pylist()], pa.string())

    return F.arrow_udf(run, returnType="string")(state_json)
