"""Exact verdicts over given tables: deadlines with days of grace, and policies as trees of tests."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deadline_verdict(event: Column, due: Column, grace: Column) -> Column:
    """on_time, in_grace or late: days past due at most 0, at most grace, or more."""
    past = F.datediff(event, due)
    return F.when(past <= 0, "on_time").when(past <= grace, "in_grace").otherwise("late")


# --- policies


@dataclass(frozen=True)
class Test:
    """A predicate on one fact. op: gt, ge, lt, le, between, eq, in, true, same, different, has_word."""

    fact: str
    op: str
    value: object = None

    def column(self, facts: dict[str, Column] | None = None) -> Column:
        x = (facts or {}).get(self.fact, F.col(self.fact))
        v = self.value
        if self.op in ("same", "different"):
            other = (facts or {}).get(v, F.col(v))
            return x == other if self.op == "same" else x != other
        if self.op == "has_word":
            return F.array_contains(F.split(F.lower(x), " "), v)
        plain = {"gt": lambda: x > v, "ge": lambda: x >= v, "lt": lambda: x < v, "le": lambda: x <= v, "eq": lambda: x == v, "true": lambda: x}
        if self.op == "between":
            return x.between(*v)
        return x.isin(*v) if self.op == "in" else plain[self.op]()

    def text(self) -> str:
        said = {"gt": "is over", "ge": "is at least", "lt": "is under", "le": "is at most", "eq": "is", "same": "is the same as", "different": "differs from", "has_word": "mentions", "in": "is one of", "between": "is between"}
        name = self.fact.replace("_", " ")
        if self.op == "true":
            return f"{name} holds"
        value = " and ".join(map(str, self.value)) if self.op == "between" else ", ".join(map(str, self.value)) if self.op == "in" else str(self.value).replace("_", " ")
        return f"{name} {said[self.op]} {value}"


@dataclass(frozen=True)
class Rule:
    """all, any or not over tests and rules."""

    how: str
    parts: tuple

    def column(self, facts: dict[str, Column] | None = None) -> Column:
        cols = [p.column(facts) for p in self.parts]
        if self.how == "not":
            return ~cols[0]
        return reduce(lambda a, b: a & b if self.how == "all" else a | b, cols)

    def text(self) -> str:
        if self.how == "not":
            return f"it is not the case that {self.parts[0].text()}"
        return "(" + (" and " if self.how == "all" else " or ").join(p.text() for p in self.parts) + ")"

    def facts(self) -> list[str]:
        found = []
        for p in self.parts:
            found += p.facts() if isinstance(p, Rule) else [p.fact, *([p.value] if p.op in ("same", "different") else [])]
        return list(dict.fromkeys(found))


def depends_on(rule: Rule, fact: str, candidates: list) -> Column:
    """Whether any candidate value of a fact would turn the rule's outcome."""
    base = rule.column()
    flips = [rule.column({fact: F.lit(v)}) != base for v in candidates]
    return F.coalesce(reduce(lambda a, b: a | b, flips), F.lit(False))


def policy_cases(df: DataFrame, rule: Rule, hidden: str | None = None, candidates: list | None = None) -> DataFrame:
    """df with verdict and answerable: a case whose hidden fact could turn the verdict can't be answered."""
    out = df.withColumn("verdict", F.when(rule.column(), "approve").otherwise("reject"))
    known = ~depends_on(rule, hidden, candidates) if hidden else F.lit(True)
    return out.withColumn("answerable", known)
