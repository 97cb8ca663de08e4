"""Requests as rows: bodies in JSON, or the fields of a form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from decidra.schema import LIMITS
from decidra.sources.records import QUESTION, option_keys, state_json


def form_state(text: Column) -> Column:
    """A form's state as JSON: text that starts like an object or list and parses as such is taken as it is, any
    other text is a JSON string."""
    flat = F.trim(text)
    looks = flat.startswith("{") | flat.startswith("[")
    quoted = F.to_json(F.array(text))
    return F.when(looks & F.try_parse_json(flat).isNotNull(), flat).otherwise(quoted.substr(F.lit(2), F.length(quoted) - 2))


def form_options(text: Column) -> Column:
    """(key, text) of lines ``key: description`` or ``key``, blank lines left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    said = lambda x: F.when(F.instr(x, ":") > 0, F.trim(F.substring(x, F.length(F.substring_index(x, ":", 1)) + 2, F.length(x))))
    return F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), said(x).alias("text")))


def parse_requests(bodies: DataFrame) -> DataFrame:
    """request, state, name, qtype, instructions and keys of every question of every request (request, body).

    A request with more questions than allowed, or a body that can't be parsed, gives one row with a problem
    and no question.
    """
    r = F.from_json("body", "questions map<string, string>")
    each = bodies.select("request", state_json(F.col("body")).alias("state"), F.map_entries(r["questions"]).alias("q"))
    n = F.coalesce(F.size("q"), F.lit(-1))
    problem = F.when(n <= 0, "no questions").when(n > LIMITS["questions"], "too many questions")
    each = each.withColumn("problem", problem)
    one = F.explode_outer(F.when(F.col("problem").isNull(), F.col("q"))).alias("e")
    rows = each.select("request", "state", "problem", one).select("request", "state", "problem", F.col("e.key").alias("name"), F.from_json("e.value", QUESTION).alias("q"))
    kind = F.when(F.col("q.type") == "noul", "bool").otherwise(F.col("q.type"))
    return rows.select("request", "state", "name", kind.alias("qtype"), F.col("q.instructions").alias("instructions"), F.when(F.col("q").isNotNull(), option_keys(F.col("q"))).alias("keys"), "problem")


def within_limits(parsed: DataFrame) -> DataFrame:
    """ok and the counts of a batch of requests against what one batch may hold."""
    found = parsed.agg(F.countDistinct("request").alias("requests"), F.count("name").alias("decisions"))
    return found.withColumn("ok", (F.col("requests") <= LIMITS["requests"]) & (F.col("decisions") <= LIMITS["decisions"]))
