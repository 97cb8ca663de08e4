"""Question records as JSON lines, in and out, and scored predictions.

Lines are read as text and parsed with fixed schemas; states, labels and targets stay raw JSON until their
type is known, so nothing is inferred and the order of keys is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.functions.text import strip
from decidra.sources.files import written

SCORED = "item_id string, probs array<double>, target array<double>, label_index int, qtype string, source string, answerable boolean, evidence double"
RECORD = "state string, questions map<string, string>, meta string, _meta string"
QUESTION = "type string, instructions string, options string, levels string, criteria string, yes string, no string, label string, target map<string, double>, answerable boolean, src string, source string"


#: Most splits whose starts are broadcast.
SPLITS = 500_000


def lines(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """line (number within its file, from 0), file and value of every line that isn't blank. across: the files of a folder are one
    file in pieces, in the order of their names, and numbers go on from one to the next.

    Files are split as Spark splits them: a first pass counts the lines of each split, whose table (a row a split)
    gives the second pass the number of its first line. It is broadcast up to SPLITS rows, joined by a shuffle beyond.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id")]
    each = spark.read.text(path, lineSep="\n").select("value", *place)
    counts = each.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    order = Window.orderBy("file", "_at") if across else Window.partitionBy("file").orderBy("_at")  # a row a split
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = written(counts.select(F.col("file").alias("_file"), F.col("_at").alias("_from"), (F.coalesce(upto, F.lit(0)) - F.col("_first")).alias("_start")))
    small = starts.limit(SPLITS + 1).count() <= SPLITS
    joined = each.join(F.broadcast(starts) if small else starts, (F.col("file") == F.col("_file")) & (F.col("_at") == F.col("_from")))
    number = (F.col("_id") + F.col("_start")).cast("long" if across else "int")
    return joined.select("file", number.alias("line"), "value").where(F.trim("value") != "")


def state_json(value: Column) -> Column:
    """The raw JSON of ``state`` as written: strings keep their quotes, objects their key order."""
    raw = F.get_json_object(value, "$.state")
    kind = F.schema_of_variant(F.variant_get(F.try_parse_json(value), "$.state", "variant"))
    return F.when(kind == "STRING", F.to_json(F.struct(raw.alias("s"))).substr(F.lit(6), F.length(F.to_json(F.struct(raw.alias("s")))) - 6)).otherwise(raw)


def read_states(df: DataFrame, limit: int | None = None) -> DataFrame:
    """id, state (raw JSON), expected of apply-time lines. A line that is an object with ``state`` is a record with
    meta.id and expected; any other line is a state itself. The id defaults to the line's number; limit counts
    lines that aren't blank."""
    is_record = F.startswith(F.trim("value"), F.lit("{")) & F.get_json_object("value", "$.state").isNotNull()
    out = df.select(
        F.coalesce(F.when(is_record, F.get_json_object("value", "$.meta.id")), F.col("line").cast("string")).alias("id"),
        F.when(is_record, state_json(F.col("value"))).otherwise(F.trim("value")).alias("state"),
        F.when(is_record, F.get_json_object("value", "$.expected")).alias("expected"),
        "file", "line",
    )
    return out if limit is None else out.orderBy("file", "line").limit(limit)


def option_keys(q: Column) -> Column:
    """Keys of a parsed question in order: yes and no, option names, or level numbers."""
    given = F.coalesce(q["criteria"], q["options"])
    names = F.coalesce(F.json_object_keys(given), F.from_json(given, "array<string>"))
    n_levels = F.json_array_length(F.coalesce(q["criteria"], q["levels"]))
    numbers = F.transform(F.sequence(F.lit(0), n_levels - 1), lambda i: i.cast("string"))
    kind = F.when(q["type"] == "noul", "bool").otherwise(q["type"])
    return F.when(kind == "bool", F.array(F.lit("yes"), F.lit("no"))).when(kind == "choice", names).otherwise(numbers)


def label_position(kind: Column, keys: Column, label: Column) -> Column:
    """Index of a label: truth words and numbers for bool, the number for score, the key for choice."""
    word = F.lower(F.trim(label))
    truthy = word.isin("true", "yes", "1") | (word.try_cast("double").isNotNull() & (word.try_cast("double") != 0))
    return F.when(kind == "bool", F.when(truthy, 0).otherwise(1)).when(kind == "score", label.try_cast("int")).otherwise(F.array_position(keys, label).cast("int") - 1)


def parse_records(df: DataFrame) -> DataFrame:
    """One row for each question of each record: file, line, state, name, qtype, instructions, keys, label_index,
    target, answerable, source and problem (null for a sound question, else why it can't be used)."""
    rec = df.select("file", "line", state_json(F.col("value")).alias("state"), F.from_json("value", RECORD).alias("r"))
    meta = F.coalesce(F.col("r.meta"), F.col("r._meta"))
    each = rec.select("file", "line", "state", F.coalesce(F.get_json_object(meta, "$.source"), F.lit("unknown")).alias("default"), F.explode(F.map_entries("r.questions")).alias("e"))
    q = F.col("q")
    parsed = each.select("file", "line", "state", "default", F.col("e.key").alias("name"), F.from_json("e.value", QUESTION).alias("q"))
    kind = F.when(q["type"] == "noul", "bool").otherwise(q["type"])
    out = parsed.withColumn("qtype", kind).withColumn("keys", option_keys(q))
    out = out.withColumn("label_index", label_position(F.col("qtype"), F.col("keys"), q["label"]))
    raw = F.transform("keys", lambda k: F.coalesce(F.try_element_at(q["target"], k), F.lit(0.0)))
    has = q["target"].isNotNull() & (F.size(q["target"]) > 0)
    out = out.withColumn("raw", raw)
    target = F.when(has, A.normalise(F.col("raw"))).otherwise(A.one_hot(F.col("label_index"), F.size("keys")))
    n = F.size("keys")
    problem = (
        F.when(~F.coalesce(F.col("qtype").isin("bool", "choice", "score"), F.lit(False)), "no such type of question")
        .when(strip(F.coalesce(q["instructions"], F.lit(""))) == "", "no instructions")
        .when((F.col("qtype") == "choice") & ~F.coalesce(n.between(2, 255), F.lit(False)), "choice takes 2 to 255 options")
        .when((F.col("qtype") == "score") & ~F.coalesce(n.between(2, 10), F.lit(False)), "score takes 2 to 10 levels")
        .when((F.col("qtype") == "choice") & q["levels"].isNotNull(), "levels in a choice")
        .when((F.col("qtype") != "choice") & q["options"].isNotNull(), "options outside a choice")
        .when((F.col("qtype") != "bool") & (q["yes"].isNotNull() | q["no"].isNotNull()), "yes or no described outside a bool")
        .when(has & (A.total(F.col("raw")) <= 0), "empty target")
        .when(~F.coalesce(F.col("label_index").between(0, n - 1), F.lit(False)), "the label is not an option")
    )
    return out.select(
        "file", "line", "state", "name", "qtype", q["instructions"].alias("instructions"), "keys", "label_index", target.alias("target"),
        F.coalesce(q["answerable"], F.lit(True)).alias("answerable"), F.coalesce(q["src"], q["source"], F.col("default")).alias("source"), problem.alias("problem"),
    )


def read_records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """limit counts the lines of each file as they are, blank ones too."""
    found = lines(spark, path)
    return parse_records(found if limit is None else found.where(F.col("line") < limit))


def record_json(state: Column, questions: Column, meta: Column) -> Column:
    """A record's line from raw JSON state, a (name, raw JSON) array and raw JSON meta."""
    body = F.array_join(F.transform(questions, lambda q: F.concat(F.to_json(F.array(q["name"])).substr(F.lit(2), F.length(F.to_json(F.array(q["name"]))) - 2), F.lit(": "), q["json"])), ", ")
    return F.concat(F.lit('{"state": '), state, F.lit(', "questions": {'), body, F.lit('}, "meta": '), meta, F.lit("}"))


def write_scored(scored: DataFrame, path: str) -> None:
    """Scored rows as JSON lines; probabilities, targets and evidence rounded to 6 digits."""
    short = lambda c: F.transform(c, lambda x: F.round(x, 6))
    scored.withColumn("probs", short("probs")).withColumn("target", short("target")).withColumn("evidence", F.round("evidence", 6)).write.json(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED).json(path)


def answer_json(qtype: Column, keys: Column, probs: Column, evidence: Column, levels: Column) -> Column:
    """An answer as JSON: p_true, choice, or score with level and legend; probabilities, confidence and evidence.
    Numbers have 4 digits; order of keys is kept."""
    number = lambda x: F.round(x, 4).cast("string")
    quoted = lambda x: F.to_json(F.array(x)).substr(F.lit(2), F.length(F.to_json(F.array(x))) - 2)
    at = A.first_argmax(probs)
    legend = F.array_join(F.transform(levels, lambda x, i: F.concat(F.lit('"'), i.cast("string"), F.lit('": '), quoted(x))), ", ")
    head = (
        F.when(qtype == "bool", F.concat(F.lit('"p_true": '), number(F.get(probs, F.lit(0)))))
        .when(qtype == "choice", F.concat(F.lit('"choice": '), quoted(F.get(keys, at))))
        .otherwise(F.concat(F.lit('"score": '), number(A.expected_score(probs)), F.lit(', "level": '), at.cast("string"), F.lit(', "legend": {'), legend, F.lit("}")))
    )
    all_ = F.array_join(F.zip_with(keys, probs, lambda k, p: F.concat(quoted(k), F.lit(": "), number(p))), ", ")
    return F.concat(F.lit('{"type": "'), qtype, F.lit('", '), head, F.lit(', "probabilities": {'), all_, F.lit('}, "confidence": '), number(A.confidence(probs)), F.lit(', "evidence": '), number(evidence), F.lit("}"))
