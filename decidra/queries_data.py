"""Queries of dataset building, generators and labelling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.functions import text as X
from decidra.operators import datasets as D
from decidra.plans import pipeline
from decidra.queries import MD5, query, r6, table
from decidra.sources import files, hub


def _u(seed: int, what: str) -> str:
    return f"(('0x' || substr(md5('{seed}-{what}:' || id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# --- builders

LANGUAGES = ["de", "en", "fr"]


def _language_task() -> D.Task:
    """Spanish texts have no option here, so their rows are skipped."""
    return D.choice_task("language", LANGUAGES, ["Which language is this?", "What language is the text in?"], F.col("text"), F.col("lang"), key="doc_id")


def _length_task(**more) -> D.Task:
    """How long is the text, on a scale of five: a value between levels."""
    value = F.log10(F.length("text").cast("double") + 1)
    return D.score_task("length", 5, ["How long is this text?"], F.col("text"), value=value, key="doc_id", **more)


def _quality_task() -> D.Task:
    return D.bool_task("doc_quality", ["Is this text of good quality?"], F.col("text"), F.col("quality") == 1, key="doc_id")


@query("""SELECT doc_id AS id, 'choice' AS qtype, list_position(['de', 'en', 'fr'], lang) - 1 AS label_index, 'de,en,fr' AS keys, 1.0::DOUBLE AS mass FROM documents
 WHERE lang IN ('de', 'en', 'fr') AND text IS NOT NULL""")
def choice_examples(spark, sf_dir):
    out = D.build(table(spark, sf_dir, "documents"), _language_task(), 13)
    return out.select("id", "qtype", "label_index", F.array_join("keys", ",").alias("keys"), A.total(F.col("target")).alias("mass"))


@query("""WITH v AS (SELECT doc_id AS id, log10(length(text) + 1) AS c FROM documents WHERE text IS NOT NULL), w AS (SELECT *, list_transform(range(5), lambda k: exp(-(k - c) * (k - c) / (2 * 0.4 * 0.4)::DOUBLE)) AS w FROM v)
SELECT id, round(greatest(0, least(4, c)))::INT AS label_index, round(w[1] / list_sum(w), 6) AS p0, round(w[3] / list_sum(w), 6) AS p2, round(w[5] / list_sum(w), 6) AS p4 FROM w""")
def score_examples(spark, sf_dir):
    out = D.build(table(spark, sf_dir, "documents"), _length_task(), 13)
    return out.select("id", "label_index", *[r6(F.get("target", F.lit(i))).alias(f"p{i}") for i in (0, 2, 4)])


@query("""SELECT doc_id AS id, CASE WHEN p >= 0.5 THEN 0 ELSE 1 END AS label_index, round(p, 6) AS p_yes FROM (SELECT doc_id, greatest(0.0, least(1.0, (length(text) - 200) / 1000.0::DOUBLE)) AS p FROM documents WHERE text IS NOT NULL)""")
def graded_examples(spark, sf_dir):
    """A yes/no question with a probability that is clamped to [0, 1]."""
    p = (F.length("text") - 200) / 1000.0
    out = D.build(table(spark, sf_dir, "documents"), D.bool_task("long", ["Is this a long text?"], F.col("text"), p_yes=p, key="doc_id"), 13)
    return out.select("id", "label_index", r6(F.get("target", F.lit(0))).alias("p_yes"))


@query(f"""WITH ex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {MD5.format(seed=14, key="doc_id")}, doc_id) AS rn, count(*) OVER () AS total FROM documents WHERE text IS NOT NULL),
sp AS (SELECT *, least(200, least(total, 1700)) AS ne FROM ex WHERE rn <= 1700),
pl AS (SELECT id, CASE WHEN rn <= ne // 2 THEN 'calibration' WHEN rn <= ne THEN 'dev' ELSE 'train' END AS split, rn - 1 - CASE WHEN rn <= ne // 2 THEN 0 WHEN rn <= ne THEN ne // 2 ELSE ne END AS number FROM sp),
tr AS (SELECT id, row_number() OVER (ORDER BY {MD5.format(seed="14-swap", key="id")}, id) AS rn, count(*) OVER () AS n FROM pl WHERE split = 'train'),
sw AS (SELECT id, row_number() OVER (ORDER BY {MD5.format(seed="14-number", key="id")}, id) AS rn, n FROM tr WHERE rn <= floor(n * 0.2))
SELECT id AS key, 'length/' || split || '/' || number AS id, split, true AS answerable FROM pl UNION ALL SELECT id, 'length/train/' || (rn - 1 + n), 'train', false FROM sw""")
def built_task(spark, sf_dir):
    out = D.build_task(table(spark, sf_dir, "documents"), _length_task(), 14, swapped=0.2)
    return out.select("key", "id", "split", "answerable")


@query(f"""WITH ex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {MD5.format(seed=13, key="doc_id")}, doc_id) AS rn FROM documents WHERE text IS NOT NULL) SELECT id, 'holdout' AS split, rn - 1 AS number FROM ex WHERE rn <= 200""")
def holdout_split(spark, sf_dir):
    task = _length_task(holdout=True)
    return D.splits(D.build(table(spark, sf_dir, "documents"), task, 13), task, 13).select("id", "split", "number")


@query(f"""WITH t AS (SELECT text, 'language' AS source, row_number() OVER (ORDER BY {MD5.format(seed=7, key="doc_id")}, doc_id) AS rn FROM documents WHERE lang IN ('de', 'en', 'fr') AND text IS NOT NULL),
s AS (SELECT regexp_replace(text, '^[ \n]+|[ \n]+$', '', 'g') AS t, source FROM t WHERE rn <= 40000)
SELECT md5(t) AS text_md5, min(source) AS source, {MD5.format(seed=7, key="t")} AS place FROM s WHERE length(t) BETWEEN 40 AND 1500 GROUP BY t""")
def task_corpus(spark, sf_dir):
    """States of all tasks that are neither held out nor synthetic: here one of three."""
    docs = table(spark, sf_dir, "documents")
    tasks = [(_language_task(), docs), (_length_task(holdout=True), docs), (_length_task(synthetic=True), docs)]
    out = D.corpus(D.task_states(tasks, 40000, 7), 7)
    return out.select(F.md5("text").alias("text_md5"), "source", "place")


@query(f"""WITH s AS (SELECT CASE WHEN doc_id % 3 = 1 THEN CASE WHEN length(lang) >= length(text) THEN lang ELSE text END ELSE text END AS x, source FROM documents WHERE doc_id % 3 < 2 AND text IS NOT NULL),
t AS (SELECT regexp_replace(x, '^[ \n]+|[ \n]+$', '', 'g') AS t, source FROM s WHERE source <> (SELECT min(source) FROM documents))
SELECT md5(t) AS text_md5, min(source) AS source, {MD5.format(seed=5, key="t")} AS place FROM t WHERE length(t) BETWEEN 40 AND 1500 GROUP BY t""")
def train_texts(spark, sf_dir):
    """Texts from training records: text states, objects (their longest text field) and lists (left out), without one source."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    quoted = F.to_json(F.array("text"))
    state = F.when(F.col("doc_id") % 3 == 0, quoted.substr(F.lit(2), F.length(quoted) - 2)).when(F.col("doc_id") % 3 == 1, F.to_json(F.struct("lang", "doc_id", "text"))).otherwise(quoted)
    first = docs.agg(F.min("source")).first()[0]
    out = D.train_texts(docs.select(state.alias("state"), "source"), 5, (first,))
    return out.select(F.md5("text").alias("text_md5"), "source", "place")


@query("""WITH v AS (SELECT user_id, count(*) AS raters, count(*) FILTER (WHERE value > 50) AS a, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) FILTER (WHERE event_type = 'view' OR value < 10) AS c FROM events WHERE event_type <> 'signup' GROUP BY user_id)
SELECT user_id, raters, a, b, c, round(a / (a + b + c), 6) AS p_a, CASE WHEN a >= b AND a > 0 THEN 0 WHEN b > 0 THEN 1 ELSE 2 END AS majority FROM v WHERE raters >= 3 AND a + b + c > 0""")
def several_labels(spark, sf_dir):
    """Raters who may give several labels; one event type stands for votes marked very unclear, the last label for neutral."""
    kind, value = F.col("event_type"), F.col("value")
    labels = {"a": value > 50, "b": kind == "click", "c": (kind == "view") | (value < 10)}
    out = D.label_counts(table(spark, sf_dir, "events"), "user_id", labels, kind == "signup")
    counts = F.col("counts")
    chosen = F.when(F.greatest(F.get(counts, F.lit(0)), F.get(counts, F.lit(1))) > 0, D.majority(F.slice(counts, 1, 2))).otherwise(2)
    return out.select("user_id", "raters", *[F.get(counts, F.lit(i)).alias(n) for i, n in enumerate("abc")], r6(F.get(D.count_target(counts), F.lit(0))).alias("p_a"), chosen.alias("majority"))


TEACH = [(f"q{i}", "bool", f"Is it of kind {i}?", ["yes", "no"]) for i in range(6)]


@query(f"""WITH q AS (SELECT doc_id AS id, 'q' || i AS name, row_number() OVER (PARTITION BY doc_id ORDER BY {MD5.format(seed=9, key="doc_id || '/q' || i")}, 'q' || i) AS r FROM documents, range(6) t(i)),
p AS (SELECT id, name, {_u(9, "p").replace("|| id", "|| id || name")} AS p FROM q WHERE r <= 3 AND NOT (id % 2 = 0 AND name < 'q3'))
SELECT id, name, CASE WHEN p >= 1 - p THEN 'true' ELSE 'false' END AS label, CASE WHEN p >= 1 - p THEN 0 ELSE 1 END AS label_index, round(p, 6) AS p_yes FROM p""")
def teacher_labels(spark, sf_dir):
    """Three of six questions for each text, without those answered in an earlier run; the label is the larger probability."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("state"))
    questions = spark.createDataFrame(TEACH, "name string, qtype string, instructions string, keys array<string>")
    done = texts.where("id % 2 = 0").select("id", F.explode(F.array(*[F.lit(f"q{i}") for i in range(3)])).alias("name"))
    p = D.uniform("9-p", F.concat(F.col("id").cast("string"), "name"))
    out = D.label_texts(texts, questions, lambda df: df.withColumn("probs", F.array(p, 1 - p)), done, 9, 3)
    return out.select("id", "name", "label", "label_index", r6(F.get("target", F.lit(0))).alias("p_yes"))


@query(f"""WITH q AS (SELECT doc_id AS id, 'q' || i AS name, {_u(9, "p").replace("|| id", "|| doc_id || 'q' || i")} AS p FROM documents, range(6) t(i))
SELECT id, count(*) AS questions, string_agg(name || CASE WHEN p >= 1 - p THEN '+' ELSE '-' END, ',' ORDER BY name) AS said FROM q GROUP BY id""")
def packed_labels(spark, sf_dir):
    """One record for each text with all its teacher labels."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("state"))
    questions = spark.createDataFrame(TEACH, "name string, qtype string, instructions string, keys array<string>")
    p = D.uniform("9-p", F.concat(F.col("id").cast("string"), "name"))
    labelled = D.label_texts(texts, questions, lambda df: df.withColumn("probs", F.array(p, 1 - p)), None, 9, 6)
    out = D.packed_records(labelled)
    said = F.transform("questions", lambda q: F.concat(q["name"], F.when(q["label"] == "true", "+").otherwise("-")))
    return out.select("id", F.size("questions").cast("long").alias("questions"), F.array_join(said, ",").alias("said"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labels_to_do(spark, sf_dir):
    return D.not_done(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@query("""WITH r AS (SELECT p_partkey AS id, p_name, p_type, p_size FROM part), o AS (SELECT *, row_number() OVER (ORDER BY md5('3-swap:' || id), id) AS rn, count(*) OVER () AS n FROM r)
SELECT a.id, true AS answerable, a.p_name AS name, a.p_type AS kind FROM r a UNION ALL
SELECT a.id, false, a.p_name, b.p_type FROM o a JOIN o b ON b.rn = CASE WHEN a.rn = a.n THEN 1 ELSE a.rn + 1 END WHERE a.rn <= floor(a.n * 0.5)""")
def swapped_field(spark, sf_dir):
    """Object states of which one field is swapped for another row's; the rest of the state stays."""
    state = F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("kind")))
    task = D.bool_task("parts", ["Is it a part?"], state, F.col("p_size") > 20, key="p_partkey")
    out = D.swap_passages(D.build(table(spark, sf_dir, "part"), task, 3), 0.5, 3, key="kind")
    return out.select("id", "answerable", F.get_json_object("state", "$.name").alias("name"), F.get_json_object("state", "$.kind").alias("kind"))


# --- releases and layouts


@query(f"""WITH ex AS (SELECT lang, row_number() OVER (ORDER BY {MD5.format(seed=13, key="doc_id")}, doc_id) AS rn, count(*) OVER () AS total FROM documents JOIN labels USING (doc_id)),
sp AS (SELECT *, least(200, least(total, 1700)) AS ne FROM ex WHERE rn <= 1700)
SELECT coalesce(lang, '') AS config, CASE WHEN rn <= ne // 2 THEN 'calibration' WHEN rn <= ne THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM sp GROUP BY ALL""")
def released_sets(spark, sf_dir):
    """The built splits of labelled documents as a release folder, by language as config and split, read back."""
    folder = files.work_dir(spark, "release")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    made = D.splits(D.build(docs, _quality_task(), 13), _quality_task(), 13)
    told = made.join(docs.select(F.col("doc_id").alias("id"), F.coalesce("lang", F.lit("")).alias("config")), "id")
    pipeline.release(spark, folder, {"data": told}, "# Document quality\n", {"task": "doc_quality"})
    return spark.read.parquet(f"{folder}/data").groupBy("config", "split").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def hub_rows(spark, sf_dir):
    """Documents laid out as on a hub (a folder for each language as config) by one write, and read back split by split; the
    configs are those that the folder lists, however many."""
    root = files.work_dir(spark, "hub")
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    docs.withColumn("config", F.coalesce("lang", F.lit("none"))).withColumn("split", F.lit("train")).write.partitionBy("config", "split").parquet(f"{root}/docs")
    back = hub.load_configs(spark, root, "docs", "train", schema="lang string, text string")
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT CASE doc_id % 2 WHEN 0 THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT doc_id) AS ids FROM documents GROUP BY 1")
def written_examples(spark, sf_dir):
    """Examples written by config and split and read back."""
    folder = files.work_dir(spark, "examples")
    docs = table(spark, sf_dir, "documents").select(F.lit("own").alias("config"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("test").alias("split"), "doc_id", X.collapse(F.col("text")).alias("state"))
    docs.write.partitionBy("config", "split").json(folder)
    return spark.read.schema("doc_id long, state string, config string, split string").json(folder).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"))
