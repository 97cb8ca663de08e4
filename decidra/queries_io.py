"""Queries of sources and sinks, answers, encodings, scorers and serving, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from decidra.functions import arrays as A
from decidra.operators import agent as AG
from decidra.operators import datasets as D
from decidra.operators import encoding as E
from decidra.operators import scoring, serving
from decidra.plans import reports
from decidra.queries import ITEMS, ORDERS, QUALITY, TRIAGE, TRIAGE_SQL, orders_scored, quality_scored, query, r6, table, triage_cases
from decidra.sources import files
from decidra.sources import records as R

# --- sources and sinks


def _quoted(c):
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


@query("""SELECT CASE p_partkey % 4 WHEN 2 THEN 'part/' || p_partkey ELSE (p_partkey % 4)::VARCHAR END AS id, p_partkey AS line, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN NULL ELSE p_name END AS said,
 CASE p_partkey % 4 WHEN 2 THEN p_type END AS expected FROM part WHERE p_partkey % 4 < 3 UNION ALL SELECT '3', p_partkey, NULL, NULL FROM part WHERE p_partkey % 4 = 3""")
def states_scan(spark, sf_dir):
    """Lines of four kinds: a text, an object, a record with id and expectation, a list."""
    k = F.col("p_partkey") % 4
    record = F.concat(F.lit('{"state": '), _quoted("p_name"), F.lit(', "expected": '), _quoted("p_type"), F.lit(', "meta": {"id": "part/'), F.col("p_partkey").cast("string"), F.lit('"}}'))
    value = F.when(k == 0, _quoted("p_name")).when(k == 1, F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit("}"))).when(k == 2, record).otherwise(F.lit('["a", 1]'))
    lines = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("file"), k.cast("int").alias("line"), value.alias("value"))
    out = R.read_states(lines)
    said = F.get(F.from_json(F.concat(F.lit("["), F.when(F.startswith("state", F.lit('"')), F.col("state")), F.lit("]")), "array<string>"), F.lit(0))
    return out.select("id", F.col("file").cast("long").alias("line"), said.alias("said"), "expected")


SPLITS = 256


@query("SELECT doc_id AS id, line, md5(t) AS text_md5 FROM (SELECT doc_id, text AS t, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents WHERE text IS NOT NULL)")
def numbered_lines(spark, sf_dir):
    """JSON lines in the order of their ids, written in pieces by ranges of ids and read in splits of 64 KB, or of SPLITS to the whole
    where that is more: numbers go on across splits and pieces."""
    path = files.work_dir(spark, "lines")
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.to_json(F.struct("doc_id", "text")).alias("value"), "doc_id")
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("value").write.text(path)
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(max(1 << 16, files.size(spark, path) // SPLITS)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        out = files.written(R.lines(spark, path, across=True))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    r = F.from_json("value", "doc_id long, text string")
    return out.select(r["doc_id"].alias("id"), F.col("line").cast("long").alias("line"), F.md5(r["text"]).alias("text_md5"))


@query(f"""{ORDERS} SELECT id::VARCHAR AS item_id, qtype, source, label AS label_index, answerable, round(evidence, 6) AS evidence, round(list_max(probs), 6) AS p_max, k::INT AS k FROM scored""")
def scored_round_trip(spark, sf_dir):
    """Scored rows written as JSON lines and read back, rounded to six digits."""
    path = files.work_dir(spark, "scored")
    R.write_scored(orders_scored(spark, sf_dir), path)
    back = R.read_scored(spark, path)
    return back.select("item_id", "qtype", "source", "label_index", "answerable", "evidence", F.array_max("probs").alias("p_max"), F.size("probs").alias("k"))


@query(f"""{ORDERS}, a AS (SELECT id AS item_id, qtype, k, probs, evidence, list_max(probs) AS top, list_position(probs, list_max(probs)) - 1 AS pos FROM scored)
SELECT item_id, qtype, CASE WHEN qtype = 'bool' THEN round(probs[1], 4) END AS p_true, CASE WHEN qtype = 'choice' THEN ['a', 'b', 'c', 'd'][pos + 1] END AS choice, CASE WHEN qtype = 'score' THEN pos END AS level,
 round(greatest(0, least(1, (top - 1 / k) / (1 - 1 / k))), 4) AS confidence, round(evidence, 4) AS evidence FROM a""")
def answers_json(spark, sf_dir):
    """Answers as JSON with four digits, parsed again."""
    letters = F.array(*[F.lit(x) for x in "abcde"])
    keys = F.when(F.col("qtype") == "bool", F.array(F.lit("yes"), F.lit("no"))).when(F.col("qtype") == "choice", F.slice(letters, 1, 4)).otherwise(F.transform(F.sequence(F.lit(0), F.size("probs") - 1), lambda i: i.cast("string")))
    scored = orders_scored(spark, sf_dir).withColumn("probs", A.checked_probabilities(F.col("probs"), F.size("probs")))
    out = scored.select("item_id", "qtype", R.answer_json(F.col("qtype"), keys, F.col("probs"), F.col("evidence"), letters).alias("j"))
    parsed = F.from_json("j", "p_true double, choice string, level int, confidence double, evidence double")
    return out.select("item_id", "qtype", parsed.alias("p")).select("item_id", "qtype", "p.*")


PROBLEMS = {
    "type": '{"type": "maybe", "instructions": "q", "label": true}',
    "silent": '{"type": "bool", "instructions": "  ", "label": true}',
    "single": '{"type": "choice", "instructions": "q", "options": {"x": null}, "label": "x"}',
    "steps": '{"type": "score", "instructions": "q", "levels": ["a"], "label": 0}',
    "unlike": '{"type": "bool", "instructions": "q", "options": {"x": null}, "label": true}',
    "hollow": '{"type": "bool", "instructions": "q", "label": true, "target": {"yes": 0.0}}',
    "fine": '{"type": "choice", "instructions": "q", "options": {"x": null, "y": null}, "label": "y", "target": {"x": 1.0, "y": 3.0}}',
}


@query("""SELECT p_partkey AS line, n AS name, n <> 'fine' AS refused, CASE n WHEN 'fine' THEN 1 END AS label_index, CASE n WHEN 'fine' THEN 0.75::DOUBLE END AS p_label FROM part, (VALUES ('type'), ('silent'), ('single'), ('steps'), ('unlike'), ('hollow'), ('fine')) t(n)""")
def refused_questions(spark, sf_dir):
    """Every kind of unsound question, and a sound one with a soft target, in each record."""
    named = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(j).alias("json")) for n, j in PROBLEMS.items()])
    value = R.record_json(_quoted("p_name"), named, F.lit('{"source": "own"}'))
    lines = table(spark, sf_dir, "part").select(F.lit("f").alias("file"), F.col("p_partkey").alias("line"), value.alias("value"))
    out = R.parse_records(lines)
    sound = F.col("problem").isNull()
    return out.select("line", "name", (~sound).alias("refused"), F.when(sound, F.col("label_index")).alias("label_index"), F.when(sound, F.get("target", F.col("label_index"))).alias("p_label"))


# --- scorers and encodings


@query("""WITH c AS (SELECT vec_id, [list_sum([embedding[i], embedding[16 + i], embedding[32 + i], embedding[48 + i]]::DOUBLE[]) / 4 for i in range(1, 17)] AS m, embedding[49]::DOUBLE AS l FROM embeddings)
SELECT vec_id, round(m[1], 6) AS mean_first, round(m[16], 6) AS mean_last, round(l, 6) AS last_first FROM c""")
def pooled_vectors(spark, sf_dir):
    chunks = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.slice("embedding", j * 16 + 1, 16))
    t = table(spark, sf_dir, "embeddings").select("vec_id", A.mean_pool(chunks, 16).alias("m"), A.last_pool(chunks).alias("l"))
    return t.select("vec_id", r6(F.get("m", F.lit(0))).alias("mean_first"), r6(F.get("m", F.lit(15))).alias("mean_last"), r6(F.get("l", F.lit(0)).cast("double")).alias("last_first"))


WEIGHTS = [0.25 * ((i % 5) - 2) for i in range(64)]


@query(f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), m AS (SELECT *, list_sum(v) / 64 AS mu FROM e), d AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: (x - mu) * (x - mu))) / 64 + 1e-5) AS sd FROM m)
SELECT vec_id, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: (v[i] - mu) / sd * {WEIGHTS}::DOUBLE[][i])) + 0.1))), 5) AS evidence FROM d""".replace("::DOUBLE[][i]", "[i]::DOUBLE"))
def evidence_scores(spark, sf_dir):
    out = table(spark, sf_dir, "embeddings").select("vec_id", scoring.evidence_head(F.col("embedding"), WEIGHTS, 0.1).alias("evidence"))
    return out.select("vec_id", F.round("evidence", 5).alias("evidence"))


@query("SELECT p_partkey AS id, length(p_type) * 2 AS code FROM part")
def encoded_once(spark, sf_dir):
    """Each distinct text is encoded once and joined back."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type")
    return scoring.encode_distinct(parts, "p_type", lambda t: t.withColumn("code", F.length("_text") * 2)).select("id", "code")


@query(f"""{ORDERS}, b AS (SELECT *, list_transform(probs, lambda q: q ** (1 / 1.1::DOUBLE)) AS s FROM scored), g AS (SELECT list_max(list_transform(range(1, k + 1), lambda i: abs(probs[i] - s[i] / list_sum(s)))) AS g FROM b)
SELECT round(max(g), 6) AS max_probability_gap, 0.0::DOUBLE AS max_evidence_gap, 0 AS unmatched, max(g) <= 0.02 AS ok FROM g""")
def scorer_agreement(spark, sf_dir):
    """Two scorers that differ by a temperature of 1.1."""
    own = orders_scored(spark, sf_dir)
    other = own.withColumn("probs", A.rescale(F.col("probs"), 1.1))
    out = scoring.agreement(own, other, ["item_id"], 0.02)
    return out.select(r6("max_probability_gap").alias("max_probability_gap"), "max_evidence_gap", "unmatched", "ok")


@query(f"""{ORDERS}, t AS (SELECT id AS item_id, qtype, k, label, list_transform(range(k), lambda i: CASE WHEN qtype = 'score' THEN exp(-(i - label) * (i - label) / (2 * 0.5 * 0.5)::DOUBLE) ELSE (i = label)::INT::DOUBLE END) AS w FROM scored)
SELECT item_id, qtype, round(w[label + 1] / list_sum(w), 6) AS p_label, round(w[1] / list_sum(w), 6) AS p_first FROM t""")
def training_targets(spark, sf_dir):
    s = orders_scored(spark, sf_dir)
    t = A.training_target(F.col("qtype"), F.col("target"), F.col("label_index"))
    out = s.select("item_id", "qtype", "label_index", t.alias("t"))
    return out.select("item_id", "qtype", r6(F.get("t", F.col("label_index"))).alias("p_label"), r6(F.get("t", F.lit(0))).alias("p_first"))


@query(f"""{ORDERS} SELECT id AS item_id, CASE qtype WHEN 'bool' THEN CASE WHEN list_position(probs, list_max(probs)) = 1 THEN 'true' ELSE 'false' END WHEN 'score' THEN (list_position(probs, list_max(probs)) - 1)::VARCHAR ELSE ['a', 'b', 'c', 'd'][list_position(probs, list_max(probs))] END AS label FROM scored""")
def distilled(spark, sf_dir):
    """Scorer output as training examples, with labels by type."""
    keys = F.array(*[F.lit(x) for x in "abcde"])
    return D.teacher_examples(orders_scored(spark, sf_dir).withColumn("keys", keys)).select("item_id", "label")


@query(f"""{ORDERS}, o AS (SELECT id, k, probs, list_transform(list_sort(list_transform(range(k), lambda i: {{'h': md5('6:' || id || '/' || i), 'i': i}})), lambda x: x.i) AS ord FROM scored)
SELECT id AS item_id, array_to_string(ord, ',') AS shown, round(probs[ord[1] + 1], 6) AS first_shown, true AS restored FROM o""")
def display_orders(spark, sf_dir):
    """Options in a seeded display order, and the answer back in canonical order."""
    s = orders_scored(spark, sf_dir).select("item_id", "probs", E.display_order(F.col("item_id"), F.size("probs"), 6).alias("o"))
    shown = s.withColumn("d", E.displayed(F.col("probs"), F.col("o")))
    return shown.select("item_id", F.array_join(F.transform("o", lambda i: i.cast("string")), ",").alias("shown"), r6(F.get("d", F.lit(0))).alias("first_shown"), (E.canonical(F.col("d"), F.col("o")) == F.col("probs")).alias("restored"))


@query("""WITH n AS (SELECT doc_id AS id, length(text) + 8 AS n, ('0x' || substr(md5('shard:' || doc_id), 1, 8))::BIGINT % 4 AS shard FROM documents WHERE text IS NOT NULL), p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n DESC, id) - 1 AS place FROM n)
SELECT id, shard, place, place // 16 AS batch FROM p""")
def length_sorted(spark, sf_dir):
    """Texts in four shards, longest first, in batches of 16; the length is an estimate over text and option texts."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    n = E.approx_length(F.col("text"), F.array(F.lit("good"), F.lit("poor")))
    return E.length_batches(docs, n, 16, 4).select("id", "shard", "place", "batch")


@query("""WITH b AS (SELECT vec_id AS id, vec_id // 8 AS batch, vec_id % 5 + 5 AS n FROM embeddings) SELECT id, n + (max(n) OVER (PARTITION BY batch) - n) AS width, max(n) OVER (PARTITION BY batch) - n AS padding, max(n) OVER (PARTITION BY batch) - n AS masked FROM b""")
def collated(spark, sf_dir):
    """Packed rows of batches of eight, padded to the longest; padding is in block -2."""
    n = (F.col("vec_id") % 5 + 1).cast("int")
    ids = F.transform(F.sequence(F.lit(1), n), lambda i: i.cast("int"))
    blocks = F.array(F.array(F.lit(100), F.lit(101)), F.array(F.lit(200), F.lit(201)))
    p = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.floor(F.col("vec_id") / 8).alias("batch"), scoring.pack(ids, blocks).alias("p"))
    out = E.collate(p, ["batch"], F.col("p.input_ids"), F.col("p.position_ids"), F.col("p.block_ids"))
    masked = F.size(F.filter("block_ids", lambda b: b == E.PAD_BLOCK))
    return out.select("id", F.size("input_ids").cast("long").alias("width"), F.col("padding").cast("long").alias("padding"), masked.cast("long").alias("masked"))


@query("""WITH l AS (SELECT p_partkey AS id, len(string_split(p_name, ' ')) AS a, len(string_split(p_type, ' ')) AS b FROM part) SELECT id, a + b + 1 AS tokens, a::INT AS first_end, -1 AS empty_first, a::INT AS third_first, (a + b)::INT AS third_end FROM l""")
def token_spans(spark, sf_dir):
    """Words as tokens: spans of four lines, of which one is empty."""
    import re

    lines = F.array("p_name", F.lit(""), "p_type", F.lit("end"))
    spans = E.line_spans(lines, lambda text: [(0, m.start(), m.end()) for m in re.finditer(r"[^ \n]+", text)])
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), spans.alias("s"))
    at = lambda i, f: F.get("s.spans", F.lit(i))[f]
    return t.select("id", F.size("s.ids").cast("long").alias("tokens"), at(0, "end").alias("first_end"), at(1, "first").alias("empty_first"), at(2, "first").alias("third_first"), at(2, "end").alias("third_end"))


# --- agents


@query(f"""{TRIAGE_SQL}, gr AS (SELECT id, CASE WHEN top < 0.9 THEN 'review' WHEN NOT yes THEN 'drop' WHEN evidence < 0.3 THEN 'review' WHEN lev = 0 THEN 'snippet' ELSE 'article' END AS outcome, CASE WHEN top < 0.8 THEN 'probability' WHEN top < 0.9 THEN 'act' WHEN yes AND evidence < 0.3 THEN 'evidence' END AS why FROM an)
SELECT id, outcome, why FROM gr""")
def guarded_routes(spark, sf_dir):
    """Three guards on the way: probability, fitted act threshold, evidence; the first that bars gives the reason."""
    raw = TRIAGE | {"graph": TRIAGE["graph"] | {"nodes": TRIAGE["graph"]["nodes"] | {"quality": TRIAGE["graph"]["nodes"]["quality"] | {"require_act": True}}}}
    out = AG.decide(triage_cases(spark, sf_dir), AG.Agent.parse(raw), lambda df: df, act={"bool": 0.9})
    reason = F.get(F.transform(F.filter("path", lambda s: s["guard"].isNotNull()), lambda s: s["guard"]), F.lit(0))
    why = F.when(F.startswith(reason, F.lit("probability")), "probability").when(F.startswith(reason, F.lit("evidence")), "evidence").when(reason.isNotNull(), "act")
    return out.select("id", "outcome", why.alias("why"))


# --- bulk answers, requests and reports


@query(f"""{QUALITY}{ITEMS} SELECT id, 'good' AS name, round(probs[1], 4) AS p_true, round(greatest(0, least(1, (p_max - 0.5) / 0.5)), 4) AS confidence, p_max >= 0.9 AS act FROM it
 UNION ALL SELECT id, 'poor', round(probs[2], 4), round(greatest(0, least(1, (p_max - 0.5) / 0.5)), 4), p_max >= 0.9 FROM it""")
def bulk_apply(spark, sf_dir):
    """Every state with every question of a set, answered, decorated and written as JSON lines; read back."""
    path = files.work_dir(spark, "answers")
    states = quality_scored(spark, sf_dir).select(F.col("item_id").alias("id"), "probs", "evidence")
    questions = spark.createDataFrame([("good", False), ("poor", True)], "name string, turned boolean")
    asked = scoring.ask(states, questions).withColumn("probs", F.when(F.col("turned"), F.reverse("probs")).otherwise(F.col("probs")))
    keys = F.array(F.lit("yes"), F.lit("no"))
    answer = R.answer_json(F.lit("bool"), keys, F.col("probs"), F.col("evidence"), keys)
    asked.select("id", "name", answer.alias("answer"), (F.array_max("probs") >= 0.9).alias("act")).write.json(path)
    back = spark.read.schema("id long, name string, answer string, act boolean").json(path)
    a = F.from_json("answer", "p_true double, confidence double")
    return back.select("id", "name", a["p_true"].alias("p_true"), a["confidence"].alias("confidence"), "act")


@query("""SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 256 THEN 'accepted' ELSE 'rejected' END AS status, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 256 THEN NULL ELSE 1 END AS retry_after FROM events""")
def admitted(spark, sf_dir):
    """A queue of 256: what comes later is to be tried again."""
    from decidra.streaming.requests import admit

    return admit(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "status", "retry_after")


@query("""WITH RECURSIVE e AS (SELECT user_id AS g, event_id AS o, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
f AS (SELECT g, o, rn, t, t AS since, 1 AS n, 0 AS batch FROM e WHERE rn = 1
 UNION ALL SELECT e.g, e.o, e.rn, e.t, CASE WHEN f.n >= 4 OR e.t - f.since > 86400 THEN e.t ELSE f.since END, CASE WHEN f.n >= 4 OR e.t - f.since > 86400 THEN 1 ELSE f.n + 1 END,
  f.batch + CASE WHEN f.n >= 4 OR e.t - f.since > 86400 THEN 1 ELSE 0 END FROM f JOIN e ON e.g = f.g AND e.rn = f.rn + 1)
SELECT g AS user_id, o AS event_id, batch::BIGINT AS batch FROM f""")
def timed_batches(spark, sf_dir):
    """Batches of four events of a user that close after a day."""
    events = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return D.make_batches(events, "user_id", "event_id", F.lit(1), 4, 1000, at=seconds, wait=86400.0)


@query("""SELECT (count(*) FILTER (WHERE event_type NOT IN ('signup', 'view')))::BIGINT AS requests, (count(*) FILTER (WHERE event_type = 'signup'))::BIGINT AS errors, (count(*) FILTER (WHERE event_type = 'view'))::BIGINT AS rejected,
 (SELECT count(*) FROM part) AS batches, (SELECT round(avg(p_size), 6) FROM part) AS mean_batch_size FROM events""")
def service_snapshot(spark, sf_dir):
    status = F.when(F.col("event_type") == "signup", "error").when(F.col("event_type") == "view", "rejected").otherwise("ok")
    out = serving.snapshot(table(spark, sf_dir, "events").select(status.alias("status")), table(spark, sf_dir, "part").select(F.col("p_size").alias("size")))
    return out.withColumn("mean_batch_size", r6("mean_batch_size"))


@query("""SELECT p_partkey AS request, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS parity, round(p_size / 100, 6) AS small, round(p_size / 50, 6) AS size FROM part""")
def grouped_answers(spark, sf_dir):
    """Answers of a request by type: choices, probabilities of yes, and expected scores."""
    n = F.col("p_size")
    one = lambda name, kind, keys, probs: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("qtype"), F.array(*[F.lit(k) for k in keys]).alias("keys"), F.array(*probs).alias("probs"))
    even = F.when(n % 2 == 0, 0.9).otherwise(0.1)
    rows = [one("parity", "choice", ["even", "odd"], [even, 1 - even]), one("small", "bool", ["yes", "no"], [n / 100, 1 - n / 100]), one("size", "score", ["0", "1"], [1 - n / 50, n / 50])]
    answers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), F.explode(F.array(*rows)).alias("x")).select("request", "x.*")
    out = serving.answer_groups(answers)
    return out.select("request", F.element_at("choices", "parity").alias("parity"), r6(F.element_at("nouls", "small")).alias("small"), r6(F.element_at("scores", "size")).alias("size"))


@query(f"""{QUALITY}{ITEMS}, m AS (SELECT round(avg(correct), 3) AS a, count(*) AS n FROM it) SELECT 'own' AS run, printf('%.3f', a) AS accuracy, n AS items, '-' AS other FROM m""")
def run_cells(spark, sf_dir):
    """A report written, read back, and shown as cells by run and split; a dash where a run has none."""
    path = f"{files.work_dir(spark, 'report')}/eval-own.json"
    reports.write_report(quality_scored(spark, sf_dir), path)
    found = reports.read_report(spark, path)
    shown = reports.run_table(spark, {("own", "seen"): found, ("less", "other"): {"overall": {}}})
    return shown.where("run = 'own'").select("run", F.split("seen", " / ")[0].alias("accuracy"), F.lit(found["overall"]["count"]).cast("long").alias("items"), "other")


@query("""WITH i AS (SELECT vec_id, embedding::DOUBLE[] AS z, [vec_id % 64, (vec_id * 7 + 3) % 64, -1, (vec_id * 5 + 40) % 64] AS ids FROM embeddings),
 w AS (SELECT vec_id, exp(z[ids[1] + 1] / 0.5) AS a, exp(z[ids[2] + 1] / 0.5) AS b, exp(z[ids[4] + 1] / 0.5) AS c FROM i)
SELECT vec_id, round(a / (a + b + c), 6) AS p_first, round(b / (a + b + c), 6) AS p_second, 0.0::DOUBLE AS p_empty, round(c / (a + b + c), 6) AS p_last FROM w""")
def label_readouts(spark, sf_dir):
    """Embeddings taken as logits of 64 tokens, read at three labels and one place left empty."""
    v = F.col("vec_id")
    ids = F.transform(F.array(v % 64, (v * 7 + 3) % 64, F.lit(-1).cast("long"), (v * 5 + 40) % 64), lambda i: i.cast("int"))
    p = table(spark, sf_dir, "embeddings").select("vec_id", A.label_readout(F.col("embedding"), ids, 0.5).alias("p"))
    return p.select("vec_id", *[r6(F.get("p", F.lit(k))).alias(name) for k, name in enumerate(["p_first", "p_second", "p_empty", "p_last"])])


@query("""WITH r AS (SELECT p_partkey AS request, p_name, p_size, p_partkey % 8 AS k FROM part)
SELECT request, CASE k WHEN 1 THEN 'health' WHEN 2 THEN 'models' WHEN 5 THEN 'agents' WHEN 6 THEN 'agent' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 'decide' END AS route,
 CASE WHEN k IN (0, 7) AND request % 3 = 0 THEN 401 WHEN k = 3 THEN 404 WHEN k = 4 THEN 405 WHEN k = 6 AND p_size % 2 = 1 THEN 404 WHEN k = 7 THEN 422 ELSE 200 END AS status,
 CASE WHEN k = 0 AND request % 3 <> 0 THEN round(p_size / 100, 4) END AS p_true, CASE WHEN k = 0 AND request % 3 <> 0 THEN CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END END AS choice FROM r""")
def routed_requests(spark, sf_dir):
    """Requests of eight kinds: sound and unsound decisions with and without the key, fixed pages, lost paths."""
    from decidra.streaming.routes import respond

    k = F.col("p_partkey") % 8
    path = F.element_at(F.array(*[F.lit(x) for x in ["/v1/decide", "/health", "/v1/models", "/nowhere", "/v1/decide", "/v1/agents", "/v1/agents/", "/v1/decide"]]), (k + 1).cast("int"))
    path = F.when(k == 6, F.concat(path, F.when(F.col("p_size") % 2 == 0, "triage").otherwise("other"))).otherwise(path)
    asked = F.lit('"yes": {"type": "bool", "instructions": "Is it?"}, "how": {"type": "choice", "instructions": "Which?", "options": {"big": null, "small": null}}')
    asked = F.when(k == 7, F.lit('"how": {"type": "choice", "instructions": "Which?", "options": {"big": null}}')).otherwise(asked)
    body = F.concat(F.lit('{"state": {"size": '), F.col("p_size").cast("string"), F.lit('}, "questions": {'), asked, F.lit("}}"))
    key = F.when(~(k.isin(0, 7) & (F.col("p_partkey") % 3 == 0)), "Bearer key")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("request"), F.when(k.isin(0, 7), "POST").otherwise("GET").alias("method"), path.alias("path"), key.alias("authorization"), body.alias("body"))

    def answer(asked):
        size = F.get_json_object("state", "$.size").cast("int")
        p = F.when(F.col("qtype") == "bool", size / 100).otherwise(F.when(size > 25, 0.75).otherwise(0.25))
        return asked.withColumn("probs", F.array(p, 1 - p)).withColumn("evidence", F.lit(0.5))

    out = respond(rows, answer, "own", {"triage": "{}"}, "key")
    return out.select("request", "route", "status", F.get_json_object("body", "$.answers.yes.p_true").cast("double").alias("p_true"), F.get_json_object("body", "$.answers.how.choice").alias("choice"))
