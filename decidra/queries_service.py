"""Queries of a decision service: graphs that come with requests, registries, batches and windows as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.operators import datasets as D
from decidra.operators import graph_tables as G
from decidra.queries import query, r6, table
from decidra.streaming import batcher, registry
from decidra.streaming.requests import in_steps

# --- a graph with each request


def _u(what: str, key: str) -> str:
    return f"(('0x' || substr(md5('g-{what}:' || {key}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _named(i: Column) -> Column:
    return F.concat(F.lit("q"), i.cast("string"))


def graph_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request, body and k: a graph for each document, a chain of 2 to 5 questions about that document, half of them with one
    of several faults (a cycle, lost targets and options, no such start) or with a cycle that nothing leads to."""
    key = F.col("doc_id")
    case, k = key % 10, (key % 4 + 2).cast("int")
    last = F.when(case == 0, "q0").when(case == 1, "nowhere").otherwise("keep")

    def node(i: Column) -> Column:
        yes = F.when(i == k - 1, last).otherwise(_named(i + 1))
        odd = F.when((case == 2) & (i == 0), ', "maybe": "keep"').otherwise("")
        limit = F.when(i % 2 == 1, F.concat(F.lit(', "min_probability": '), (F.lit(50) + key % 5 * 5).cast("string"), F.lit("e-2"))).otherwise("")
        asked = F.concat(F.lit('{"type": "bool", "instructions": "Question '), i.cast("string"), F.lit(" of document "), key.cast("string"), F.lit('?"}'))
        return F.concat(F.lit('"'), _named(i), F.lit('": {"question": '), asked, F.lit(', "edges": {"yes": "'), yes, F.lit('"'), odd, F.lit('}, "default": "drop", "fallback": "review"'), limit, F.lit("}"))

    nodes = F.array_join(F.transform(F.sequence(F.lit(0), k - 1), node), ", ")
    island = F.when(case == 4, ', "u0": {"question": {"type": "bool", "instructions": "?"}, "default": "u1"}, "u1": {"question": {"type": "bool", "instructions": "?"}, "default": "u0"}').otherwise("")
    ends = F.lit(', "keep": {"outcome": "keep"}, "drop": {"outcome": "drop"}, "review": {"outcome": "review"}')
    start = F.when(case == 3, "x").otherwise("q0")
    body = F.concat(F.lit('{"start": "'), start, F.lit('", "nodes": {'), nodes, island, ends, F.lit("}}"))
    return table(spark, sf_dir, "documents").select(key.alias("request"), body.alias("body"), k.alias("k"))


def graph_answers(bodies: DataFrame) -> DataFrame:
    """request, node, probs and evidence of all questions: hashed uniforms, so that SQL can give the same."""
    each = bodies.select("request", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i"))
    p = D.uniform("g-p", F.concat(F.col("request").cast("string"), F.lit("/"), F.col("i").cast("string")))
    return each.select("request", _named(F.col("i")).alias("node"), F.array(p, 1 - p).alias("probs"), F.lit(1.0).alias("evidence"))


@query(f"""SELECT doc_id AS request, CASE doc_id % 10 WHEN 0 THEN '{G.CYCLE}' WHEN 1 THEN '{G.LOST_TARGET}' WHEN 2 THEN '{G.LOST_OPTION}' ELSE '{G.NO_START}' END AS detail FROM documents WHERE doc_id % 10 < 4""")
def graphs_refused(spark, sf_dir):
    """Which of the graphs that come with requests can't be walked, and why."""
    bodies = graph_bodies(spark, sf_dir)
    why = G.refused(G.read(bodies))
    return bodies.select("request", G.graph_key(F.col("body")).alias("graph")).join(why, "graph").select("request", F.col("reason").alias("detail"))


@query(f"""WITH RECURSIVE r AS (SELECT doc_id AS request, doc_id % 4 + 2 AS k, (50 + doc_id % 5 * 5) / 100.0::DOUBLE AS low FROM documents WHERE doc_id % 10 >= 4),
w AS (SELECT request, k, low, 0 AS i, 1.0::DOUBLE AS path, NULL::VARCHAR AS outcome, 0 AS steps FROM r
 UNION ALL SELECT request, k, low, i + 1, CASE WHEN i % 2 = 1 AND greatest(p, 1 - p) < low THEN path ELSE path * greatest(p, 1 - p) END,
  CASE WHEN i % 2 = 1 AND greatest(p, 1 - p) < low THEN 'review' WHEN p < 1 - p THEN 'drop' WHEN i = k - 1 THEN 'keep' END, steps + 1
  FROM (SELECT *, {_u("p", "request || '/' || i")} AS p FROM w WHERE outcome IS NULL))
SELECT doc_id AS request, CASE WHEN doc_id % 10 < 4 THEN 422 ELSE 200 END AS status, outcome, steps, round(path, 6) AS path_probability FROM documents d LEFT JOIN w ON w.request = d.doc_id AND outcome IS NOT NULL""")
def graphs_decided(spark, sf_dir):
    """Every request by its own graph."""
    bodies = graph_bodies(spark, sf_dir)
    out = G.decide(bodies.select("request", "body"), graph_answers(bodies))
    return out.select("request", "status", "outcome", F.when(F.col("path").isNotNull(), F.size("path")).alias("steps"), r6("path_probability").alias("path_probability"))


# --- registries, batches and windows as streams

STEPS = 3


def agent_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the request log of some registries: each registers, shows, deletes, lists or runs one of five agents."""
    e = F.col("event_id")
    op = F.get(F.array(*[F.lit(x) for x in ("register", "run", "run", "show", "register", "list", "delete")]), (e % 7).cast("int"))
    name = F.concat(F.lit("a"), (e % 5).cast("string"))
    graph = F.concat(F.lit('{"start": "q", "nodes": {"q": {"question": {"type": "bool", "instructions": "Above '), e.cast("string"), F.lit('?"}, "edges": {"yes": "y", "no": "n"}}, "y": {"outcome": "high"}, "n": {"outcome": "low"}}}'))
    actions = F.concat(F.lit('{"high": {"action": "keep", "arguments": {"version": '), e.cast("string"), F.lit('}}, "low": "drop"}'))
    # every eleventh is unsound: an action for an outcome that no node has
    actions = F.when(e % 11 == 0, '{"other": "x"}').otherwise(actions)
    body = F.concat(F.lit('{"name": "'), name, F.lit('", "graph": '), graph, F.lit(', "actions": '), actions, F.lit("}"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("r"), (F.col("user_id") % 40).cast("string")).alias("registry"), e.alias("seq"), op.alias("op"), name.alias("name"), F.when(op == "register", body).alias("body"))


LOG_SQL = """l AS (SELECT 'r' || user_id % 40 AS registry, event_id AS seq, (['register', 'run', 'run', 'show', 'register', 'list', 'delete'])[event_id % 7 + 1] AS op, 'a' || event_id % 5 AS name, event_id % 11 = 0 AS bad FROM events),
m AS (SELECT *, last_value(CASE WHEN op = 'delete' THEN -1 WHEN op = 'register' AND NOT bad THEN seq END IGNORE NULLS) OVER (PARTITION BY registry, name ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS version FROM l)"""


@query(f"""WITH {LOG_SQL}, c AS (SELECT registry, name, seq, lead(seq, 1, 9223372036854775807) OVER (PARTITION BY registry, name ORDER BY seq) AS until, op FROM l WHERE op = 'delete' OR (op = 'register' AND NOT bad)),
n AS (SELECT l.seq, string_agg(c.name, ',' ORDER BY c.name) AS names FROM l JOIN c ON l.registry = c.registry AND c.op = 'register' AND c.seq < l.seq AND l.seq < c.until WHERE l.op = 'list' GROUP BY l.seq)
SELECT registry, seq, op, CASE WHEN op = 'list' THEN 200 WHEN op = 'register' THEN CASE WHEN bad THEN 422 ELSE 200 END WHEN coalesce(version, -1) >= 0 THEN 200 ELSE 404 END AS status,
 CASE WHEN op IN ('show', 'run', 'delete') AND version >= 0 THEN version WHEN op = 'register' AND NOT bad THEN seq END AS version, CASE WHEN op = 'list' THEN coalesce(names, '') END AS names FROM m LEFT JOIN n USING (seq)""")
def registry_stream(spark, sf_dir):
    """The registries' answers, from a stream that is stopped and started again."""
    out = in_steps(spark, agent_log(spark, sf_dir), "seq", STEPS, registry.follow, "registry")
    version = F.regexp_extract("agent", r"Above (\d+)\?", 1).try_cast("long")
    return out.select("registry", "seq", "op", "status", version.alias("version"), F.array_join("names", ",").alias("names"))


@query(f"""WITH {LOG_SQL} SELECT seq AS request, CASE WHEN coalesce(version, -1) >= 0 THEN 200 ELSE 404 END AS status, CASE WHEN version >= 0 THEN CASE WHEN seq % 3 > 0 THEN 'keep' ELSE 'drop' END END AS action,
 CASE WHEN version >= 0 AND seq % 3 > 0 THEN version END AS version FROM m WHERE op = 'run'""")
def agent_runs(spark, sf_dir):
    """Runs by the agent that was registered at that moment: outcome and action of its own graph."""
    log = agent_log(spark, sf_dir)
    answered = registry.replay(log).withColumn("request", F.col("seq"))
    p = F.when(F.col("seq") % 3 > 0, 0.9).otherwise(0.2)
    answers = log.where("op = 'run'").select(F.col("seq").alias("request"), F.lit("q").alias("node"), F.array(p, 1 - p).alias("probs"), F.lit(1.0).alias("evidence"))
    out = registry.decide_runs(answered, answers)
    return out.select("request", "status", "action", F.get_json_object("arguments", "$.version").cast("long").alias("version"))


@query("""WITH RECURSIVE e AS (SELECT 'l' || user_id % 16 AS lane, event_id AS o, epoch_ms(ts)::DOUBLE AS t, (event_id % 50 * 20)::BIGINT AS k, row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS rn FROM events),
f AS (SELECT lane, rn, t AS since, 1 AS n, k AS total, 0 AS batch, NULL::VARCHAR AS why FROM e WHERE rn = 1
 UNION ALL SELECT e.lane, e.rn, CASE WHEN w IS NULL THEN since ELSE t END, CASE WHEN w IS NULL THEN n + 1 ELSE 1 END, CASE WHEN w IS NULL THEN total + k ELSE k END, batch + (w IS NOT NULL)::INT, w
  FROM (SELECT e.*, f.since, f.n, f.total, f.batch, CASE WHEN f.n >= 16 THEN 'size' WHEN f.total + e.k > 6000 THEN 'tokens' WHEN e.t - f.since > 43200000 THEN 'time' END AS w FROM f JOIN e ON e.lane = f.lane AND e.rn = f.rn + 1) e)
SELECT lane, batch::BIGINT AS batch, count(*) AS requests, max(total)::BIGINT AS tokens, coalesce((SELECT why FROM f g WHERE g.lane = f.lane AND g.batch = f.batch + 1 AND why IS NOT NULL), 'flush') AS why FROM f GROUP BY lane, batch""")
def stream_batches(spark, sf_dir):
    """Batches by size, tokens and time from a stream in several micro-batches and restarts; a last row a lane flushes it."""
    events = table(spark, sf_dir, "events")
    lane = F.concat(F.lit("l"), (F.col("user_id") % 16).cast("string"))
    own = events.select(lane.alias("lane"), F.col("event_id").alias("request"), (F.col("event_id") % 50 * 20).alias("tokens"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("at"), F.col("event_id").alias("seq"))
    ends = own.groupBy("lane").agg(F.max("seq").alias("seq")).select("lane", F.lit(None).cast("long").alias("request"), F.lit(0).cast("long").alias("tokens"), F.lit(float("inf")).alias("at"), F.lit(None).cast("long").alias("seq"))
    last = own.agg(F.max("seq")).first()[0]
    arrivals = own.unionByName(ends.withColumn("seq", F.lit(last).cast("long")))
    out = in_steps(spark, arrivals, "seq", STEPS, lambda s: batcher.batched(s, 16, 6000, 43200000.0), "batches")
    return out.select("lane", "batch", F.size("requests").cast("long").alias("requests"), "tokens", "why")


def _at(q: float) -> str:
    return f"round(list_sort(list(value))[least(count(*), floor(count(*) * {q}::DOUBLE)::BIGINT + 1)], 6)"


@query(f"""WITH s AS (SELECT event_type AS route, event_id, value, event_id % 9 > 0 AS ok FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY event_id DESC) AS r FROM s WHERE ok AND value IS NOT NULL),
n AS (SELECT route, count(*) FILTER (WHERE ok) AS requests, count(*) FILTER (WHERE NOT ok) AS errors FROM s GROUP BY route)
SELECT route, any_value(requests) AS requests, any_value(errors) AS errors, count(*)::INT AS kept, {_at(0.5)} AS p50, {_at(0.95)} AS p95, {_at(0.99)} AS p99 FROM k JOIN n USING (route) WHERE r <= 1024 GROUP BY route""")
def stream_latency(spark, sf_dir):
    """Counters and quantiles of the last 1,024 values of each route, as the stream leaves them."""
    served = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 9 > 0, "ok").otherwise("error").alias("status"), "value")
    out = in_steps(spark, served, "seq", STEPS, batcher.windows, "latency")
    last = out.groupBy("route").agg(F.max(F.struct("step", *out.columns[2:])).alias("x"))
    return last.select("route", "x.requests", "x.errors", "x.kept", *[r6(F.col(f"x.{q}")).alias(q) for q in ("p50", "p95", "p99")])
