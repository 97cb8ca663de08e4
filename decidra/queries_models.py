"""Queries of what models do with rows: compiled decisions, content scores, passes, pairs and shared encodings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from decidra.functions import attention as T
from decidra.operators import passes as P
from decidra.queries import query, r6, shown6, table

D = 16


def _w(i: int, j: int, m: int = 11) -> float:
    """Weights by a rule, so that SQL can give them too."""
    return ((i * 7 + j * 3) % m - m // 2) / 10


def _matrix(n: int, d: int, m: int) -> list[list[float]]:
    return [[_w(i, j, m) for j in range(d)] for i in range(n)]


QUERY, OPTIONS, READER, BILINEAR, CONTENT = _matrix(2, D, 13), _matrix(3, D, 7), _matrix(D, 2 * D, 9), _matrix(D, D, 11), _matrix(D, D, 17)
BIAS, EVIDENCE = [_w(1, j, 5) for j in range(D)], [_w(2, j, 11) for j in range(D + 1)] + [0.3]


def _chunks(v: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.transform(F.slice(v, j * D + 1, D), lambda x: x.cast("double")))


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def _sql(values) -> str:
    return "[" + ", ".join(_sql(v) if isinstance(v, list) else f"{v}::DOUBLE" for v in values) + "]"


TOKENS = f"""e AS (SELECT vec_id, list_transform(range(4), lambda j: list_transform(embedding[{D} * j + 1:{D} * j + {D}], lambda x: x::DOUBLE)) AS t FROM embeddings)"""


@query(f"""WITH {TOKENS}, m AS (SELECT vec_id, j, t[j + 1] AS v FROM e, range(4) r(j) WHERE j < 3 OR vec_id % 3 > 0), q AS (SELECT i, ({_sql(QUERY)})[i] AS q FROM range(1, 3) s(i)),
a AS (SELECT vec_id, i, j, v, {_dot("v", "q")} / 4 AS z FROM m CROSS JOIN q), w AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY vec_id, i) AS w FROM a),
c AS (SELECT vec_id, i, k, sum(w * v[k]) AS c FROM w, range(1, {D + 1}) d(k) GROUP BY ALL), cc AS (SELECT vec_id, list(c ORDER BY i, k) AS c FROM c GROUP BY vec_id),
en AS (SELECT vec_id, -sum(w * ln(w)) / 2 AS h FROM w GROUP BY vec_id), pad AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN -1e-9 * ln(1e-9) ELSE 0 END AS p FROM e),
z AS (SELECT vec_id, list_transform({_sql(READER)}, lambda r: list_sum(list_transform(range(1, {2 * D + 1}), lambda i: r[i] * c[i]))) AS z FROM cc),
b AS (SELECT vec_id, z, list_transform({_sql(BILINEAR)}, lambda r: list_sum(list_transform(range(1, {D + 1}), lambda i: r[i] * z[i]))) AS y FROM z),
o AS (SELECT i, ({_sql(OPTIONS)})[i] AS o, {_sql(BIAS)} AS bias FROM range(1, 4) s(i)),
l AS (SELECT vec_id, i, {_dot("y", "o")} / 4 + {_dot("bias", "o")} AS z FROM b CROSS JOIN o)
SELECT vec_id, list_transform(list(l.z ORDER BY i), lambda x: round(x, 6))::VARCHAR AS logits, round(1 / (1 + exp(-(any_value({_dot("b.z", _sql(EVIDENCE[:D]))}) + {EVIDENCE[D]} * any_value(h + p) + {EVIDENCE[D + 1]}))), 6) AS evidence
FROM l JOIN b USING (vec_id) JOIN en USING (vec_id) JOIN pad USING (vec_id) GROUP BY vec_id""")
def compiled_decision(spark, sf_dir):
    """A compiled question over four tokens of every vector, of which every third row lacks the last."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _chunks(F.col("embedding")).alias("t"))
    mask = F.transform("t", lambda _, i: (i < 3) | (F.col("vec_id") % 3 > 0))
    out = e.select("vec_id", T.compiled_decision(F.col("t"), mask, QUERY, OPTIONS, READER, BILINEAR, BIAS, EVIDENCE).alias("d"))
    shown = F.concat(F.lit("["), F.array_join(F.transform("d.logits", shown6), ", "), F.lit("]"))
    return out.select("vec_id", shown.alias("logits"), r6(F.col("d.evidence")).alias("evidence"))


def _norm(v: str) -> str:
    mean = f"(list_sum({v}) / {D})"
    return f"list_transform({v}, lambda x: (x - {mean}) / sqrt(list_sum(list_transform({v}, lambda y: (y - {mean}) ** 2)) / {D} + 1e-5))"


@query(f"""WITH {TOKENS}, n AS (SELECT vec_id, {_norm("t[4]")} AS d FROM e), q AS (SELECT vec_id, list_transform({_sql(CONTENT)}, lambda r: list_sum(list_transform(range(1, {D + 1}), lambda i: r[i] * d[i]))) AS q FROM n),
p AS (SELECT vec_id, k, list_transform(range(1, {D + 1}), lambda i: CASE k WHEN 0 THEN (t[1][i] + t[2][i]) / 2 ELSE t[3][i] END) AS p FROM e, range(2) r(k) WHERE k = 0 OR vec_id % 2 = 0),
s AS (SELECT vec_id, k, {_dot("q", "u")} / 4 AS s FROM (SELECT vec_id, k, q, {_norm("p")} AS u FROM p JOIN q USING (vec_id)))
SELECT vec_id, round(max(s) FILTER (WHERE k = 0), 6) AS first_option, round(coalesce(max(s) FILTER (WHERE k = 1), 0), 6) AS second_option FROM s GROUP BY vec_id""")
def content_scores(spark, sf_dir):
    """What option lines add to their logits: two tokens for the first option, one for the second, which odd rows lack."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", _chunks(F.col("embedding")).alias("t"))
    span = lambda a, b: F.struct(F.lit(a).alias("first"), F.lit(b).alias("end"))
    spans = F.array(span(0, 2), F.when(F.col("vec_id") % 2 == 0, span(2, 3)).otherwise(span(-1, -1)))
    found = e.select("vec_id", T.content_scores(F.col("t"), F.get("t", F.lit(3)), spans, CONTENT).alias("s"))
    return found.select("vec_id", *[r6(F.get("s", F.lit(i))).alias(n) for i, n in enumerate(("first_option", "second_option"))])


# --- passes

LANES, ROWS, BUDGET = 4, 24, 20000
KEY = "('0x' || substr(md5('lane:' || {key}), 1, 8))::BIGINT % 4"


def _cut_sql(items: str) -> str:
    """Passes of items (lane, length, key, ...) as a recursion over each lane, longest first."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY length DESC, key) AS r FROM {items}),
f AS (SELECT lane, r, 0 AS pass, 1 AS held, length AS width FROM o WHERE r = 1
 UNION ALL SELECT o.lane, o.r, pass + new, CASE WHEN new = 1 THEN 1 ELSE held + 1 END, CASE WHEN new = 1 THEN o.length ELSE width END
  FROM (SELECT f.*, (held >= {ROWS} OR (held + 1) * width > {BUDGET})::INT AS new FROM f) f JOIN o ON o.lane = f.lane AND o.r = f.r + 1)"""


@query(f"""WITH RECURSIVE i AS (SELECT doc_id::VARCHAR AS key, {KEY.format(key="doc_id")} AS lane, coalesce(length(text), 0) AS length FROM documents), {_cut_sql("i")},
p AS (SELECT lane, pass, count(*) AS n, any_value(width) AS w, sum(length) AS t FROM f JOIN o USING (lane, r) GROUP BY ALL)
SELECT count(*) AS passes, sum(n)::BIGINT AS rows, sum(t)::BIGINT AS tokens, sum(n * w - t)::BIGINT AS padded FROM p""")
def runner_passes(spark, sf_dir):
    """Passes over all documents, longest first in four lanes: how many, and how much of them is padding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    passed = P.run_passes(docs, F.col("doc_id"), F.col("n"), F.col("text"), lambda texts: [len(t or "") for t in texts], "long", LANES, ROWS, BUDGET, ["n"])
    return P.padding(passed, F.col("n"))


def _asked(spark, sf_dir):
    """Documents with 1 to 12 questions each."""
    n = (F.col("doc_id") % 12 + 1).cast("int")
    questions = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("question "), i.cast("string")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request"), F.col("text").alias("state"), questions.alias("questions"))


@query(f"""WITH RECURSIVE i AS (SELECT doc_id, pos, doc_id || '/' || pos AS key, {KEY.format(key="doc_id || '/' || pos")} AS lane, length(coalesce(text, '')) + 10 + length((pos + 1)::VARCHAR) AS length FROM documents, range(12) t(pos) WHERE pos <= doc_id % 12), {_cut_sql("i")}
SELECT doc_id AS request, string_agg((length % 17)::VARCHAR, ',' ORDER BY pos) AS answers, count(DISTINCT (lane, pass)) AS passes FROM f JOIN o USING (lane, r) GROUP BY doc_id""")
def runner_answers(spark, sf_dir):
    """Requests of up to 12 questions, spread over passes and put together again in order."""
    out = P.answer_requests(_asked(spark, sf_dir), lambda texts: [[float(len(t) % 17)] for t in texts], LANES, ROWS, BUDGET)
    return out.select("request", F.array_join(F.transform("answers", lambda a: F.get(a, F.lit(0)).cast("int").cast("string")), ",").alias("answers"), "passes")


@query(f"""WITH RECURSIVE i AS (SELECT doc_id, k, doc_id || '/q/' || k AS key, {KEY.format(key="doc_id || '/q/' || k")} AS lane, 7 + length(k::VARCHAR) + 3 + length(coalesce(text, '')) AS length, length(coalesce(text, '')) AS n FROM documents, range(7) t(k) WHERE k <= doc_id % 6 + 1), {_cut_sql("i")},
c AS (SELECT lane, pass, count(*) * any_value(width) AS cost FROM f GROUP BY ALL)
SELECT doc_id, string_agg((length * (k + 2) % 19)::VARCHAR, ',' ORDER BY k) AS logits, round(1 / (1 + exp(-avg(length % 5)::DOUBLE)), 6) AS evidence, max(cost)::BIGINT AS cost FROM f JOIN o USING (lane, r) JOIN c USING (lane, pass) GROUP BY doc_id""")
def pair_scores(spark, sf_dir):
    """Every document with 2 to 7 options, a pair an input; no pass costs more than the budget unless one text does."""
    docs = table(spark, sf_dir, "documents")
    options = F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 6 + 1).cast("int")), lambda k: F.concat(F.lit("option "), k.cast("string")))
    questions = docs.select(F.col("doc_id").alias("id"), F.lit("q").alias("name"), options.alias("options"))

    def model(texts: list[str]) -> list[dict]:
        return [{"logit": float(len(t) * (int(t.split(" ", 2)[1]) + 2) % 19), "evidence": float(len(t) % 5)} for t in texts]

    out = P.score_pairs(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("state")), questions, model, LANES, ROWS, BUDGET)
    return out.select(F.col("id").alias("doc_id"), F.array_join(F.transform("logits", lambda z: z.cast("int").cast("string")), ",").alias("logits"), r6("evidence").alias("evidence"), "cost")


def _letters_sql(text: str) -> str:
    return f"(length({text}) - length(replace({text}, 'e', '')))"


@query(f"""WITH r AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 12 + 1 AS n FROM documents)
SELECT doc_id AS request, CASE WHEN n >= 8 THEN 'prefix' ELSE 'packed' END AS way, (SELECT string_agg((({_letters_sql("t")} + length(t)) * (i + 3) % 101)::VARCHAR, ',' ORDER BY i) FROM range(12) s(i) WHERE i < n) AS answers FROM r""")
def prefix_fan_out(spark, sf_dir):
    """States with 8 questions or more are encoded once, the others packed; both ways answer alike."""
    letters = lambda t: F.length(t) - F.length(F.replace(t, F.lit("e"), F.lit("")))
    number = lambda q: F.substring_index(q, " ", -1).cast("int")
    asked = _asked(spark, sf_dir).withColumn("state", F.coalesce("state", F.lit("")))
    encode = lambda df: df.withColumn("prefix", letters(F.col("_text")) + F.length("_text"))
    out = P.fan_out(asked, encode, lambda p, q: p * (number(q) + 2) % 101, lambda s, q: (letters(s) + F.length(s)) * (number(q) + 2) % 101)
    return out.select("request", "way", F.array_join(F.transform("answers", lambda a: a.cast("string")), ",").alias("answers"))


@query("""SELECT sum(doc_id % 12 + 1)::BIGINT AS asked, count(*) FILTER (WHERE doc_id % 12 < 7) + count(DISTINCT text) FILTER (WHERE doc_id % 12 >= 7) AS encoded FROM documents""")
def prefix_encodings(spark, sf_dir):
    """How many states are encoded for how many questions."""
    return P.encodings(_asked(spark, sf_dir))
