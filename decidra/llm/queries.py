"""One query for each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, hard_negatives, licenses, packing, pieces, quality_cnn, rules, sharding, simhash, urls, warc
from .common import read_table, shared_dir

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
KEEP_SCORE = 0.3


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's shard and slot (law rows). Null texts have size 1; rows that repeat, ties and null ids are placed one by one
    (see sharding.assign); an empty table gives no rows.
    """
    ring = sharding.Ring(shards=8, epsilon=0)
    placed = sharding.assign(read_table(spark, sf_dir, "documents"), ring, load="rows")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text. Null texts count as empty, repeated rows are scored one by one, a null id is never held
    out; without labels of both kinds all scores are one constant; an empty table gives no rows.
    """
    docs = read_table(spark, sf_dir, "documents")
    model = quality_cnn.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality_cnn.with_score(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(quality_cnn.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -1. Null texts and roles count as empty, null ids are one
    conversation, repeated rows stay, equal turns go by role and text; empty tables leave conversation -1 alone.
    """
    said = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(said).alias("text"))
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digest(turns.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page. A null url, and one without ://, has empty host and path; repeated rows are judged one by
    one; of equally long rules the later one counts; an empty table gives no rows.
    """
    model = urls.fit(urls.generated_labelled(spark))
    judged = urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES, model)
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row; see simhash.near_duplicates for nulls, empty texts, repeats and empty tables."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from the archives. Null payloads are empty; null ids never are what others refer to unless
    there is no other; repeated rows give a record each; an empty table gives no rows.
    """
    path = shared_dir(spark, "warc")
    warc.write_warc(warc.page_records(read_table(spark, sf_dir, "pages")), path)
    # responses are read whole and hashed; of revisits only headers, their neighbours' payloads are passed over
    full = warc.read_warc(spark, path).where("record_type = 'response'").select("record_id", "payload_length", F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")
    heads = warc.read_warc(spark, path, payload="false").where("record_type = 'revisit'").select(*full.columns)
    return full.unionByName(heads).select(
        warc.page_of("record_id").try_cast("long").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        warc.page_of("refers_to").try_cast("long").alias("refers_to"),
    )


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every row; see rules.judge for nulls, empty texts, repeats, small groups and empty tables."""
    judged = rules.judge(read_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words of every row. Null and empty texts have no words and are clean; repeated rows are judged alike; ids that repeat
    with other texts apart; an empty benchmark hits nothing; an empty table gives no rows.
    """
    judged = decontaminate.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return judged.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and notices of every whole text. Null texts count as empty; repeated rows are scanned one by one; of equally good
    matches the first counts; an empty table gives no rows.
    """
    found = licenses.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licence.spans", lambda s: F.concat_ws(":", s["label"], s["start"], s["end"], s["edits"]))
    digest = [F.size("licence.spans").cast("long").alias("n_spans"), F.array_join(spans, ",").alias("spans")]
    own = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return found.select("doc_id", *[F.col(f"licence.{c}").alias(c) for c in own], *digest)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every whole text, one where there is no second. Null texts count as empty; rows of equal id
    and text get equal samples, a null id is a key like any other; an empty table gives no rows.
    """
    found = pieces.sampled(read_table(spark, sf_dir, "documents"), k=2)
    ids = F.sha2(F.array_join(F.col("ids"), ","), 256)
    return found.select("doc_id", "rank", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), "log_prob", "log_inclusion", "decoded")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors; see hard_negatives.mine for nulls, ties, repeats and empty tables."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), "embedding")
    return hard_negatives.mine(hard_negatives.numbers(rows), F.col("id") % 100 == 0)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096; see packing.pack for nulls, long texts, repeats and empty tables."""
    return packing.pack(read_table(spark, sf_dir, "documents"), with_ids=False)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances and own terms of all sources; see divergence for nulls, ties, repeats and empty tables."""
    return divergence.audit(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_shard": op1_shard,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_urls": op4_urls,
    "op5_simhash": op5_simhash,
    "op6_warc": op6_warc,
    "op7_rules": op7_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_licenses": op9_licenses,
    "op10_pieces": op10_pieces,
    "op11_negatives": op11_negatives,
    "op12_packing": op12_packing,
    "op13_divergence": op13_divergence,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"

CHAT_SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
 coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
 sum(24 + length({ESCAPED.format("r")}) + length({ESCAPED.format("t")}))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

WARC_SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f"""

_RATIO = {name: f"CASE WHEN {under} > 0 THEN {top}::DOUBLE / {under} ELSE 0 END" for name, top, under, _ in rules.METRICS}
_S = f"{rules.SHRINK!r}::DOUBLE"
_LINES = "list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^ \\x09-\\x0D]'))"
RULES_SQL = f"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS x, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS tri FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
h AS (SELECT DISTINCT doc_id, i + j AS at FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g) CROSS JOIN range(3) r(j) WHERE n > 1),
hc AS (SELECT doc_id, count(*) AS n_repeat_words FROM h GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(x, '[ \\x09-\\x0D]', '', 'g')) AS word_chars, length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len({_LINES}) - len(list_distinct({_LINES})) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len({_LINES}) AS n_lines, length(x) - length(regexp_replace(x, '[A-Z]', '', 'g')) AS n_upper FROM d LEFT JOIN hc USING (doc_id)),
m AS (SELECT lang, source, u.metric, CASE WHEN u.r <= {rules.LEAST} THEN 0 ELSE ceil(ln(u.r / {rules.LEAST}) / {math.log(rules.GAMMA)!r}) END AS bin
 FROM (SELECT lang, source, unnest([{", ".join(f"{{'metric': '{n}', 'r': {r}}}" for n, r in (_RATIO | {n: f"{n}::DOUBLE" for n in rules.LENGTHS}).items())}]) AS u FROM c)),
own AS (SELECT lang, source, metric, bin, count(*) AS n FROM m GROUP BY ALL),
lv AS (SELECT 0 AS lvl, lang, source, metric, bin, n FROM own UNION ALL SELECT 1, lang, NULL, metric, bin, sum(n) FROM own GROUP BY lang, metric, bin UNION ALL SELECT 2, NULL, NULL, metric, bin, sum(n) FROM own GROUP BY metric, bin),
cu AS (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS total FROM lv),
q AS (SELECT lvl, lang, source, metric, k, any_value(total)::DOUBLE AS total, min(bin) AS bin FROM cu CROSS JOIN range({rules.LEVELS[0]}, {rules.LEVELS[-1] + 1}) r(k) WHERE 100 * upto >= k * total GROUP BY ALL),
v AS (SELECT lvl, lang, source, metric, any_value(total) AS total, list(CASE WHEN bin = 0 THEN 0 ELSE {rules.LEAST} * {rules.GAMMA}::DOUBLE ** bin END ORDER BY k) AS v FROM q GROUP BY lvl, lang, source, metric),
gr AS (SELECT a.*, CASE a.metric {" ".join(f"WHEN '{n}' THEN {g}" for n, _, _, g in rules.METRICS)} END / greatest(1.0::DOUBLE, b.v[1]) AS grain FROM v a
 JOIN v b ON a.lvl = b.lvl AND a.lang IS NOT DISTINCT FROM b.lang AND a.source IS NOT DISTINCT FROM b.source AND b.metric = CASE a.metric {" ".join(f"WHEN '{n}' THEN '{u}'" for n, _, u, _ in rules.METRICS)} END),
ju AS (SELECT *, list_filter(range(1, {len(rules.LEVELS)}), lambda i: v[i + 1] - v[i] >= {rules.JUMP} * grain)[1] AS j FROM gr),
f AS (SELECT lvl, lang, source, metric, total, (CASE WHEN j IS NOT NULL THEN (v[j] + v[j + 1]) / 2 ELSE v[{len(rules.LEVELS)}] + greatest({rules.REACH} * (v[{len(rules.LEVELS)}] - v[1]), {rules.ROOM} * grain) END)::DOUBLE AS fence FROM ju),
t AS (SELECT a.lang, a.source, a.metric, (a.total * a.fence + {_S} * ((b.total * b.fence + {_S} * e.fence) / (b.total + {_S}))) / (a.total + {_S}) AS fence
 FROM f a JOIN f b ON b.lvl = 1 AND b.metric = a.metric AND b.lang IS NOT DISTINCT FROM a.lang JOIN f e ON e.lvl = 2 AND e.metric = a.metric WHERE a.lvl = 0),
pv AS (SELECT lang, source, {", ".join(f"max(fence) FILTER (WHERE metric = '{n}') AS t_{n}" for n in _RATIO)} FROM t GROUP BY lang, source),
j AS (SELECT c.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {" AND ".join(f"{r} <= t_{n}" for n, r in _RATIO.items())} AS fine
 FROM c JOIN pv ON pv.lang IS NOT DISTINCT FROM c.lang AND pv.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND fine AS kept FROM j"""

_WORDS = f"list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
DECONTAMINATE_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {decontaminate.WINDOW}) AS n, w, unnest(range(1, len(w) - least(len(w), {decontaminate.WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM bw),
ln AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN ln WHERE len(w) >= n)),
oc AS (SELECT doc_id, item_id, i, n FROM dg JOIN win USING (n, g)),
ht AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM oc) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM oc GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN ht USING (doc_id) LEFT JOIN it USING (doc_id)"""

NEGATIVES_SQL = """WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
 FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""

_SHARE = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total} + 5 * terms)"
DIVERGENCE_SQL = f"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(t) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(t)) AS term FROM d) GROUP BY ALL HAVING count(*) >= {divergence.LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
y AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS terms FROM x),
z AS (SELECT lang, term, sum(n) AS n_lang, sum(sum(n)) OVER (PARTITION BY lang) AS total_lang FROM x GROUP BY lang, term),
s AS (SELECT lang, source, term, n, {_SHARE.format(n="n", total="total")} AS p, {_SHARE.format(n="n_lang", total="total_lang")} AS q FROM y JOIN z USING (lang, term)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT *, (row_number() OVER w)::INTEGER AS rank FROM o WINDOW w AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR row_number() OVER w <= {divergence.TOP}"""

ORACLE: dict[str, str] = {
    "op3_chat": CHAT_SQL,
    "op6_warc": WARC_SQL,
    "op7_rules": RULES_SQL,
    "op8_decontaminate": DECONTAMINATE_SQL,
    "op11_negatives": NEGATIVES_SQL,
    "op13_divergence": DIVERGENCE_SQL,
}
