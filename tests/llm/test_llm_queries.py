"""The registered queries at the smallest scale: against SQL where there is some, else against plain Python."""

import binascii
import hashlib
import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from decidra.llm import pieces, quality_cnn, rules, simhash
from decidra.llm import queries as Q
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_against_sql(spark, name):
    duck = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        duck.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = Q.QUERIES[name](spark, SF)
    found = duck.execute(Q.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(found.fetchall(), names)


def test_op1(spark):
    rows, docs = Q.op1_shard(spark, SF).collect(), {d["doc_id"]: (d["text"] or "").encode() for d in table("documents")}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    slots = defaultdict(list)
    for r in rows:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id]) + 1, binascii.crc32(docs[r.doc_id]), "rows", None)
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op2_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in Q.op2_quality(spark, "/root/testdata/sf0.01").collect()}
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert all(r.held_out == quality_cnn.held_out(i) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())
    test = [(rows[i].score, y) for i, y in labels.items() if i in rows and rows[i].held_out]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def test_op4(spark):
    from test_text_ops import brute_rule

    rows = Q.op4_urls(spark, SF).collect()
    pages = {p["page_id"]: p["url"] for p in table("pages")}
    assert sorted(r.page_id for r in rows) == sorted(p["page_id"] for p in table("pages"))
    assert {r.verdict for r in rows} <= {"allow", "block"}
    for r in rows:
        host, path, rule, says = brute_rule(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (says or ("block" if r.score >= 0.5 else "allow"))


def test_op5(spark):
    from test_simhash import brute_components

    rows = sorted((tuple(r) for r in Q.op5_simhash(spark, SF).collect()), key=str)
    assert rows == brute_components([(d["doc_id"], d["text"]) for d in table("documents")])


def test_op9(spark):
    from test_licenses import brute, brute_method

    rows = {r.doc_id: r for r in Q.op9_licenses(spark, SF).collect()}
    for d in table("documents"):
        r = rows[d["doc_id"]]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(d["text"])
        if len(d["text"] or "") < 3000:
            labels, best = brute_method(d["text"])
            assert set(filter(None, r.labels.split(","))) == labels | set(filter(None, r.base_labels.split(",")))
            assert math.isclose(r.score, 1.0 if r.n_base else best)
            assert r.n_spans == len(list(filter(None, r.spans.split(","))))


def test_op10(spark):
    rows = Q.op10_pieces(spark, SF).collect()
    assert all(r.decoded and r.log_prob <= 0 and r.log_inclusion <= 0 for r in rows)
    found = {(r.doc_id, r["rank"]): r for r in rows}
    for d in table("documents")[:40]:
        own = pieces.sample_rows([d["text"]], np.array([pieces._row_key(d["doc_id"])], dtype=np.uint64), 2)[0]
        for rank, (ids, logp, _) in enumerate(own):
            r = found[d["doc_id"], rank]
            assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() and math.isclose(r.log_prob, logp)


# --- the pipeline, stage by stage in plain Python


def brute_rules(docs):
    counts = {d["doc_id"]: dict(zip(rules.COUNTS, rules.count_text((d["text"] or "").encode()))) for d in docs}
    ratio = lambda c, a, b: c[a] / c[b] if c[b] else 0.0
    bin_ = lambda r: 0 if r <= rules.LEAST else math.ceil(math.log(r / rules.LEAST) / math.log(rules.GAMMA))
    groups = defaultdict(list)
    for d in docs:
        for key in ((d["lang"], d["source"]), (d["lang"],), ()):
            groups[key].append(counts[d["doc_id"]])

    def levels(values):
        bins = sorted(map(bin_, values))
        found = [bins[-(-k * len(bins) // 100) - 1] for k in rules.LEVELS]
        return [0.0 if b == 0 else rules.LEAST * rules.GAMMA**b for b in found]

    def own_fence(group, a, b, size):
        v, grain = levels([ratio(c, a, b) for c in group]), size / max(1.0, levels([float(c[b]) for c in group])[0])
        for lo, hi in zip(v, v[1:]):
            if hi - lo >= rules.JUMP * grain:
                return (lo + hi) / 2
        return v[-1] + max(rules.REACH * (v[-1] - v[0]), rules.ROOM * grain)

    cache = {}

    def fence(keys, *metric):
        if (keys[0], metric) not in cache:
            own, n = own_fence(groups[keys[0]], *metric), len(groups[keys[0]])
            cache[keys[0], metric] = own if len(keys) == 1 else (n * own + rules.SHRINK * fence(keys[1:], *metric)) / (n + rules.SHRINK)
        return cache[keys[0], metric]

    out = []
    for d in docs:
        c = counts[d["doc_id"]]
        keys = [(d["lang"], d["source"]), (d["lang"],), ()]
        ok = c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"]
        for _, a, b, grain in rules.METRICS:
            ok = ok and ratio(c, a, b) <= fence(keys, a, b, grain)
        if ok:
            out.append(d)
    return out


def brute_clean(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for item in items:
        w = words(item["text"])
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in windows}
    out = []
    for d in docs:
        w, hit = words(d["text"]), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(d)
    return out


def brute_firsts(docs):
    """The smallest id of each class of texts linked by five-word shingles at a Jaccard similarity of 0.8."""
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), d["text"]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [d for i, d in enumerate(docs) if docs[i]["doc_id"] == min(docs[j]["doc_id"] for j in range(len(docs)) if top(j) == top(i))]


def test_pipeline_matches_plain_python(spark):
    docs = table("documents")
    kept = brute_rules(docs)
    model = quality_cnn.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [d for d in kept if quality_cnn.score(model, d["text"].encode()) >= Q.KEEP_SCORE]
    kept = brute_clean(brute_firsts(kept), table("benchmark"))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted({r.doc_id for r in rows}) == sorted(d["doc_id"] for d in kept) and len(kept) > 50
    texts = {d["doc_id"]: d["text"] for d in kept}
    assert all(pieces.decode(r.ids) == texts[r.doc_id] for r in rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name in ("_row", "_k", "_j", "_h", "_id", "_tag", "_hit", "_counts", "_fp", "score", "t_lang", "t_symbols", "k", "w"):
        docs = docs.withColumn(name, F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r._row == r._k == r.score == "mine" for r in rows)
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert simhash.fingerprint(b"") == 0


ODD = [
    (1, None), (None, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (4, "two words"), (None, "a null id"), (5, "é" * 3000), (6, "x" * 20000),
]


def odd_docs(spark):
    """Nulls in all columns, empty, spaceless and very long texts, repeated rows and ids, ties, clashing names."""
    rng = np.random.default_rng(4)
    prose = [" ".join("".join(rng.choice(list("etaoinsr"), 5)) for _ in range(n)) for n in (60, 120, 30000)]
    rows = ODD + [(10 + i, t) for i, t in enumerate(prose)] + [(10, prose[0]), (20, prose[0]), (None, prose[1])]
    rows = [(i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else "web", None if t is None else len(t), "mine") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")


def test_stages_survive_odd_rows(spark):
    docs = odd_docs(spark)
    prose = {r.doc_id for r in docs.collect() if r.text and len(r.text.split()) >= 50}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name == "tokens":
            assert len(rows) >= docs.count() and all(r.decoded for r in rows) and {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
        else:
            assert out.columns == docs.columns and all(r.n_words == "mine" for r in rows)
        if name == "quality_rules":  # the rules need 50 words; repeated rows are judged one by one
            assert {r.doc_id for r in rows} <= prose and [r.doc_id for r in rows].count(10) == 2
        if name == "near_duplicates":  # equal texts up to white space: the smallest id stays, a null id only if there is no other
            kept = [(r.doc_id, r.text) for r in rows]
            assert len(kept) == len(set(kept)) and sum(1 for _, t in kept if not (t or "").strip()) == 1
            assert 20 not in [i for i, _ in kept] and [i for i, t in kept if t and t.split()[:3] == docs.where("doc_id = 11").first().text.split()[:3]] == [11]
        if name == "decontamination":
            assert len(rows) == docs.count()
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_operator_queries_survive_odd_tables(spark, tmp_path):
    """Every opN query over tables of nulls, repeats and extra columns, and over empty ones."""
    docs = odd_docs(spark)
    conv = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, 1, "assistant", "é<|im_end|>")]
    pages = [(1, None, None), (1, "x", "h" * 200), (2, "HTTP://A.com/en/1", "h" * 200), (None, "http://h", "h" * 200), (2, "http://h", "")]
    tables = {
        "documents": docs,
        "labels": spark.createDataFrame([(10, 1, 0), (11, 0, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "two words")], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(0, [0.5, 0.5], 1), (0, [0.5, 0.5], 1), (1, [0.4, 0.5], 2), (None, [1.0], 2), (3, None, None), (4, [None, 0.1], 2), (6, [0.3, 0.2], 2)], "vec_id long, embedding array<float>, label int"),
        "conversations": spark.createDataFrame(conv, "conv_id long, turn long, role string, text string"),
        "pages": spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("digest", F.lit("mine")),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    n = {"op3_chat": 4, "op4_urls": 5, "op6_warc": 5, "op11_negatives": 0, "op12_packing": None, "op13_divergence": None}
    for name, query in Q.QUERIES.items():
        rows = query(spark, f"{tmp_path}/full").collect()
        assert len(rows) >= docs.count() if name == "op10_pieces" else n.get(name, docs.count()) in (None, len(rows)), name
        assert len(query(spark, f"{tmp_path}/none").collect()) == (1 if name == "op3_chat" else 0), name
