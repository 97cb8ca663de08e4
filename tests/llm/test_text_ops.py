"""Chat formatting, decontamination, classifier, URL filter and WARC against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.llm import chat, decontaminate, quality_cnn, urls, warc
from decidra.llm.queries import URL_RULES

# --- chat

TURNS = [
    (1, 0, "user", "hi"),
    (1, 1, "assistant", "<|im_end|> <\\|x|> <\\\\| é\n"),
    (1, 1, "assistant", "<|im_end|> <\\|x|> <\\\\| é\n"),
    (2, None, None, None),
    (2, 5, "assistant", None),
    (2, -3, "a\nb<|nl|>", "<||<|<\\"),
    (None, 0, "assistant", "alone 🎈"),
    (3, 0, "assistant", "x" * 70000),
] + [(4, i, "assistant" if i % 2 else "user", f"turn <|{i}|>") for i in range(300)]
CONV = "conv_id long, turn long, role string, text string, block string"


def chat_frame(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], CONV)
    return df.withColumn("parts", chat.text_part(F.col("text")))


def test_chat_reads_back(spark):
    got = {r.conv_id: r for r in chat.digest(chat_frame(spark, TURNS)).collect()}
    for conv in {t[0] for t in TURNS}:
        rows = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
        loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(rows), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest(chat_frame(spark, TURNS).limit(0)).collect() == []


def test_whole_conversations_have_spans_over_their_text(spark):
    for r in chat.format_conversations(chat_frame(spark, TURNS)).collect():
        own = [t for t in TURNS if t[0] == r.conv_id and t[2] == "assistant"]
        texts = [re.sub(r"<\\(\\*)\|", r"<\1|", r.formatted[s.start : s.start + s.size]) for s in r.loss_spans]
        assert sorted(texts) == sorted(t[3] or "" for t in own)


def test_parts_become_placeholders(spark):
    parts = [
        ("text", "see <|image|>", None, None, None, None, None),
        ("image", None, "s3://a.png", 56, 29, None, None),
        ("audio", None, "b.wav", None, None, 1.5, None),
        ("document", None, "c.pdf", None, None, None, 2),
        ("video", None, "d.mp4", None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|file|><|file|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3://a.png", 4), ("audio", "b.wav", 38), ("document", "c.pdf", 512), ("video", "d.mp4", 0), (None, None, 0)]
    assert r.media_tokens == 554


# --- decontamination


def words(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute_hits(doc, items):
    w, hit, found = words(doc), set(), set()
    for item, text in items:
        b = words(text)
        n = min(13, len(b))
        for k in range(len(b) - n + 1 if n else 0):
            for s in range(len(w) - n + 1):
                if w[s : s + n] == b[k : k + n]:
                    hit |= set(range(s, s + n))
                    found.add(item)
    return len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit) and 20 * len(hit) >= len(w)


def contaminated_corpus():
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(30)] + ["École", "ÉCOLE"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(13, 30))) for i in range(8)] + [(9, items_dup := text(20)), (10, items_dup)]
    items += [(11, "w1 w1"), (12, "School"), (13, ""), (14, None), (15, "..."), (16, "w2 " * 20), (None, "null item here")]
    docs = [(1, None), (2, ""), (3, "school"), (4, "w2 " * 40), (5, "null item HERE"), (6, "w1 w1 w1"), (6, "w1"), (None, items[0][1])]
    for i in range(40):
        body = items[i % 10][1].split()
        a = rng.randint(0, 3)
        docs.append((100 + i, text(rng.randint(0, 200)) + ", " + "-".join(body[a : a + rng.randint(10, 20)]).upper() + " " + text(5)))
    return docs + docs[-2:], items


def test_decontamination_matches_brute_force(spark):
    docs, items = contaminated_corpus()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in decontaminate.judge(d, b).collect()), key=str)
    assert got == sorted(((i, *brute_hits(t, items)) for i, t in docs), key=str)
    kept = decontaminate.keep(d, b)
    assert kept.columns == d.columns
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str((i, t)) for i, t in docs if not brute_hits(t, items)[3])
    assert decontaminate.judge(d.limit(0), b).collect() == []
    assert all(not r.contaminated for r in decontaminate.judge(d, b.limit(0)).collect())


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, items = contaminated_corpus()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.judge(d, b).collect(), key=str)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(decontaminate.judge(d, b).collect(), key=str) == want
    assert decontaminate.keep(d, b).count() == sum(not r.contaminated for r in want)


# --- classifier


def labelled(n, seed=3):
    rng = random.Random(seed)
    for i in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(rng.randint(5, 400))]
        yield i, i % 3 > 0, " ".join(w) if i % 3 else "$$$ ".join(w)


def test_classifier_learns_and_scores_whole_texts():
    rows = list(labelled(240))
    model = quality_cnn.train([t.encode() for _, _, t in rows[:160]], [int(y) for _, y, _ in rows[:160]])
    right = [(quality_cnn.score(model, t.encode()) >= 0.5) == y for _, y, t in rows[160:]]
    assert np.mean(right) > 0.95
    assert 0 <= quality_cnn.score(model, b"") <= 1
    long = b"abcde fghij " * 200_000
    assert 0 <= quality_cnn.score(model, long) <= 1


def test_chunks_cover_every_byte():
    rng = np.random.default_rng(0)
    filters, bias = rng.normal(0, 0.1, (quality_cnn.TAPS, 256, quality_cnn.FILTERS)).astype(np.float32), np.zeros(quality_cnn.FILTERS, dtype=np.float32)
    filters[:, 7] = 50
    for size in (1, 64, 255, 256, 257, 1000, 5000):
        for at in {0, size // 2, size - 1}:
            body = bytearray(b"a" * size)
            body[at] = 7
            assert quality_cnn.pooled(filters, bias, bytes(body)).max() > 20


def test_scores_by_row(spark):
    rows = list(labelled(120)) + [(None, True, None), (5, True, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, _, t in rows], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, int(y), 0) for i, y, _ in rows], "doc_id long, quality int, toxic int")
    model = quality_cnn.fit(docs, labels)
    out = quality_cnn.with_score(docs, model)
    assert out.columns == [*docs.columns, "score"]
    assert all(0 <= r.score <= 1 for r in out.collect()) and out.count() == len(rows)
    clash = quality_cnn.with_score(docs.withColumn("score", F.lit("mine")), model)
    assert clash.columns[-2:] == ["score", "score_"] and clash.first().score == "mine"
    none = quality_cnn.fit(docs.limit(0), labels)
    assert quality_cnn.with_score(docs, none).first().score == 0.5
    got = docs.where("doc_id is not null").select("doc_id", (quality_cnn.fold(F.col("doc_id")) == 0).alias("h")).collect()
    assert all(r.h == quality_cnn.held_out(r.doc_id) for r in got)


# --- urls


def brute_rule(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m.group().lower(), found[1]), found[2]) if found else ("", "")
    best = None
    for rule, says in URL_RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, says)
    return host, path, *(best or (None, None))


URLS = [None, "", "nourl", "http://EXAMPLE.com/en/7?x", "https://a.example.com/en/8", "ftp://x.notcom/en/", "http://com/en/", "http://example.net/de/85#a", "http://example.net/de/9", "://h/p", "http://é.org/es/x", "http://h?q=://b/c", "http://cheap-pills.example.org/x", "http://a\nb/c"] + ["http://x.com/" + "a" * 9000]


def test_url_rules_and_trees(spark):
    model = urls.fit(urls.generated_labelled(spark, 3000))
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(URLS)] + [(0, None, 2)], "page_id long, url string, score int")
    got = urls.judge(df, URL_RULES, model).collect()
    assert len(got) == len(URLS) + 1
    scores = dict(zip(URLS, model.score(URLS)))
    for r in got:
        host, path, rule, says = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (says or ("block" if scores[r.url] >= 0.5 else "allow"))
    assert urls.judge(df.limit(0), URL_RULES, model).collect() == []


def test_trees_judge_hosts_they_have_not_seen(spark):
    train, test = urls.generated_labelled(spark), urls.generated_labelled(spark, 2000, seed=77).collect()
    model = urls.fit(train)
    seen = {urls.split_url(r.url)[0] for r in train.collect()}
    fresh = [r for r in test if urls.split_url(r.url)[0] not in seen]
    assert len(fresh) > 1950
    scores, y = model.score([r.url for r in fresh]), np.array([r.label for r in fresh])
    assert np.mean((scores >= 0.5) == y) > 0.9  # the share of the larger class is 0.75
    for only in (0, 1):
        one = urls.fit(train.where(f"label = {only}"))
        assert len(set(one.score(URLS).tolist())) == 1 and (one.score(URLS)[0] >= 0.5) == bool(only)


def test_trees_beat_the_base_rate_and_survive_nothing():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.5)).astype(float)
    assert np.mean((urls.fit_trees(x, y).predict(x) >= 0.5) == y) > 0.9
    assert urls.fit_trees(np.zeros((0, 4)), np.zeros(0)).predict(x)[0] == 0.5


# --- warc


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 60
    pages = [(5, "http://a/\r\nX: y", big), (3, None, big), (3, "u", big), (9, "http://b", big), (None, "n", big), (1, "s", "small"), (2, "s", "small"), (7, "e", None), (8, "e", ""), (10, "l", "<p>\r\n\r\n" * 40000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload int")
    path = str(tmp_path / "archive")
    warc.write_warc(warc.page_records(df), path)
    rows = warc.read_warc(spark, path).collect()
    assert len(rows) == len(pages)
    for page_id, _, html in pages:
        body = (html or "").encode()
        name = f"<urn:page:{'' if page_id is None else page_id}/{hashlib.sha256(body).hexdigest()[:16]}>"
        for r in (r for r in rows if r.record_id == name):
            assert (r.payload_length, r.payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
            revisit = html == big and page_id != 3
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.refers_to == (f"<urn:page:3/{hashlib.sha256(body).hexdigest()[:16]}>" if revisit else None)
            assert r.payload is None if revisit else bytes(r.payload) == body
    only = warc.read_warc(spark, path).where("record_type = 'revisit'")
    assert only.count() == 3
    assert warc.read_warc(spark, path, payload="false", record_types="response").where("payload is not null").count() == 0
    reader = warc.WarcReader({"path": path, "record_types": "revisit"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 3


def test_plain_archives_are_read(spark, tmp_path):
    data = warc.record_bytes("<a>", "response", "http://x", b"one", None, None, None) + warc.record_bytes("<b>", "revisit", "http://y", None, "aa", 3, "<a>")
    (tmp_path / "x.warc").write_bytes(data)
    import gzip

    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(warc.record_bytes("<c>", "response", None, b"z" * 50000, None, None, None)) * 2)
    rows = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((r.record_id, r.payload_length) for r in rows) == [("<a>", 3), ("<b>", 3), ("<c>", 50000), ("<c>", 50000)]


def test_damaged_and_foreign_archives(spark, tmp_path):
    import gzip

    from pyarrow import fs

    local = fs.LocalFileSystem()
    one = lambda n, body: f"WARC/1.1\r\nwarc-type: resource\r\nwarc-record-id: <{n}>\r\nX-Note: a\r\n b\r\nX-Note: c\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [b"first", b"", b"z" * 300_000, b"WARC/1.0\r\n\r\n", b"\x1f\x8b" * 9]
    several = b"".join(one(i, b) for i, b in enumerate(bodies))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(several) + gzip.compress(one(9, b"last")))
    (tmp_path / "b.warc").write_bytes(several)
    for name, more in (("a.warc.gz", [(9, b"last")]), ("b.warc", [])):
        got = list(warc.read_file(local, str(tmp_path / name)))
        assert [(h.get("WARC-Record-ID"), b) for h, b in got] == [(f"<{i}>", b) for i, b in [*enumerate(bodies), *more]]
        assert got[0][0].get("X-Note") == "a b, c"
        some = list(warc.read_file(local, str(tmp_path / name), lambda h: h.get("warc-record-id") in ("<1>", "<3>"), False))
        assert [h.get("WARC-RECORD-ID") for h, _ in some] == ["<1>", "<3>"]
    rows = warc.read_warc(spark, str(tmp_path)).where("record_type = 'resource'").collect()
    assert len(rows) == 11 and {r.payload_length for r in rows if r.record_id == "<2>"} == {300_000}
    whole = (tmp_path / "a.warc.gz").read_bytes()
    for name, data in {"c.warc.gz": whole[:-30], "d.warc": several[:-9], "e.warc": b"junk\r\n\r\n", "f.warc.gz": warc.gzip_member(one(1, bytes(range(256)) * 99))[:60]}.items():
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            list(warc.read_file(local, str(tmp_path / name)))


def test_appending_writers_keep_each_others_files(spark, tmp_path):
    path = str(tmp_path / "a")
    for part in ([("a/b c", "u", "x" * 200)], [("é>", "u", "x" * 200), (None, "u", None)]):
        warc.write_warc(warc.page_records(spark.createDataFrame(part, "page_id string, url string, html string")), path)
    got = warc.read_warc(spark, path).select(warc.page_of("record_id").alias("p")).collect()
    assert sorted(str(r.p) for r in got) == ["None", "a/b c", "é>"]


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, tmp_path, n):
    df = spark.createDataFrame([(1, "u", "h")][:n], "page_id long, url string, html string")
    warc.write_warc(warc.page_records(df), str(tmp_path / "a"))
    assert warc.read_warc(spark, str(tmp_path / "a")).count() == n
