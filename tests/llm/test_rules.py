import random
import re

from decidra.llm import rules

SCHEMA = "doc_id long, lang string, source string, text string, t_lang string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = list(zip(words, words[1:], words[2:]))
    hit = set()
    for i, w in enumerate(wins):
        if wins.count(w) > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


TEXTS = [None, "", " \n\t ", "a", "a b a b a b a b", "x\nx\n x\n\nx", "é # ü $$ <b>|</b>\x0bnew\x1cline z\n", "ab c " * 300]


def test_counts_match_brute_force():
    rng = random.Random(3)
    more = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for text in TEXTS + more:
        assert rules.count_text((text or "").encode())[:5] == brute(text)


def clean_text(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120))


def test_fences_adapt_and_keep_clean(spark):
    rng = random.Random(5)
    data = [(i, "en", "s", clean_text(rng)) for i in range(150)]
    data += [(1000 + i, "en", "s", clean_text(rng).replace(" ", "*** ")) for i in range(40)]
    code = [(2000 + i, "en", "code", clean_text(rng).replace(" ", "| ")) for i in range(150)]
    rows = [(*r, "x") for r in data + code] + [(-9, None, None, t, "x") for t in TEXTS]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.kept for r in rules.judge(df).collect() if r.doc_id != -9}
    assert all(got[i] for i in range(150)) and not any(got[1000 + i] for i in range(40))
    assert all(got[2000 + i] for i in range(150))
    kept = rules.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, v in got.items() if v)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rules.judge(df).collect() == [] and rules.keep(df).collect() == []


def test_small_groups_count_in_proportion(spark):
    """The fence of a group moves from its language's to its own as it grows, without a jump."""
    rng = random.Random(9)
    base = [(i, "en", "big", clean_text(rng), "x") for i in range(400)]
    fences = []
    for n in (5, 60, 99, 101, 150, 400):
        code = [(1000 + i, "en", "code", clean_text(rng).replace(" ", "| "), "x") for i in range(n)]
        counts = rules.text_counts(spark.createDataFrame(base + code, SCHEMA))
        fences.append({r.t_source: r.t_symbols for r in rules.thresholds(counts).collect()}["code"])
    assert fences[0] < 0.13 and fences[-1] > 0.2 and fences == sorted(fences)
    assert 0 < fences[3] - fences[2] < 0.01  # nothing happens at 100 rows
    alone = {r.t_source: r.t_symbols for r in rules.thresholds(counts, shrink=0.0).collect()}
    assert alone["code"] > 0.2 and alone["big"] < 0.12


def test_no_fixed_cutoff_does_the_same(spark):
    """Junk of one group has fewer symbols than clean rows of another; each group's own jump parts them."""
    rng = random.Random(2)
    some = lambda t, every: " ".join(w + "*" if i % every == 0 else w for i, w in enumerate(t.split(" ")))
    rows = [(i, "en", "prose", clean_text(rng)) for i in range(300)] + [(1000 + i, "en", "prose", some(clean_text(rng), 3)) for i in range(30)]
    rows += [(2000 + i, "en", "code", some(clean_text(rng), 1)) for i in range(300)] + [(3000 + i, "en", "code", clean_text(rng).replace(" ", "##### ")) for i in range(30)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    kept = {r.doc_id for r in rules.judge(df).collect() if r.kept}
    assert kept == {*range(300), *range(2000, 2300)}
    fences = {r.t_source: r.t_symbols for r in rules.thresholds(rules.text_counts(df)).collect()}
    assert fences["prose"] < 1 / 18 < 1 / 6 < fences["code"]


def test_fences_of_the_tables_differ_and_lose_no_good_document(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    fences = rules.thresholds(rules.text_counts(docs)).collect()
    assert len({round(r.t_symbols, 6) for r in fences}) > len(fences) / 2 and len({round(r.t_capitals, 6) for r in fences}) > len(fences) / 2
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    lost = rules.judge(docs).where("NOT kept AND NOT base_failed").join(labels, "doc_id").groupBy("quality").count().collect()
    assert {r.quality for r in lost} == {0} and lost[0]["count"] > 200
