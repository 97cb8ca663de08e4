import random
import re

import pytest

from decidra.llm.licenses import NOTICES, load_notices, scan, scan_text


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    found = [(i, label) for i in range(len(words)) for p, label in phrases.items() if tuple(words[i : i + len(p)]) == p]
    at = [i for i, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


TEXTS = [None, "", "MIT License", "mit-license. MIT  LICENSE\nlicense", "general public\nlicense mit", "smit license mit licenses", "é mit license", "GNU GENERAL PUBLIC LICENSE apache license " * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_base_matches_brute_force(text):
    got = scan_text((text or "").encode())
    assert tuple(got[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute(text)
    assert set(filter(None, got["base_labels"].split(","))) <= set(got["labels"].split(",")) and 0 <= got["score"] <= 1


def test_notices_with_bounded_edits_are_found():
    rng = random.Random(1)
    for notice, label in NOTICES:
        chars = list(notice)
        for _ in range(max(1, len(notice) // 10)):
            chars[rng.randrange(len(chars))] = "q"
        got = scan_text(("words before " + "".join(chars) + " words after").encode())
        assert label in got["labels"].split(","), notice
        assert any(s["label"] == label and s["first_word"] == 2 for s in got["spans"])
    assert scan_text(b"nothing to be seen here at all")["labels"] == ""


def test_rows_stay(spark):
    df = spark.createDataFrame([(1, t, "x") for t in TEXTS + TEXTS], "doc_id long, text string, n_words string")
    out = scan(df)
    assert out.columns == [*df.columns, "licence"] and out.count() == 2 * len(TEXTS)
    assert scan(df.limit(0)).collect() == []
    clash = scan(df.withColumn("licence", df.text))
    assert clash.columns[-2:] == ["licence", "licence_"]


def test_damaged_copies_beside_better_ones_are_reported():
    good, bad = "licensed under the mit license", "licensed undr the mit licence"
    for text in (f"{bad} {good}", f"{good} {bad}", f"{bad} {good} {bad}", f"{good} {good} {bad} {good}"):
        want, at = [], 0
        for part in text.replace(good, "G").replace(bad, "B").split():
            size = len(good if part == "G" else bad)
            want.append((at, at + size))
            at += size + 1
        spans = [(s["start"], s["end"]) for s in scan_text(text.encode(), (("licensed under the mit license", "mit"),))["spans"]]
        assert spans == want


def test_notices_come_from_a_table(spark):
    table = spark.createDataFrame([("Licensed under the BOOST\nSoftware License.", "boost"), (None, "x"), ("short", "s")], "notice string, label string")
    found = load_notices(table)
    assert found == [("licensed under the boost software license", "boost")]
    assert scan_text(b"is licensed under the boost softvare license", tuple(found))["labels"] == "boost"


def brute_method(text):
    """Labels and best score with every notice matched over the whole text, without seeds."""
    import regex
    from decidra.llm.licenses import CHARS_PER_EDIT

    plain = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))).encode()
    labels, best = set(), 0.0
    for notice, label in NOTICES:
        edits = max(1, len(notice) // CHARS_PER_EDIT)
        m = regex.search(b"(?b)(?:" + regex.escape(notice.encode()) + b"){e<=%d}" % edits, plain)
        if m:
            labels.add(label)
            best = max(best, 1 - sum(m.fuzzy_counts) / len(notice))
    return labels, best
