"""Source divergence against plain Python, on tables small enough to count by hand."""

import re
from collections import Counter, defaultdict

from decidra.llm import divergence as D


def brute(docs, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    groups, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        groups[lang or "", source or ""].update(terms(text))
        held[lang or ""].update(set(terms(text)))
    out = []
    for lang in held.keys() | {g[0] for g in groups}:
        kept = sorted(t for t, d in held[lang].items() if d >= least)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}  # noqa: B023, E731
        own, q = {s: share(c) for s, c in mine.items()}, share(sum(mine.values(), Counter()))
        for s, p in own.items():
            far = sorted((-sum(abs(p[t] - own[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(far, 1)]
            high = sorted((q[t] - p[t], t.encode(), t) for t in kept if mine[s][t] and p[t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(high[:top], 1)]
    return sorted(out)


DOCS = [
    ("The cat, the CAT and the dog", "en", "a"), ("the dog é É", "en", "b"), ("the cat", "en", "b"), ("a the cat é", "en", None), (None, "en", "void"), ("", "de", "a"),
    ("12 !!", "de", "b"), ("ein Haus ein Haus", None, "a"), ("ein Haus", None, "c"), ("ein haus", None, None), ("the dog é É", "en", "b"), ("x" * 5000 + " the", "en", "a"),
]


def frame(spark, docs):
    return spark.createDataFrame([(i, *d, "mine") for i, d in enumerate(docs)], "doc_id long, text string, lang string, source string, n string")


def test_against_plain_python(spark):
    for least, top in ((1, 50), (2, 2), (3, 50), (9, 50)):
        rows = D.audit(frame(spark, DOCS), least, top).collect()
        assert sorted(map(tuple, rows)) == brute(DOCS, least, top)


def test_shares_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**13 + 7, 3 * 10**13, 1)], "n long, total long, terms long")
    assert df.select(D._share("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**13 + 12) // (3 * 10**13 + 5)


def test_empty_table(spark):
    assert D.audit(frame(spark, DOCS).limit(0)).collect() == []
