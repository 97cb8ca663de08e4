import random

import numpy as np
from decidra.llm import quality_cnn


def corpus():
    """Long texts that differ only after their first 16 KiB."""
    rng = random.Random(4)
    words = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    return [(i, i % 2, words("abcdefgh", 3000) + " " + words("abcdefgh" if i % 2 else "xyz!#", 3000)) for i in range(60)]


def test_fit_learns_from_what_comes_after_16_kib(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, y, _ in rows], "doc_id long, quality int, toxic int")
    model = quality_cnn.fit(docs, labels)
    held = [(quality_cnn.score(model, t.encode()) >= 0.5) == bool(y) for i, y, t in rows if quality_cnn.held_out(i)]
    assert len(held) > 5 and np.mean(held) > 0.9


def test_fit_describes_whole_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, y, _ in rows], "doc_id long, quality int, toxic int")
    used = [t.encode() for i, _, t in rows if not quality_cnn.held_out(i)]
    model = quality_cnn.fit(docs, labels)
    chunks = [np.log(len(quality_cnn.pooled(model.filters, model.bias, b))) for b in used]
    assert np.isclose(model.mean[-1], np.mean(chunks))
