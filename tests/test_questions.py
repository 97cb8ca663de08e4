import json

import pytest
from pyspark.sql import functions as F

from decidra.functions import text as X
from decidra.schema import InvalidQuestion, Question, check_limits, load_questions
from decidra.sources import records as R


@pytest.mark.parametrize(
    "raw",
    [
        {"type": "choice", "instructions": "x", "options": {"a": None}},
        {"type": "score", "instructions": "x", "levels": ["one"]},
        {"type": "score", "instructions": "x", "levels": list("abcdefghijk")},
        {"type": "bool", "instructions": "x", "options": {"a": None, "b": None}},
        {"type": "bool", "instructions": "  "},
        {"type": "choice", "instructions": "x", "options": {"a": None, "b": None}, "levels": ["l", "m"]},
        {"type": "score", "instructions": "x", "levels": ["l", "m"], "yes": "y"},
        {"type": "maybe", "instructions": "x"},
        {"type": "choice", "instructions": "x", "options": {str(i): None for i in range(256)}},
    ],
)
def test_bad_questions_are_refused(raw):
    with pytest.raises(InvalidQuestion):
        Question.parse(raw)


def test_both_dialects_give_the_same_question():
    own = Question.parse({"type": "choice", "instructions": "q", "options": {"b": "B", "a": None}})
    assert own == Question.parse({"type": "choice", "instructions": "q", "criteria": {"b": "B", "a": None}})
    assert own.keys == ["b", "a"] and Question.parse(own.to_dict()) == own
    noul = Question.parse({"type": "noul", "instructions": "q", "criteria": {"true": "t", "false": "f"}})
    assert (noul.type, noul.yes, noul.no) == ("bool", "t", "f")
    assert Question.parse({"type": "score", "instructions": "q", "criteria": ["l", "m", "h"]}).keys == ["0", "1", "2"]
    with pytest.raises(InvalidQuestion):
        load_questions("{}")
    with pytest.raises(InvalidQuestion):
        own.lines([0, 0])
    with pytest.raises(ValueError):
        check_limits(nodes=257)


def test_display_order_moves_labels_not_options():
    q = Question.parse({"type": "choice", "instructions": "q", "options": {"aa_x": "one", "b": "two"}})
    lines, shown = q.lines([1, 0])
    assert lines[2:4] == ["A. two", "B. aa x: one"] and shown == {2: 1, 3: 0}


def test_rendering(spark):
    states = ["\tgood day\n", {"from": " Ütte", "sizes": [2.5, None], "n": -7}, [{"z": True, "a": "b"}, "  end"], 0.5, None, False]
    df = spark.createDataFrame([(i, json.dumps(s, ensure_ascii=False)) for i, s in enumerate(states)], "i int, s string")
    got = [r[0] for r in df.select(X.render_state(F.col("s"))).collect()]
    assert got == ["good day", "from: Ütte\nsizes: [2.5, null]\nn: -7", '1. {"z": true, "a": "b"}\n2. end', "0.5", "null", "false"]


def test_clip(spark):
    df = spark.createDataFrame([("a  b\n c",), ("abcdefghij klm",), ("ab cd ef gh ij",)], "t string")
    got = [r[0] for r in df.select(X.clip_text(F.col("t"), 10)).collect()]
    assert got == ["a b c", "abcdefghij ...", "ab cd ef ..."]
    assert X.label_alphabet(28)[-3:] == ["Z", "AA", "AB"]


def write(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n")


def test_records(spark, tmp_path):
    room = {"type": "choice", "instructions": "Which room?", "criteria": {"attic": "under the roof", "hall": None, "cellar": None}}
    sound = {
        "room": room | {"label": "cellar"},
        "quiet": {"type": "noul", "instructions": "Quiet?", "label": "No", "src": "survey"},
        "light": {"type": "bool", "instructions": "Light?", "label": 1, "source": "visit"},
        "size": {"type": "score", "instructions": "How large?", "levels": ["small", "fair", "large", "vast"], "label": 1},
        "guess": room | {"label": "hall", "target": {"hall": 6, "attic": 2}, "answerable": False},
    }
    unsound = {
        "elsewhere": room | {"label": "garden"},
        "beyond": {"type": "score", "instructions": "How large?", "criteria": ["small", "large"], "label": 2},
        "lonely": {"type": "choice", "instructions": "Which?", "options": {"attic": None}, "label": "attic"},
        "blank": {"type": "bool", "instructions": "\t", "label": False},
        "nothing": room | {"label": "hall", "target": {"hall": 0.0}},
    }
    write(tmp_path / "r.jsonl", [{"state": "a flat", "questions": unsound}, "", "", {"state": {"street": "Ü 1", "area": 40}, "questions": sound, "meta": {"source": "ads"}}])
    rows = {r.name: r for r in R.read_records(spark, str(tmp_path / "r.jsonl")).collect()}
    assert {k: rows[k].label_index for k in sound} == {"room": 2, "quiet": 1, "light": 0, "size": 1, "guess": 1}
    assert rows["size"].target == [0, 1, 0, 0] and rows["guess"].target == [0.25, 0.75, 0] and not rows["guess"].answerable and rows["room"].answerable
    assert [rows[k].source for k in ("room", "quiet", "light", "blank")] == ["ads", "survey", "visit", "unknown"]
    assert rows["room"].line == 3 and rows["blank"].line == 0
    assert json.loads(rows["room"].state) == {"street": "Ü 1", "area": 40} and list(json.loads(rows["room"].state)) == ["street", "area"]
    assert json.loads(rows["blank"].state) == "a flat"
    assert all(rows[k].problem is None for k in sound) and all(rows[k].problem for k in unsound)
    assert R.read_records(spark, str(tmp_path / "r.jsonl"), limit=3).count() == len(unsound)


def test_line_numbers_go_on_across_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 4000), ("b.jsonl", 1), ("c.jsonl", 2500)):
        (tmp_path / name).write_text("\n".join("" if i % 7 == 3 else json.dumps(f"{name} {i} " + "é" * (i % 90)) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = R.lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 5
        rows = got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == sum(1 for n in (4000, 1, 2500) for i in range(n) if i % 7 != 3)
    assert all(json.loads(r.value).startswith(f"{r.file.rsplit('/', 1)[1]} {r.line} ") for r in rows)


def test_states(spark, tmp_path):
    write(tmp_path / "s.jsonl", ['"text"', {"k": 1}, {"state": "x", "expected": "out", "meta": {"id": "set/0"}}, "", {"state": {"b": 1, "a": 2}}])
    df = R.read_states(R.lines(spark, str(tmp_path / "s.jsonl")))
    rows = sorted(df.collect(), key=lambda r: r.line)
    assert [r.id for r in rows] == ["0", "1", "set/0", "4"]
    assert [r.state for r in rows] == ['"text"', '{"k": 1}', '"x"', '{"b":1,"a":2}'] and rows[2].expected == "out"
    assert R.read_states(R.lines(spark, str(tmp_path / "s.jsonl")), limit=2).count() == 2


def test_scored_and_answers(spark, tmp_path):
    row = [("i", [0.12345678, 0.87654322], [0.0, 1.0], 1, "bool", "s", True, 0.3333333333)]
    df = spark.createDataFrame(row, R.SCORED)
    R.write_scored(df, str(tmp_path / "p"))
    back = R.read_scored(spark, str(tmp_path / "p")).first()
    assert back.probs == [0.123457, 0.876543] and back.evidence == 0.333333
    keys = F.array(F.lit("0"), F.lit("1"))
    out = df.select(R.answer_json(F.lit("score"), keys, F.col("probs"), F.col("evidence"), F.array(F.lit('lo"w'), F.lit("high")))).first()[0]
    got = json.loads(out)
    assert got["score"] == 0.8765 and got["level"] == 1 and got["legend"] == {"0": 'lo"w', "1": "high"} and got["confidence"] == 0.7531
    meta = df.select(R.record_json(F.lit('{"a": 1}'), F.array(F.struct(F.lit('q"').alias("name"), F.lit('{"type": "bool"}').alias("json"))), F.lit("{}"))).first()[0]
    assert json.loads(meta) == {"state": {"a": 1}, "questions": {'q"': {"type": "bool"}}, "meta": {}}


def test_line_numbers_go_on_across_the_pieces_of_a_folder(spark, tmp_path):
    where = str(tmp_path / "pieces")
    spark.range(0, 3000).repartitionByRange(5, "id").sortWithinPartitions("id").select(F.concat(F.col("id").cast("string"), F.repeat(F.lit("é"), (F.col("id") % 60).cast("int"))).alias("value")).write.text(where)
    got = R.lines(spark, where, across=True).collect()
    assert len({r.file for r in got}) == 5 and len(got) == 3000
    assert all(r.value.startswith(str(r.line)) and r.value.rstrip("é") == str(r.line) for r in got)
