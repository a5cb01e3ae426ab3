"""The terminal model of broken answers counts every answer, not a sample."""

from __future__ import annotations

from loomsift.llm import defects

SCHEMA = "table_name string, line_no bigint, field_name string, question string, extra string, answer string"
#: Stems that only one answer among thousands shows inside a word.
STEMS = ["quorv", "blimp", "dwalk", "frunt", "glosk", "hweld", "jimst", "klarn", "mopht", "nurdg", "plisk", "skwon", "truzz", "vlemp", "wrikt", "zhond"]


def _rows():
    """Whole answers, 16 of which show a stem inside words, and lists that end with such a stem."""
    rows = [("a", n, "output", "q", None, "It is so.") for n in range(9000)]
    rows += [("a", 10_000 + n, "output", "q", None, " ".join([f"So {x}ate, {x}ated, {x}ating."] * 5)) for n, x in enumerate(STEMS)]
    return rows + [("a", 20_000 + n, "output", "q", None, "Steps:\n- one thing\n- " + x) for n, x in enumerate(STEMS)]


def test_evidence_in_any_answer_counts(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.line_no, r.defect) for r in defects.defects(df).collect()}
    assert got == {(20_000 + n, "truncated") for n in range(len(STEMS))}
    model = defects.Endings(r[5] for r in rows if r[5].endswith("."))
    assert got == {(r.line_no, r.defect) for r in defects.defects(df, model).collect()}


def test_counts_handed_on_early_add_up(spark, monkeypatch):
    rows = [("a", n, "output", "q", None, "So quorvate.") for n in range(13)] + [("a", 20, "output", "q", None, "Steps:\n- a\n- quorv"), ("a", 21, "output", "q", None, "Steps:\n- a\n- so quorvate")]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    assert [r.line_no for r in defects.defects(df).collect()] == [20]
    monkeypatch.setattr(defects, "COUNTED_AT_ONCE", 10)
    parts = list(defects._read(iter(df.toArrow().to_batches())))
    assert sum(1 for p in parts if p.column("trigram").null_count < p.num_rows) == 13
    assert sum(n or 0 for p in parts for t, n in zip(p.column("trigram").to_pylist(), p.column("inner").to_pylist(), strict=True) if t == "orv") == 13


def test_runs_of_ideographs_are_no_words():
    model = defects.Endings(["数据处理完成。"] * 50)
    assert not model.cut("Spark数据处") and not model.cut("数据处")
