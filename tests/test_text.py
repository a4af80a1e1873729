"""Goldens and odd cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions.models import encode
from lodestone.operators import answer as A
from lodestone.operators import prompts as P
from lodestone.operators import segment as S
from lodestone.sources.readers import ModelNotAvailable


def one(spark, fn, *values):
    cols = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{c} string" for c in cols))
    return df.select(fn(*[F.col(c) for c in cols]).alias("out")).first().out


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (X.norm_num, "-575", [575.0]),
        (X.norm_num, "(575)", [-575.0]),
        (X.norm_num, "£-575", [-575.0]),
        (X.norm_num, "-£575", [575.0]),
        (X.norm_num, "£(575)", [575.0]),
        (X.format_number, "12 758", "12,758"),
        (X.format_number, "(575)", "-575"),
        (X.format_number, "1,499.50", "1,499.5"),
        (X.format_number, "10.00", "10"),
        (X.format_number, "no number", "no number"),
        (X.guard_numbers, "(575)", ["-575"]),
        (X.guard_numbers, "-£575", ["575"]),
        (X.guard_numbers, "(-575)", ["-575)"]),
        (X.guard_numbers, "2022/23 was £1,499.", ["2022", "23", "1499."]),
        (X.numbers_excluding_years, "2022 23", ["202", "2", "23"]),
        (X.numbers_excluding_years, "1000", ["100", "0"]),
        (X.numbers_excluding_years, "12 758 7 553", ["12 758", "7 553"]),
        (X.parse_years, "2022-23", ["2022 23", "2022/23"]),
        (X.parse_years, "2005", ["2005"]),
        (X.parse_years, "2024", ["2024", "2023 24"]),
        (X.parse_years, "none", []),
        (X.first_amount, "Audit 1000", "£100"),
        (X.first_amount, "(851)", "-£851"),
        (X.first_amount, "(£851)", "£851"),
        (X.first_amount, "Investments 7 12,758", "£7"),
        (X.first_amount, "", None),
        (X.clean_text, "Head\n\n 12 \n\nPage 3 of 9 body\t\t x\n\n\nend ", "Head\n body x\nend"),
        (X.dedupe_phrase, "a b a b c c", "a b c"),
        (X.fold, "Ça — “naïve”", 'Ca - "naive"'),
        (X.norm_ws, None, ""),
        (X.tokenize, "It's £1,499 für", ["It's", "1", "499", "für"]),
    ],
)
def test_golden(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("fn", [X.clean_text, X.tokenize, X.currency_norm, X.first_amount, X.guard_numbers, X.format_number, X.parse_years, X.add_currency, X.norm_num])
def test_null_stays_null(spark, fn):
    assert one(spark, fn, None) is None


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "def", True), ("5", "0", False), ("2022", "x in 2022/23 was £9", True), ("0", "0", True), ("100", "101.9", True), ("100", "103", False)])
def test_numeric_close(spark, a, b, want):
    assert one(spark, X.numeric_close, a, b) is want


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, "s", "a b c d e"), (2, "s", ""), (3, "s", None)], "doc_id long, section string, text string")
    rows = S.chunks(df, (3,), 1).collect()
    assert sorted((r.start, r.text) for r in rows) == [(0, "a b c"), (2, "c d e"), (4, "e")]
    assert {r.chunk_size for r in rows} == {3} and {r.id for r in rows} == {"1:s:0", "1:s:2", "1:s:4"}


def test_sections_repeat_and_null(spark):
    text = "intro\nCash flow 1\na\nEquity\nb\ncashflow 2\nc"
    got = {(r.doc_id, r.section): r.text for r in S.sections(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert got == {(1, "general"): "intro", (1, "cash_flow"): "Cash flow 1\na\ncashflow 2\nc", (1, "equity"): "Equity\nb", (2, "general"): ""}


def test_metric_value_next_line_and_null(spark):
    df = spark.createDataFrame([("Report the audit fees", ["x", None, "Audit fees\n(1,234)"]), ("what is it", ["a 1"]), ("debtors?", [])], "q string, c array<string>")
    assert [r[0] for r in df.select(A.metric_value(F.col("q"), F.col("c"))).collect()] == ["-1,234", None, None]


def test_pack_stops_at_first_overflow(spark):
    df = spark.createDataFrame([(["a b", "c d e f g", "h"],)], "c array<string>")
    assert df.select(P.pack(F.col("c"), F.lit(1), 5)).first()[0] == ["a b"]
    assert df.select(P.pack(F.col("c"), F.lit(1), 9)).first()[0] == ["a b", "c d e f g", "h"]
    assert df.select(P.pack(F.col("c"), F.lit(1), 2)).first()[0] == []


def test_label_mask_pads_and_cuts(spark):
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3, 4, 5],), ([],)], "i array<int>")
    got = [r[0] for r in df.select(P.label_mask(F.col("i"), 4, 9)).collect()]
    assert [g.labels for g in got] == [[1, 2, -100, -100], [1, 2, 3, 4], [-100] * 4]
    assert got[0].input_ids == [1, 2, 9, 9] and got[0].attention_mask == [1, 1, 0, 0]


def test_hooks_say_what_is_missing(spark):
    with pytest.raises(ModelNotAvailable):
        encode(F.lit("x"))
    df = spark.createDataFrame([("ab",), ("c",)], "t string")
    assert sorted(r[0] for r in df.select(encode(F.col("t"), lambda: lambda texts: [[float(len(t))] for t in texts])).collect()) == [[1.0], [2.0]]
