"""Reading folders and keeping indices."""

from pyspark.sql import functions as F

from lodestone.operators import report as R
from lodestone.operators import segment as S
from lodestone.sources import readers, writers


def test_read_dir(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"Page 1 of 2 caf\xc3\xa9 \xff!")
    (tmp_path / "b.HTML").write_text("<html><b>Bold</b> &amp; plain<!-- no --></html>")
    (tmp_path / "c.csv").write_text('x,y\n1,"2,5"\n')
    (tmp_path / "d.bin").write_text("no")
    got = {r.doc_id: r.text for r in readers.read_dir(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"] == "Page 1 of 2 café !" and got["b"] == "Bold\n & plain" and got["c"] == "x y\n1 2,5"


def test_read_pdf_hook(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    rows = readers.read_pdf(spark, str(tmp_path), lambda b: b.decode() + "\r–").collect()
    assert [(r.doc_id, r.text) for r in rows] == [("p", "%PDF\n-")]


def test_read_qa(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Question,ANSWER\n"a, b",c\nd,\n')
    assert [tuple(r) for r in readers.read_qa(spark, str(tmp_path / "q.csv")).collect()] == [("a, b", "c")]


def test_index_is_kept(spark, tmp_path):
    path, built = str(tmp_path / "index"), []
    docs = spark.createDataFrame([(1, "general", "a b a"), (2, "general", "b c")], "doc_id long, section string, text string")

    def build():
        built.append(1)
        return S.chunks(docs, (100,))

    assert readers.read_index(spark, path) is None
    for _ in range(2):
        found = readers.cached_index(spark, path, build)
        assert found["stats"].first().n == 2 and found["postings"].where("term = 'a'").first().tf == 2
    assert built == [1]


def test_reports_skip_years(spark, tmp_path):
    docs = spark.createDataFrame([("r_2022.pdf", "x"), ("r_2023.pdf", "x"), ("r.pdf", "x")], "name string, text string")
    writers.write_reports(R.reports(docs), str(tmp_path / "r"))
    kept = spark.read.text(str(tmp_path / "r")).select("out_name").distinct().collect()
    assert {r.out_name for r in kept} == {"report_2022.txt", "report_unknown.txt"}
    writers.write_results(docs, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


REPORT = """ACME YEAR ENDED 31 MARCH 2022
STATEMENT OF FINANCIAL ACTIVITIES
Donated services 1,000 900
Total Expenditure (1,223)
Net (Losses) Gains on Investments (851)
BALANCE SHEET
Creditors (10)
NOTES TO THE FINANCIAL STATEMENTS
5 COSTS OF CHARITABLE ACTIVITIES
Grants of £40 made to 2 people 80
Total 80
7 INVESTMENTS
Market value at 1 April 9,000
Gains on investments (12)
9 ANALYSIS OF CHARITABLE FUNDS
General Funds 20,886 20,311"""


def test_report_text(spark):
    df = spark.createDataFrame([("a.pdf", REPORT), ("b.pdf", None)], "name string, text string")
    r = R.reports(df).orderBy("name").collect()
    assert r[0].year == 2022 and r[0].period == "2021/22"
    lines = r[0].rendered.split("\n")
    for x in ("Total Expenditure: £1,223", "Net Loss on Investments: -£851", "Creditors: £10", "  - Grants of £40 made to £40 people £40", "  - Total: £80", "  - Market Value at 1 April: £1", "  - Net Loss overall: -£12", "  - Closing Balance: £20,311"):
        assert x in lines
    assert r[1].rendered.startswith("=====") and r[1].period == "Unknown"
    assert df.select(F.count("*")).first()[0] == 2


def test_report_steps_work_nothing_out_twice(spark):
    df = spark.createDataFrame([("a.pdf", REPORT)], "name string, text string").withColumn("text", F.concat("text", F.lit("\n")))
    plan = R.reports(df).select("rendered")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") < 100 and plan.count("regexp_replace(") < 60 and plan.count("regexp_instr(") < 30


def test_movement_of_investments(spark):
    text = "NOTES TO THE FINANCIAL STATEMENTS\n7 INVESTMENTS\nMarket value at 1 April 9,000\nFair value (12)\nNet revaluations 13\nGains on investments 4\nMarket value at 31 March (31)\n8 DEBTORS\nOther Debtors 5\n"
    p = R.parse(spark.createDataFrame([(text,), ("x",), (None,)], "text string")).collect()
    assert [x.parsed.other_debtors for x in p] == ["£5", None, None]
    assert p[0].parsed.movement["Net loss on revaluations"] == "£13" and p[0].parsed.movement["Net Gain overall"] == "£4" and p[0].parsed.movement["Profits from Sales"] is None
    assert all(v is None for x in p[1:] for v in [*x.parsed.movement, *x.parsed.sofa, x.parsed.closing_balance])


def test_results_are_written_by_several_tasks(spark, tmp_path):
    rows = [(k, f"said {k}, or \"{k}\"") for k in range(3000)]
    df = spark.createDataFrame(rows, "query_id long, answer string").repartition(4)
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8k")
    try:
        writers.write_results(df, str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "r").glob("*.csv"))) > 1
    back = spark.read.csv(str(tmp_path / "r"), header=True, schema=df.schema, quote='"', escape="\\")
    assert sorted(map(tuple, back.collect())) == rows
