"""Queries over narrow tables share their rows among tasks."""

from lodestone import queries


def test_fixture_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(queries, "ROWS", 20)
    for name in ("report_format", "sections", "corpus"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.rdd.getNumPartitions() == 8  # 150 rows
