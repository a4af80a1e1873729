"""Portable SQL (Spark's and ANSI dialects alike) for tables that the test data lacks: money, reports, questions."""

from __future__ import annotations

from lodestone.functions import vocabulary as V

LABELS = [s[0] for s in V.SYNONYMS.values()]


def grouped(w: str) -> str:
    """A whole number with its thousands parted by a comma."""
    thousands = f"CAST(CAST(floor({w} / 1000) AS BIGINT) AS STRING)"
    return f"(CASE WHEN {w} >= 1000 THEN {thousands} || ',' || lpad(CAST({w} % 1000 AS STRING), 3, '0') ELSE CAST({w} AS STRING) END)"


_BASE = "SELECT c_custkey AS id, CAST(floor(abs(c_acctbal)) AS BIGINT) AS w, CAST(c_custkey % 90 + 10 AS STRING) AS cents, CAST(2015 + c_custkey % 12 AS STRING) AS y FROM customer"
_G = grouped("w")
_W = "CAST(w AS STRING)"

#: (id, line)
MONEY = f"""SELECT id, CASE id % 8
 WHEN 0 THEN 'Audit ' || {_W} WHEN 1 THEN '(' || {_G} || ')' WHEN 2 THEN '(£' || {_G} || ')' WHEN 3 THEN '-£' || {_G} || '.' || cents
 WHEN 4 THEN 'Investments ' || CAST(id % 9 AS STRING) || ' ' || {_G} WHEN 5 THEN y || '/23 was £' || {_G} || '.'
 WHEN 6 THEN '£-' || {_W} || ' and $' || {_G} || '.50 of ' || y ELSE 'Net  –' || {_W} || '  no. ' || CAST(id AS STRING) || ' (' || {_W} || '.00)' END AS line
FROM ({_BASE}) AS b"""

_NL = " || chr(10) || "


def _report() -> str:
    parts = [
        "'CHARITY ' || CAST(id AS STRING) || CASE WHEN id % 3 = 0 THEN '' ELSE ' YEAR ENDED 31 MARCH ' || y END",
        "'STATEMENT OF FINANCIAL ACTIVITIES'",
        f"'Donated services ' || {_G} || ' 900'",
        "'Income from Investments 3 499'",
        f"CASE WHEN id % 2 = 0 THEN 'Total  Expenditure (' || {_G} || ')' ELSE 'Net Income ' || {_W} END",
        f"'Net Movement in Funds (' || {_G} || ')'",
        "'BALANCE SHEET'",
        f"'Investments ' || {_G}",
        "CASE WHEN id % 5 = 0 THEN 'Debtors none' ELSE 'Debtors 7,553' END",
        "'Creditors (10)'",
        "'NOTES TO THE FINANCIAL STATEMENTS'",
        "'5 COSTS OF CHARITABLE ACTIVITIES'",
        f"'Grants of £40 made to 2 individuals ' || {_W}",
        f"'Total ' || {_G}",
        "'9 ANALYSIS OF CHARITABLE FUNDS'",
        f"'General Funds 20,886 ' || {_G}",
    ]
    return _NL.join(parts)


#: (id, name, text)
REPORTS = f"SELECT id, 'report_' || CASE WHEN id % 4 = 0 THEN 'x' ELSE y END || '.pdf' AS name, {_report()} AS text FROM ({_BASE}) AS b"


def _question(k: int) -> str:
    form = [f"What was the {LABELS[k]} in 2022/23?", f"How much were {LABELS[k]} for 2023?", f"Report the {LABELS[k]}", f"tell me about {LABELS[k]} in 2022-23 please"][k % 4]
    return f"({k}, '{form}')"


#: (q_id, question): one for each metric, and two that are none.
QUESTIONS = "SELECT * FROM (VALUES " + ", ".join([_question(k) for k in range(len(LABELS))] + [f"({len(LABELS)}, 'What is the weather like')", f"({len(LABELS) + 1}, 'Which audit took place in March')"]) + ") AS t(q_id, question)"
ASKED = len(LABELS) + 2

_LABEL = "CASE q_id " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in enumerate(LABELS)) + " ELSE 'audit' END"
#: (ask, q_id, rank, ctx): up to six contexts for each asking of a question.
CONTEXTS = f"""SELECT CAST(floor(id / {ASKED * 6}) AS BIGINT) AS ask, q_id, CAST(floor(id / {ASKED}) AS BIGINT) % 6 AS rank, CASE CAST(floor(id / 5) AS BIGINT) % 5
 WHEN 0 THEN upper(label) || ' £' || {_G} || ' 2022 23' WHEN 1 THEN label || ' in 2022 23 of which total ' || {_G} || '.50' || chr(10) || 'Debtors ' || {_W}
 WHEN 2 THEN 'Other' || chr(10) || label || chr(10) || '(' || {_G} || ')' WHEN 3 THEN 'Creditors ' || {_W} || ' ' || label || ' 2022 23 ' || {_G} || ' total income and endowments ' || {_W}
 ELSE 'nothing to see in ' || y END AS ctx
FROM (SELECT *, {_LABEL} AS label FROM (SELECT *, id % {ASKED} AS q_id FROM ({_BASE}) AS b) AS c) AS d"""
