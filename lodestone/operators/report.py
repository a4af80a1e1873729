"""Reports: labelled amounts, parsing into a struct and rendering it as text. All within a row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocabulary as V
from lodestone.functions.text import let
from lodestone.operators.segment import slice_section

#: What to look for, what to call it, and whether its sign is dropped.
SOFA = [tuple(x.split(" > ")) for x in (
    "Donated services > Donated services > keep",
    "Income from Investments > Investment income > keep",
    "Refunds received > Refunds received > keep",
    "Total Income and Endowments > Total Income and Endowments > keep",
    "Management Fees > Management Fees > drop",
    "Charitable Activities > Charitable Activities > drop",
    "Audit Fees > Audit Fees > drop",
    "Total Expenditure > Total Expenditure > drop",
    "Net Income (Expenditure) > Net Income (Expenditure) > keep",
    "Net Income > Net Income > keep",
    "Net (Losses) Gains on Investments > Net (Losses) Gains on Investments > keep",
    "Net Movement in Funds > Net Movement in Funds > keep",
    "Total Funds carried forward > Total Funds carried forward > keep",
)]
BALANCE = [tuple(x.split(" > ")) for x in (
    "Investments > Investments > keep",
    "Debtors > Debtors > keep",
    "Creditors > Creditors > drop",
    "Total Net Assets > Total Net Assets > keep",
    "Unrestricted funds > Unrestricted Funds > keep",
)]
INCOME = [tuple(x.split(" > ")) for x in ("Dividends - equities > Dividends > keep", "Interest on cash deposits > Interest on cash deposits > keep", "Total > Total > keep")]
FEES = [("Investment and ELC management fees", "Fees", "keep")]
NOTES = "NOTES TO THE FINANCIAL STATEMENTS"


def label_pattern(label: str) -> str:
    """The label as whole words, any blanks between them. A label that ends in a sign is only whole before a letter."""
    return r"(?i)\b" + r"\s+".join(re.escape(w) for w in label.split(" ")) + r"\b"


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), X._strip), lambda x: x != "")


def labelled(lines_: Column, label: str, positive: bool) -> Column:
    """The first amount of the first line that has the label and an amount."""
    amounts = F.transform(F.filter(lines_, lambda x: x.rlike(label_pattern(label))), lambda x: X.first_amount(x, positive))
    return F.get(F.filter(amounts, lambda a: a.isNotNull()), F.lit(0))


def extract_labels(lines_: Column, specs: list[tuple[str, str, str]]) -> dict[str, Column]:
    """The amounts that the labels have in the lines of a section, by name."""
    return {name: labelled(lines_, search, sign == "drop") for search, name, sign in specs}


def grant_lines(lines_: Column) -> Column:
    """The lines on grants, with every amount replaced by the line's first."""
    amount = lambda x: X.first_amount(x, True)
    put = lambda x: F.array_join(F.split(x, V.AMOUNT, -1), "\x00")
    return F.transform(F.filter(lines_, lambda x: x.rlike(r"(?i)\bGrants?\b")), lambda x: F.coalesce(F.replace(put(x), F.lit("\x00"), amount(x)), x))


def grants_total(lines_: Column) -> Column:
    totals = F.filter(lines_, lambda x: x.rlike("(?i)^total") & ~x.rlike(r"(?i)\bGrants?\b"))
    return F.try_element_at(F.filter(F.transform(totals, lambda x: X.first_amount(x, True)), lambda a: a.isNotNull()), F.lit(-1))


MOVEMENT = ["Market Value at 1 April", "Profits from Sales", "Net loss on revaluations", "Net Gain overall", "Management Fees deducted", "Market Value at 31 March"]


def movement_kind(line: Column) -> Column:
    """Which row of the movement of investments a line is."""

    def kind(low: Column) -> Column:
        has = lambda *w: sum((F.contains(low, F.lit(x)).cast("int") for x in w), F.lit(0)) == len(w)
        return (
            F.when(has("market value at 1 april"), 0).when(has("profits", "sales"), 1).when(has("fair value") | has("revaluations", "net"), 2)
            .when(has("gains", "investments"), 3).when(has("management fees deducted"), 4).when(has("market value at 31 march"), 5)
        )

    return let(F.lower(line), kind)


def movement(lines_: Column, kinds: Column) -> dict[str, Column]:
    """The amounts of the rows of the movement of investments, by name; kinds are the lines' movement_kind()."""

    def row(k: int, positive: bool) -> Column:
        return X.first_amount(F.try_element_at(F.filter(lines_, lambda x, i: F.get(kinds, i) == k), F.lit(-1)), positive)

    return {name: row(k, k in (0, 1, 5)) for k, name in enumerate(MOVEMENT)}


def first_line_amount(lines_: Column, pattern: str, last: bool = False) -> Column:
    line = F.get(F.filter(lines_, lambda x: x.rlike(pattern)), F.lit(0))
    return X.last_amount(line, True) if last else X.first_amount(line, True)


def parse(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct `parsed` of the statement, the balance sheet and the notes, all nullable."""
    # each step reads columns of the step before, as what stands in one expression twice is worked out twice
    df = docs.withColumn("__text", X.norm_ws(F.col(text_col)))
    df = df.withColumn("__notes", slice_section(F.col("__text"), NOTES, []))

    def note(title: str, n: int, *ends: int) -> Column:
        return slice_section(F.col("__notes"), rf"\n{n}\s+{title}", [rf"\n{e}\s" for e in ends])

    parts = {
        "sofa": slice_section(F.col("__text"), "STATEMENT OF FINANCIAL ACTIVITIES", [r"\nBALANCE SHEET", rf"\n{NOTES}"]),
        "balance": slice_section(F.col("__text"), r"\nBALANCE SHEET", [rf"\n{NOTES}", r"\n1\s+ACCOUNTING POLICIES"]),
        "income": note("INVESTMENT INCOME", 3, 4, 5),
        "costs": note("INVESTMENT MANAGEMENT COSTS", 4, 5, 6),
        "charity": note("COSTS OF CHARITABLE ACTIVITIES", 5, 6, 7),
        "movement": note("INVESTMENTS", 7, 8, 9),
        "debtors": note("DEBTORS", 8, 9, 10),
        "funds": note("ANALYSIS OF CHARITABLE FUNDS", 9, 10),
    }
    df = df.withColumns({f"__{k}": lines(v) for k, v in parts.items()})
    df = df.withColumn("__kinds", F.transform("__movement", movement_kind))
    at = {k: F.col(f"__{k}") for k in parts}
    found = {
        "sofa": extract_labels(at["sofa"], SOFA),
        "balance": extract_labels(at["balance"], BALANCE),
        "income": extract_labels(at["income"], INCOME),
        "costs": extract_labels(at["costs"], FEES),
        "charity": {"lines": grant_lines(at["charity"]), "total": grants_total(at["charity"])},
        "movement": movement(at["movement"], F.col("__kinds")),
        "": {
            "other_debtors": first_line_amount(at["debtors"], r"(?i)\bOther Debtors\b"),
            "closing_balance": first_line_amount(at["funds"], r"(?i)\bGeneral Funds\b", True),
        },
    }
    flat = {(k, name): f"__{k}_{n}" for k, v in found.items() for n, name in enumerate(v)}
    df = df.withColumns({c: found[k][name] for (k, name), c in flat.items()})
    fields = {k: [F.col(flat[k, name]).alias(name) for name in v] for k, v in found.items()}
    parsed = F.struct(*[F.struct(*v).alias(k) for k, v in fields.items() if k], *fields[""])
    return df.withColumn("parsed", parsed).select(*[F.col(c) for c in docs.columns], "parsed")


def render(parsed: Column, period: Column, date: Column) -> Column:
    """The report as text; what is null has no line."""

    def row(value: Column, label: str | Column, lead: str = "") -> Column:
        name = F.lit(label) if isinstance(label, str) else label
        return F.concat(F.lit(lead), name, F.lit(": "), value)

    def head(title: str, what: Column) -> Column:
        return F.concat(F.lit(f"{'=' * 5} {title} ("), what, F.lit(f") {'=' * 5}"))

    def part(title: str, *rows: Column) -> Column:
        some = F.coalesce(*rows).isNotNull()
        return F.when(some, F.concat_ws("\n", F.lit(title + ":"), *rows, F.lit("")))

    s, b, i, m = parsed["sofa"], parsed["balance"], parsed["income"], parsed["movement"]
    plain = lambda t, names: [row(t[n], n) for n in names]
    by_sign = lambda v, minus, plus: row(v, F.when(v.startswith("-"), minus).otherwise(plus))
    net = F.coalesce(row(s["Net Income (Expenditure)"], "Net Income (Expenditure)"), row(s["Net Income"], "Net Income"))
    gains = s["Net (Losses) Gains on Investments"]
    charity = parsed["charity"]
    grants = F.when(F.size(charity["lines"]) > 0, F.array_join(F.transform(charity["lines"], lambda x: F.concat(F.lit("  - "), x)), "\n"))
    overall = m["Net Gain overall"]
    moved = [
        F.concat(F.lit("  - "), F.when(overall.startswith("-"), "Net Loss overall").otherwise(n), F.lit(": "), m[n]) if n == "Net Gain overall" else row(m[n], n, "  - ")
        for n in MOVEMENT
    ]
    text = F.concat_ws(
        "\n",
        head("STATEMENT OF FINANCIAL ACTIVITIES", period),
        *plain(s, ["Donated services", "Investment income", "Refunds received", "Total Income and Endowments"]),
        F.lit(""),
        *plain(s, ["Management Fees", "Charitable Activities", "Audit Fees", "Total Expenditure"]),
        F.lit(""),
        net,
        by_sign(gains, "Net Loss on Investments", "Net Gains on Investments"),
        *plain(s, ["Net Movement in Funds", "Total Funds carried forward"]),
        F.lit(""),
        head("BALANCE SHEET", F.concat(F.lit("As at "), date)),
        *plain(b, ["Investments", "Debtors", "Creditors", "Total Net Assets", "Unrestricted Funds"]),
        F.lit(""),
        head(NOTES, period),
        part("Investment Income", row(i["Dividends"], "Dividends (equities)", "  - "), row(i["Interest on cash deposits"], "Interest on cash deposits", "  - "), row(i["Total"], "Total", "  - ")),
        part("Investment Management Costs", row(parsed["costs"]["Fees"], "Fees", "  - ")),
        part("Costs of Charitable Activities", grants, row(charity["total"], "Total", "  - ")),
        part("Investments – Movement in Market Value", *moved),
        part("Debtors", row(parsed["other_debtors"], "Other Debtors", "  - ")),
        part("Analysis of Charitable Funds", row(parsed["closing_balance"], "Closing Balance", "  - ")),
    )
    return F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n"))


def reports(docs: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """docs with year, period, date, parsed, rendered and out_name."""
    df = parse(docs, text_col)
    df = df.withColumn("year", X.infer_year(F.col(text_col), F.col(name_col))).withColumn("__when", X.period_of(F.col("year")))
    df = df.withColumn("rendered", render(F.col("parsed"), F.col("__when.period"), F.col("__when.date")))
    return df.select("*", F.col("__when.period").alias("period"), F.col("__when.date").alias("date"), X.output_name(F.col(name_col)).alias("out_name")).drop("__when")
