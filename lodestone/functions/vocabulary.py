"""Words and patterns that the operators look for. Patterns are valid for Java, RE2 and Python alike."""

from __future__ import annotations

#: Number-like pieces of text, by who looks for them.
OPEN, SIGN, CLOSE = r"\(?-?", r"[€£$]?", r"\)?"
NUMBER = OPEN + SIGN + r"[0-9][0-9,.]*" + CLOSE
GUARDED = r"[-($£€]?[0-9][0-9,.]*" + CLOSE
AMOUNT = r"(?:£\s*)?" + OPEN + r"[0-9]{1,3}(?:,[0-9]{3})*(?:[.][0-9]+)?" + CLOSE
COMPARED = SIGN + OPEN + r"[0-9]+(?:[.][0-9]+)?" + CLOSE
GROUPED = OPEN + SIGN + r"[0-9]{1,3}(?:[ ,][0-9]{3})*(?:[.][0-9]+)?" + CLOSE + "|" + OPEN + SIGN + r"[0-9]+" + CLOSE
YEAR = r"\b20[0-9]{2}(?:\s*[-/]\s*[0-9]{2})?\b"
#: A word of any script, with an apostrophe inside.
WORD = r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)?"


def _words(text: str) -> list[str]:
    return sorted(w.strip() for w in text.split("|"))


#: A query about the accounts holds one of these.
IN_SCOPE = _words(
    "assets|audit fees|balance|balance sheet|capex|cash|cash flow|charitable activities|cogs|cost|costs|creditors|debtors|dividends|donated services"
    "|donation|eps|equity|expenditure|expenses|free cash flow|guidance|headcount|income|income statement|interest|investment income|liabilities|loss"
    "|management fees|margin|market value|net assets|net gains on investments|net income|net loss on investments|net movement in funds"
    "|operating expenses|opex|profit|revenue|segment|spending|total expenditure|total expenses|unrestricted funds"
)
#: A query that asks for a number holds one of these.
NUMERIC = _words(
    "assets|audit|balance|capex|cash|cash flow|cogs|creditors|debtors|dividend|donated|donation|eps|equity|expenses|fees|free cash flow|funds|grants"
    "|guidance|income|interest|investment|liabilities|loss|margin|net assets|profit|revenue|segment"
)
#: Metrics in order of precedence, with the phrases they go by, the first to look for first.
METRICS = [
    tuple(m.split(": "))
    for m in (
        "total_expenditure: total expenditure|total expenses|expenditure total|total costs",
        "total_income_endowments: total income and endowments|total income",
        "investment_income: investment income|dividends|interest on cash",
        "donated_services: donated services",
        "management_fees: management fees|investment management costs fees|management fee",
        "charitable_activities: charitable activities|charitable grants|grants",
        "audit_fees: audit fees|auditor",
        "net_income: net income|net income expenditure|net income/(expenditure)|surplus|deficit",
        "net_gains: net gains on investments|net gain overall",
        "net_losses: net loss on investments|net losses on investments",
        "net_movement: net movement in funds",
        "net_assets: total net assets|net assets",
        "unrestricted_funds: unrestricted funds",
        "investments_year_end: market value at 31 march|market value at year end|market value at 31 march",
        "debtors: debtors",
        "creditors: creditors",
    )
]
SYNONYMS = {k: v.split("|") for k, v in METRICS}
#: Phrases that end what is said about the metric before.
LABELS = sorted({s for v in SYNONYMS.values() for s in v} | {"refunds received"})
#: Sections, by the first of these patterns that a line matches in any case.
SECTIONS = [
    ("statement_of_financial_activities", r"={5} STATEMENT OF FINANCIAL ACTIVITIES.*={5}"),
    ("balance_sheet", r"={5} BALANCE SHEET.*={5}"),
    ("notes", r"={5} NOTES TO THE FINANCIAL STATEMENTS.*={5}"),
    ("income_statement", r"income statement|statement of operations"),
    ("cash_flow", r"cash ?flow|statement of cash flows"),
    ("equity", r"equity"),
    ("management_discussion", r"management(?:'s)? discussion|md&a"),
]
STOP_WORDS = _words(
    "a|about|above|after|again|against|all|am|an|and|any|are|as|at|be|because|been|before|being|below|between|both|but|by|can|did|do|does|doing|don|down"
    "|during|each|few|for|from|further|had|has|have|having|he|her|here|hers|herself|him|himself|his|how|i|if|in|into|is|it|its|itself|just|me|more|most"
    "|my|myself|no|nor|not|now|of|off|on|once|only|or|other|our|ours|ourselves|out|over|own|s|same|she|should|so|some|such|t|than|that|the|their|theirs"
    "|them|themselves|then|there|these|they|this|those|through|to|too|under|until|up|very|was|we|were|what|when|where|which|while|who|whom|why|will|with|you|your|yours|yourself|yourselves"
)
