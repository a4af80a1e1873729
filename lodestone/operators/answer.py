"""Guards, extraction of labelled values, and the rules that turn them into an answer. All within a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocabulary as V
from lodestone.functions.text import let

TAIL = "total income and endowments"
OUT_OF_SCOPE = "Query appears out of scope"
SOFT_REASON = OUT_OF_SCOPE + " based on keywords; answer provided" + " with low confidence."


def _words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _has_any(text: Column, words: list[str]) -> Column:
    return F.exists(_words(words), lambda w: F.contains(F.lower(text), w))


def in_scope(query: Column) -> Column:
    return _has_any(query, V.IN_SCOPE)


def numeric_intent(query: Column) -> Column:
    return _has_any(query, V.NUMERIC)


def unsupported_numbers(answer: Column, contexts: Column) -> Column:
    """The answer's numbers that no context has."""
    return let(X.guard_numbers(F.array_join(contexts, " ")), lambda known: F.filter(X.guard_numbers(answer), lambda n: ~F.array_contains(known, n)))


def numeric_guard(answer: Column, contexts: Column) -> Column:
    """(flag, reason)"""
    missing = unsupported_numbers(answer, contexts)
    listed = F.concat(F.lit("['"), F.array_join(missing, "', '"), F.lit("']"))
    reason = F.concat(F.lit("Numbers "), listed, F.lit(" not found in retrieved context." + " Low confidence."))
    flag = F.coalesce(F.size(missing) > 0, F.lit(False))
    return F.struct(flag.alias("flag"), F.when(flag, reason).otherwise("").alias("reason"))


def detect_metric(query: Column) -> Column:
    """The metric with most of its phrases in the query; the first of equals; null for none."""
    q = F.lower(query)
    hits = [F.struct(sum((F.contains(q, F.lit(s)).cast("int") for s in syns), F.lit(0)).alias("hits"), F.lit(-k).alias("at"), F.lit(name).alias("key")) for k, (name, syns) in enumerate(V.SYNONYMS.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["hits"] > 0, best["key"])


def phrases(metric: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, syns in V.SYNONYMS.items():
        out = F.when(metric == name, _words(syns)).otherwise(out)
    return out


def _first_number(text: Column) -> Column:
    return X.format_number(F.get(X.numbers_excluding_years(text), F.lit(0)))


def _segment_value(segment: Column, metric: Column) -> Column:
    low = F.lower(segment)
    other = F.contains(low, F.lit(TAIL)) & (metric != "total_income_endowments")
    before = F.when(other, _first_number(segment.substr(F.lit(1), F.instr(low, TAIL) - 1)))
    total = F.when(F.contains(low, F.lit("total")), _first_number(segment.substr(F.instr(low, "total"), F.lit(1 << 30))))
    return F.coalesce(before, total, _first_number(segment))


def _cut_at_label(segment: Column) -> Column:
    at = F.array_min(F.filter(F.transform(_words(V.LABELS), lambda t: F.position(t, F.lower(segment))), lambda p: p > 0))
    return F.when(at > 1, segment.substr(F.lit(1), at - 1)).otherwise(segment)


def line_value(line: Column, metric: Column, labels: Column, years: Column) -> Column:
    """The metric's number on one line, or null."""

    def behind(label: Column) -> Column:
        return let(line.substr(F.position(label, F.lower(line)) + F.length(label), F.lit(1 << 30)), lambda s: let(_cut_at_label(s), lambda cut: _segment_value(cut, metric)))

    label = F.get(F.filter(labels, lambda s: F.contains(F.lower(line), s)), F.lit(0))
    dated = (F.size(years) == 0) | F.exists(years, lambda y: F.contains(F.lower(line), F.replace(y, F.lit("/"), F.lit(" "))))
    return F.when(label.isNotNull() & dated, let(label, behind))


def metric_value(query: Column, contexts: Column) -> Column:
    """The value of the metric that a query asks for, from the first line that has one; null without a metric or a value."""
    texts = F.filter(contexts, lambda c: c.isNotNull())
    lines = lambda c: F.split(c, "\n")

    def found(metric: Column, labels: Column, years: Column) -> Column:
        same = F.filter(F.transform(F.flatten(F.transform(texts, lines)), lambda x: line_value(x, metric, labels, years)), lambda v: v.isNotNull())
        labelled = lambda x: F.exists(labels, lambda s: F.contains(F.lower(x), s))
        below = lambda c: F.transform(lines(c), lambda x, i: F.when(labelled(x), _first_number(F.get(lines(c), i + 1))))
        after = F.filter(F.flatten(F.transform(texts, below)), lambda v: v.isNotNull())
        return F.coalesce(F.get(same, F.lit(0)), F.get(after, F.lit(0)))

    value = let(detect_metric(query), lambda m: let(phrases(m), lambda p: let(X.parse_years(query), lambda y: found(m, p, y))))
    return F.when(detect_metric(query).isNotNull(), value)


def number_fallback(query: Column, contexts: Column) -> Column:
    """The first number of the line with most of the query's longer words; else the first number anywhere."""
    texts = F.filter(contexts, lambda c: c.isNotNull())
    keys = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-zA-Z]+"), F.lit(0)), lambda w: F.length(w) >= 4)

    def best(words: Column) -> Column:
        lines = F.flatten(F.transform(texts, lambda c: F.split(c, "\n")))
        rated = F.transform(lines, lambda x, i: F.struct(F.size(F.filter(words, lambda w: F.contains(F.lower(x), w))).alias("score"), (-i).alias("at"), X.first_number(x).alias("number")))
        return F.array_max(F.filter(rated, lambda r: (r["score"] > 0) & r["number"].isNotNull()))["number"]

    return F.coalesce(let(keys, best), X.first_number(F.array_join(texts, "\n")))


def answer_policy(query: Column, generated: Column, contexts: Column) -> Column:
    """(answer, confidence, guardrail) for a query from what a model generated (null for nothing) and its contexts.

    Extraction overrides the model where its numbers aren't in the contexts or it has none, and for total
    expenditure; otherwise it replaces the wording. Out of scope lowers the confidence.
    """
    said = F.coalesce(generated, F.lit(""))

    def decide(guard: Column, precise: Column, loose: Column) -> Column:
        start = F.when(guard["flag"], 0.5).otherwise(0.9)
        forced = (detect_metric(query) == "total_expenditure") & precise.isNotNull()
        forced = F.coalesce(forced, F.lit(False))
        answer = F.when(forced, X.add_currency(precise)).otherwise(said)
        sure = F.when(forced, 0.98).otherwise(start)
        doubtful = guard["flag"] | X.first_number(answer).isNull()
        numeric = numeric_intent(query)
        out = (
            F.when(numeric & precise.isNotNull(), X.add_currency(precise))
            .when(numeric & doubtful & loose.isNotNull(), X.add_currency(loose))
            .otherwise(answer)
        )
        conf = (
            F.when(numeric & doubtful & precise.isNotNull(), 0.98)
            .when(numeric & doubtful & loose.isNotNull(), 0.95)
            .when(numeric & ~doubtful & precise.isNotNull(), F.greatest(sure, F.lit(0.95)))
            .otherwise(sure)
        )
        scope = in_scope(query)
        soft = F.struct(F.lit(True).alias("flag"), F.lit(SOFT_REASON).alias("reason"))
        return F.struct(out.alias("answer"), F.when(scope, conf).otherwise(F.least(conf, F.lit(0.35))).alias("confidence"), F.when(scope, guard).otherwise(soft).alias("guardrail"))

    return let(numeric_guard(said, contexts), lambda g: let(metric_value(query, contexts), lambda p: let(number_fallback(query, contexts), lambda n: decide(g, p, n))))


def rejected(query: Column) -> Column:
    """The answer of the hard guard to a query out of scope; null for others."""
    return F.when(~in_scope(query), "Out of scope: " + OUT_OF_SCOPE + " for financial statements.")


def ft_policy(query: Column, generated: Column, contexts: Column, generated_confidence: Column) -> Column:
    """(answer, confidence): an extracted value, else the first number of what was generated, else that itself."""
    tail = X.after_marker(generated, ("Answer (number only):", "Answer:"))
    number = X.first_number(tail)

    def decide(precise: Column) -> Column:
        loose = F.when(number.isNotNull(), X.add_currency(number)).otherwise(tail)
        answer = F.when(precise.isNotNull(), X.add_currency(precise)).otherwise(loose)
        return F.struct(answer.alias("answer"), F.when(precise.isNotNull(), 0.98).otherwise(F.coalesce(generated_confidence, F.lit(0.5))).alias("confidence"))

    return let(metric_value(query, contexts), decide)


def ui_override(answer: Column, extracted: Column) -> Column:
    """The extracted value instead of an answer that is missing, long or without currency."""
    poor = answer.isNull() | (F.length(answer) > 16) | ~answer.rlike("[£$€]")
    return F.when(extracted.isNotNull() & poor, X.add_currency(extracted)).otherwise(answer)


def sequence_confidence(logits: Column, chosen: Column) -> Column:
    """Mean softmax probability of the chosen entries (from 0) of an array of logit arrays; 0.5 for none."""

    def p(row: Column, at: Column) -> Column:
        top = F.array_max(row)
        total = F.aggregate(F.transform(row, lambda z: F.exp(z - top)), F.lit(0.0), lambda a, z: a + z)
        return F.exp(F.get(row, at) - top) / total

    each = F.zip_with(logits, chosen, p)
    return F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda a, z: a + z) / F.size(each)).otherwise(0.5)


def first_context_number(contexts: Column) -> Column:
    """The first plain number of the contexts, without commas."""
    found = F.flatten(F.transform(contexts, lambda c: F.regexp_extract_all(c, F.lit(r"\b[0-9][0-9,.]*\b"), F.lit(0))))
    return F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")).try_cast("double")
