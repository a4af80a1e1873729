"""Scalar functions over text columns: normalisation, numbers, years, templates. Null in, null out, unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def fold(c: Column) -> Column:
    """Latin letters without their marks, and plain quotes and dashes."""
    marked = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ‘’“”–—− "
    plain = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY''\"\"--- "
    out = F.translate(c, marked, plain)
    for a, b in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("£", "PS"), ("€", "EUR"), ("…", "...")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_text(c: Column, folded: bool = False) -> Column:
    """Text without page numbers, lines of a number alone, runs of blanks and empty lines."""
    c = fold(c) if folded else c
    c = F.regexp_replace(c, r"(?i)\bPage\s+[0-9]+(?:\s+of\s+[0-9]+)?\b", " ")
    c = F.regexp_replace(c, r"\n\s*[0-9]+\s*\n", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{2,}", "\n")
    return _strip(c)


def strip_html(c: Column) -> Column:
    """The text between tags, a line each, cleaned."""
    c = F.regexp_replace(c, r"(?is)<!--.*?-->", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", "\n")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return clean_text(c)


def tokenize(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.WORD), F.lit(0))


def preprocess_query(c: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-case words that aren't stop words, joined by a blank."""
    stop = F.array(*[F.lit(w) for w in (V.STOP_WORDS if stop_words is None else stop_words)]).cast("array<string>")
    return F.array_join(F.filter(tokenize(F.lower(c)), lambda t: ~F.array_contains(stop, t)), " ")


def ws_tokenize(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def norm_ws(c: Column) -> Column:
    """Line feeds, plain dashes and single blanks; null becomes empty."""
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), "\r–—−", "\n---"), r"[ \t]+", " ")


def currency_norm(c: Column, force_positive: bool = False) -> Column:
    """£ and the digits, with - in front for a leading minus or parentheses; null where nothing is left."""


    def signed(x: Column, kept: Column) -> Column:
        bracketed = F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
        minus = kept.startswith("-")
        sign = F.lit("£") if force_positive else F.when(bracketed | minus, "-£").otherwise("£")
        return F.when(~kept.isin("", "-"), F.concat(sign, F.when(minus, F.substring(kept, 2, 1 << 30)).otherwise(kept)))

    return let(c, lambda x: let(F.regexp_replace(x, r"[^0-9,.\-]", ""), lambda kept: signed(x, kept)))


def amounts(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(V.AMOUNT), F.lit(0))


def first_amount(c: Column, force_positive: bool = False) -> Column:
    return currency_norm(F.regexp_extract(c, V.AMOUNT, 0), force_positive)


def last_amount(c: Column, force_positive: bool = False) -> Column:
    return currency_norm(F.try_element_at(amounts(c), F.lit(-1)), force_positive)


def guard_numbers(c: Column) -> Column:
    """The numbers of a text, without currency and commas; parentheses become a minus. A full stop behind stays."""
    found = F.transform(F.regexp_extract_all(c, F.lit(V.GUARDED), F.lit(0)), lambda x: F.regexp_replace(x, "[,$£€]", ""))
    return F.transform(found, lambda x: F.when(x.startswith("(") & x.endswith(")"), F.concat(F.lit("-"), F.substring(x, 2, 1 << 20).substr(F.lit(1), F.length(x) - 2))).otherwise(x))


def first_number(c: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(V.NUMBER), F.lit(0)), F.lit(1))


def format_number(c: Column) -> Column:
    """Thousands parted by commas, at most two decimals without zeros behind; what is no number stays as it is."""
    raw = F.regexp_replace(c, "[, £$€]", "")
    bracketed = raw.startswith("(") & raw.endswith(")")
    raw = F.when(bracketed, F.substring(raw, 2, 1 << 20).substr(F.lit(1), F.length(raw) - 2)).otherwise(raw)
    minus = raw.startswith("-")
    raw = F.when(minus, F.substring(raw, 2, 1 << 20)).otherwise(raw)
    sign = F.when(bracketed | minus, -1).otherwise(1)
    decimal = F.when(raw.rlike(r"^[0-9]*[.]?[0-9]+$|^[0-9]+[.]$"), raw.try_cast("double")) * sign
    whole = F.when(raw.rlike("^[0-9]+$"), raw.try_cast("bigint")) * sign
    two = F.regexp_replace(F.regexp_replace(F.format_number(decimal, 2), "0+$", ""), "[.]$", "")
    return F.coalesce(F.when(F.contains(raw, F.lit(".")), two).otherwise(F.format_number(whole, 0)), c)


def numbers_excluding_years(c: Column) -> Column:
    """Grouped numbers without those that hold a year; long plain ones fall apart into groups of three digits."""
    found = F.regexp_extract_all(c, F.lit(V.GROUPED), F.lit(0))
    return F.filter(found, lambda x: ~F.replace(x, F.lit(","), F.lit(" ")).rlike(V.YEAR))


def parse_years(c: Column) -> Column:
    """The fiscal years that a query names, each in the ways it may be written."""
    pair = r"(20[0-9]{2})\s*[/\- ]\s*([0-9]{2})"
    a, b = F.regexp_extract(c, pair, 1), F.regexp_extract(c, pair, 2)
    y = F.regexp_extract(c, "20[0-9]{2}", 0)
    n = y.try_cast("int")
    before = F.concat((n - 1).cast("string"), F.lit(" "), F.substring(y, 3, 2))
    alone = F.when(n >= 2010, F.array(y, before)).when(y != "", F.array(y))
    two = F.array(F.concat(a, F.lit(" "), b), F.concat(a, F.lit("/"), b))
    return F.when(c.isNotNull(), F.coalesce(F.when(a != "", two), alone, F.array().cast("array<string>")))


def _report_year(text: Column, name: Column) -> Column:
    ended = F.regexp_extract(text, r"(?i)YEAR ENDED 31 MARCH ([0-9]{4})", 1)
    return F.coalesce(F.nullif(ended, F.lit("")), F.nullif(F.regexp_extract(name, "20[0-9]{2}", 0), F.lit(""))).try_cast("int")


def infer_year(text: Column, name: Column) -> Column:
    """The year that a report's text gives, or else its file name."""
    return _report_year(text, name)


def period_date(text: Column, name: Column) -> Column:
    """(period, balance date) of a report, Unknown where there is no year."""
    return let(_report_year(text, name), period_of)


def period_of(y: Column) -> Column:
    """(period, balance date) of a year, Unknown where it is null."""
    period = F.concat((y - 1).cast("string"), F.lit("/"), F.substring(y.cast("string"), -2, 2))
    return F.struct(F.coalesce(period, F.lit("Unknown")).alias("period"), F.coalesce(F.concat(F.lit("31 March "), y.cast("string")), F.lit("Unknown")).alias("date"))


def output_name(name: Column, stem: str = "report") -> Column:
    y = F.nullif(F.regexp_extract(name, "20[0-9]{2}", 0), F.lit(""))
    return F.concat(F.lit(f"{stem}_"), F.coalesce(y, F.lit("unknown")), F.lit(".txt"))


def dedupe_phrase(c: Column) -> Column:
    """A phrase said several times in a row is said once."""
    return F.regexp_replace(c, r"(\b.+?\b)(?: \1)+", "$1")


def after_marker(c: Column, markers: tuple[str, ...] = ("Answer:",)) -> Column:
    """What stands behind the last of the first marker that occurs, stripped."""
    out = c
    for m in reversed(markers):
        out = F.when(F.contains(c, F.lit(m)), F.substring_index(c, m, -1)).otherwise(out)
    return _strip(out)


INSTRUCTION = "Instruction: Answer"
GROUNDED = INSTRUCTION + " the financial question" + " based on the provided context.\nContext:\n"
NUMBER_ONLY = INSTRUCTION + " with a single numeric value and units" + " if present, based on context.\nContext:\n"
ASKED = "\n\nQuestion: "
PREAMBLE = "Answer the question based on" + " the context.\n\nContext:\n"


def prompt_plain(question: Column, answer: Column) -> Column:
    return F.concat(F.lit(INSTRUCTION + " the financial question.\nQuestion: "), question, F.lit("\nAnswer: "), answer)


def prompt_raft(question: Column, context: Column, answer: Column | None = None) -> Column:
    parts = [F.lit(GROUNDED), context, F.lit(ASKED), question, F.lit("\nAnswer:")]
    return F.concat(*parts, *([F.lit(" "), answer] if answer is not None else []))


def prompt_rag(question: Column, context: Column) -> Column:
    return F.concat(F.lit(PREAMBLE), context, F.lit(ASKED), question, F.lit("\nAnswer:"))


def prompt_ft(question: Column, context: Column | None = None) -> Column:
    if context is None:
        return F.concat(F.lit(INSTRUCTION + " with a single numeric value" + " if applicable.\nQuestion: "), question, F.lit("\nAnswer:"))
    return F.concat(F.lit(NUMBER_ONLY), context, F.lit(ASKED), question, F.lit("\nAnswer (number only):"))


def add_currency(c: Column, symbol: str = "£") -> Column:
    return F.when(~c.rlike("[£$€]"), F.concat(F.lit(symbol), c)).otherwise(c)


def clean_eval(c: Column) -> Column:
    return _strip(F.regexp_replace(c, "[Â,]", ""))


def norm_num(c: Column) -> Column:
    """The numbers that an answer is compared by."""
    found = F.regexp_extract_all(clean_eval(c), F.lit(V.COMPARED), F.lit(0))

    def number(x: Column) -> Column:
        negative = x.startswith("-") | (x.startswith("(") & x.endswith(")"))
        v = F.regexp_replace(x, r"^[$£€()]+|[$£€()]+$", "").try_cast("double")
        return F.when(negative, -v).otherwise(v)

    return F.filter(F.transform(found, number), lambda v: v.isNotNull())


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def numeric_close(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    """Whether any number of a is within the tolerance of any of b; without numbers, whether the digits are equal."""
    x, y = norm_num(a), norm_num(b)
    same = lambda u, v: ((u == 0) & (v == 0)) | ((v != 0) & (F.abs(u - v) / F.greatest(F.lit(1.0), F.abs(v)) <= tolerance))
    near = F.exists(x, lambda u: F.exists(y, lambda v: same(u, v)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), near).otherwise(digits_only(a) == digits_only(b))


def cut(c: Column, most: int = 1000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)
