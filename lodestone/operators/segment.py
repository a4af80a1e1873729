"""Sections and overlapping windows of words. Everything happens within a row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.functions import vocabulary as V

SIZES, OVERLAP = (100, 400), 20


def heading(line: Column) -> Column:
    """The section that a line opens, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(V.SECTIONS):
        out = F.when(line.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, text): lines belong to the last heading before them, or to general; a repeated heading adds to its section.

    general is always there, empty where the text opens with a heading; a null text is an empty one.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\r\n|\n|\r")
    base = docs.select(F.col(id_col).alias("doc_id"), lines.alias("lines"))
    marks = F.filter(F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), heading(x).alias("name"))), lambda m: m["name"].isNotNull())
    marks = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit("general").alias("name"))), marks)
    base = base.withColumn("marks", marks)
    end = lambda i: F.coalesce(F.get("marks", i + 1)["at"], F.size("lines") + 1)
    spans = F.transform("marks", lambda m, i: F.struct(m["name"].alias("name"), F.slice("lines", m["at"], end(i) - m["at"]).alias("lines")))
    names = F.array_distinct(F.transform("marks", lambda m: m["name"]))
    whole = lambda n: F.flatten(F.transform(F.filter("spans", lambda s: s["name"] == n), lambda s: s["lines"]))
    base = base.withColumn("spans", spans).withColumn("names", names)
    parts = F.transform("names", lambda n: F.struct(n.alias("section"), X._strip(F.array_join(whole(n), "\n")).alias("text")))
    return base.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.section", "p.text")


def windows(words: Column, size: int, overlap: int = OVERLAP) -> Column:
    """Array of (start, text) of the windows over an array of words; none for no words."""
    step = max(1, size - overlap)
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i + 1, size), " ").alias("text")))


def chunks(sectioned: DataFrame, sizes: tuple[int, ...] = SIZES, overlap: int = OVERLAP) -> DataFrame:
    """(id, doc_id, section, chunk_size, start, text) of every window of each size, cut in one pass over the words."""
    base = sectioned.select("doc_id", "section", X.tokenize(F.col("text")).alias("words"))

    def sized(n: int) -> Column:
        return F.transform(windows(F.col("words"), n, overlap), lambda w: F.struct(F.lit(n).alias("chunk_size"), w["start"].alias("start"), w["text"].alias("text")))

    each = [sized(n) for n in sizes]
    out = base.select("doc_id", "section", F.explode(F.concat(*each)).alias("w"))
    ident = F.concat_ws(":", F.col("doc_id").cast("string"), "section", F.col("w.start").cast("string"))
    return out.select(ident.alias("id"), "doc_id", "section", "w.chunk_size", "w.start", "w.text")


def corpus(docs: DataFrame, sizes: tuple[int, ...] = SIZES, overlap: int = OVERLAP) -> DataFrame:
    """The chunks of all sections of all documents."""
    return chunks(sections(docs), sizes, overlap)


def slice_section(text: Column, start: str, ends: list[str]) -> Column:
    """From the start pattern on, to the first of the end patterns, in the order of the list, that occurs behind it; null without a start."""

    def upto(rest: Column, ends: list[str]) -> Column:
        if not ends:
            return rest
        at = F.regexp_instr(rest, F.lit(f"(?is){ends[0]}"))
        return X.let(at, lambda p: F.when(p > 0, rest.substr(F.lit(1), p - 1)).otherwise(upto(rest, ends[1:])))

    def cut(whole: Column) -> Column:
        head = F.regexp_extract(whole, f"(?is){start}", 0)
        return X.let(head, lambda h: F.concat(h, X.let(whole.substr(F.length(h) + 1, F.lit(1 << 30)), lambda rest: upto(rest, ends))))

    return X.let(F.regexp_extract(text, f"(?is)(?:{start}).*", 0), lambda whole: F.when(whole != "", cut(whole)))
