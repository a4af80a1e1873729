"""Packing contexts into a budget, and training texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators.answer import let

BUDGET, ROOM, MARGIN = 1024, 64, 32


def word_cost(c: Column) -> Column:
    return F.size(X.ws_tokenize(c))


def pack(contexts: Column, fixed: Column, budget: int | Column, cost: Callable[[Column], Column] = word_cost) -> Column:
    """The longest run of contexts from the first whose costs and the fixed cost stay in the budget.

    cost must be nonnegative and add up over contexts, as words do.
    """
    limit = F.lit(budget) if isinstance(budget, int) else budget
    costs = F.transform(contexts, cost)

    def fit(cs: Column) -> Column:
        total = lambda i: F.aggregate(F.slice(cs, 1, i + 1), F.lit(0), lambda a, x: a + x)
        return F.filter(contexts, lambda x, i: total(i) + fixed <= limit)

    return let(costs, fit)


def raft_dataset(qa: DataFrame, budget: int = BUDGET) -> DataFrame:
    """text for each row of (question, answer, contexts): the contexts that fit beside question and answer."""
    fixed = word_cost(X.prompt_raft(F.col("question"), F.lit(""), F.col("answer")))
    packed = qa.withColumn("packed", pack(F.col("contexts"), fixed, budget))
    return packed.withColumn("text", X.prompt_raft(F.col("question"), F.array_join("packed", "\n"), F.col("answer")))


def plain_dataset(qa: DataFrame) -> DataFrame:
    return qa.withColumn("text", X.prompt_plain(F.col("question"), F.col("answer")))


def label_mask(ids: Column, length: int = 512, pad: int = 50256) -> Column:
    """(input_ids, attention_mask, labels), cut or padded to the length; labels are -100 on the padding."""
    kept = F.slice(ids, 1, length)
    missing = length - F.size(kept)
    full = F.concat(kept, F.array_repeat(F.lit(pad), missing))
    mask = F.concat(F.transform(kept, lambda _: F.lit(1)), F.array_repeat(F.lit(0), missing))
    labels = F.zip_with(full, mask, lambda i, m: F.when(m == 0, -100).otherwise(i))
    return F.struct(full.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))
