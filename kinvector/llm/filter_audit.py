"""What filters remove in every order in which they can be applied.

Each document's failures are bits of one number. Documents are crossed with the
orders of the filters (n! of them, 120 for five), which are broadcast; from the
bits and the order follows the step at which the document goes first. Every pair
becomes one row a step, and these are summed by part, order and step with partial
aggregation, so what is shuffled is a row for each of them and task. The texts
are read once, before that.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinvector.llm.common import bound, cut

SPACE = r"[\x20\x09-\x0D]+"
MOST_FILTERS = 6
#: The letter of the filter that needs other documents: the same text under a smaller id.
COPY = "E"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def default_filters(text: Column) -> dict[str, Column]:
    """Conditions of failure by letter, but for copies; one struct of the text's numbers feeds them all."""
    x = bound(words(text), lambda w: F.struct(F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("distinct")))
    return {"n": x, "capitals": F.regexp_count(text, F.lit("[A-Z]")), "points": F.char_length(text), "marked": text.rlike("[#$%&*|]")}


FAILS = {
    "A": lambda: F.col("n.words") < 200,
    "B": lambda: 100 * F.col("n.distinct") < 50 * F.col("n.words"),
    "C": lambda: 100 * F.col("capitals") > 2 * F.col("points"),
    "D": lambda: F.col("marked"),
}


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document; bit i of ``mask`` is set where filter i of ABCDE fails."""
    text = F.coalesce("text", F.lit(""))
    numbers = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.sha2(text.cast("binary"), 256).alias("same"), *[c.alias(n) for n, c in default_filters(text).items()])
    bits = sum((F.when(fails(), F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(FAILS.values())), F.lit(0))
    rows = cut(numbers.select("doc_id", "part", "same", bits.alias("mask")))
    first = cut(rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("k")).where("k > 1").select(F.col("same").alias("_same"), "first"))
    told = cut(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_d")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")))
    rows = rows.join(first, F.col("same") == F.col("_same"), "left").join(told, F.col("doc_id") == F.col("_d"), "left")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(FAILS))).otherwise(F.lit(0))
    return rows.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def replayed(flags: DataFrame, letters: str = "ABCDE") -> DataFrame:
    """One row for each part, order of the letters and step: filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``flags`` has part, mask (bit i: the filter of letter i fails), good and
    toxic. ``shapley`` is what the step's filter removes, summed over all orders.
    """
    if not 1 <= len(letters) <= MOST_FILTERS or len(set(letters)) < len(letters):
        raise ValueError(f"from 1 to {MOST_FILTERS} different letters are needed")
    n = len(letters)
    schema = "filter_order string, " + ", ".join(f"b{i} int" for i in range(1, n + 1))
    orders = flags.sparkSession.createDataFrame([("".join(p), *[1 << letters.index(c) for c in p]) for p in permutations(letters)], schema)  # n! rows
    hit = F.coalesce(*[F.when(F.col("mask").bitwiseAND(F.col(f"b{i}")) != 0, F.lit(i)) for i in range(1, n + 1)], F.lit(n + 1))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"b{i}").alias("bit")) for i in range(1, n + 1)]))
    rows = flags.crossJoin(F.broadcast(orders)).select("part", "filter_order", "mask", "good", "toxic", hit.alias("gone"), steps.alias("s")).select("*", "s.step", "s.bit")
    here = F.col("gone") == F.col("step")
    some = {
        "kept": F.col("gone") > F.col("step"),
        "removed": here,
        "redundant": (F.col("mask").bitwiseAND(F.col("bit")) != 0) & (F.col("gone") < F.col("step")),
        "unique_fails": F.col("mask") == F.col("bit"),
        "good_lost": here & F.col("good"),
        "toxic_lost": here & F.col("toxic"),
    }
    total = rows.groupBy("part", "filter_order", "step").agg(*[F.count_if(c).alias(name) for name, c in some.items()])
    total = total.withColumn("filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    return total.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))  # a row for each order


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters of documents by source; see ``replayed``.

    A: under 200 words; B: fewer than half of the words are distinct; C: more
    than 2 % capitals; D: a mark of ``#$%&*|``; E: the text of a smaller doc_id.

    Defined cases: a null text is empty, a null source the part of the empty
    string; a null doc_id is no smaller id and has no labels; rows that share a
    doc_id count each, and are no copies of each other; an id with several labels
    is good or toxic if one of them says so; an empty table gives no rows; only
    the named columns are read, so others may have any name.
    """
    return replayed(flagged(docs, labels))
