"""Mixing sources to target weights by temperature, with DataFrame operations only.

A source's weight is its token share to the power alpha, normalised. Alpha is
bisected on the table of sources: 1 keeps the shares, 0 makes sources equal.
It is the largest alpha whose weights have the target entropy, raised where a
source would otherwise be repeated more often than the limit. A weight times
the token budget is a source's target: whole passes over its documents, each in
an order of its own by hash, and part of one more, which is all keys below one
cut key. Prefix sums go through buckets of the key, so a source that holds a
third of all rows is summed by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvector.llm.common import cut, set_aside

STEPS = 30
AT_ONCE = 5
BUCKET_ROWS = 5000
BROADCAST_SOURCES = 100_000


def words(text):
    """Words and an end id."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def key(seed: int, epoch, doc_id):
    """Place of a document in one pass over its source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def exponent(sources: DataFrame, budget: int, entropy_share: float, max_repeats: float) -> float:
    """Alpha by bisection; each job takes five steps at once, over the 31 midpoints they can meet."""
    total, n = sources.agg(F.sum("tokens"), F.count("*")).first()
    if not n:
        return 1.0
    share = F.col("tokens") / float(total)

    def met(alphas: list[float]) -> dict[float, tuple[bool, bool]]:
        p = sources.select(share.alias("s"), F.explode(F.array(*[F.lit(a) for a in alphas])).alias("alpha")).withColumn("x", F.pow("s", "alpha"))
        row = p.groupBy("alpha").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("xl"), F.max(F.col("x") / F.col("s")).alias("r"))
        row = row.select("alpha", (F.log("z") - F.col("xl") / F.col("z")).alias("h"), (F.col("r") / F.col("z") * (budget / float(total))).alias("r"))
        goal = F.log(F.lit(float(n))) * entropy_share
        return {r["alpha"]: (r["even"], r["few"]) for r in row.select("alpha", (F.col("h") >= goal).alias("even"), (F.col("r") <= max_repeats).alias("few")).collect()}

    def bisect(which: int, want_low: bool) -> float:
        low, high = 0.0, 1.0
        ends = met([0.0, 1.0])
        if which == 0 and ends[1.0][0] or which == 1 and not ends[1.0][1]:
            return 1.0
        if which == 0 and not ends[0.0][0] or which == 1 and ends[0.0][1]:
            return 0.0
        for _ in range(STEPS // AT_ONCE):
            width = (high - low) / 2**AT_ONCE
            grid = [low + width * i for i in range(1, 2**AT_ONCE)]
            seen = met(grid)
            for _ in range(AT_ONCE):
                middle = (low + high) / 2
                low, high = (middle, high) if seen[middle][which] == want_low else (low, middle)
        return low if want_low else high

    return max(bisect(0, True), bisect(1, False))


def targets(docs: DataFrame, budget: int | None, entropy_share: float, max_repeats: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(documents without text, sources with target, passes, remainder and cut key)."""
    rows = cut(docs.select("doc_id", "source", F.to_json(F.struct("source")).alias("_s"), words(F.col("text")).alias("n_tokens")))
    sources = cut(rows.groupBy("_s").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = total if budget is None else budget
    alpha = exponent(sources, budget, entropy_share, max_repeats)
    z = (sources.agg(F.sum(F.pow(F.col("tokens") / float(total or 1), F.lit(alpha)))).first()[0]) or 1.0
    weight = F.pow(F.col("tokens") / float(total or 1), F.lit(alpha)) / z
    goal = F.round(weight * float(budget)).cast("long")
    sources = sources.withColumn("weight", weight).withColumn("target", goal).withColumn("passes", F.floor(goal / F.col("tokens")).cast("int"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("tokens")).withColumn("buckets", F.ceil(F.col("docs") / BUCKET_ROWS).cast("long"))
    return rows, cut(sources)


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joined by source: broadcast while there are few sources, else by shuffle."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(sources) if few else sources, "_s")


def placed(rows: DataFrame, sources: DataFrame, epochs, seed: int) -> DataFrame:
    """Rows for each epoch with the tokens of their source and epoch before them, by key."""
    rows = with_sources(rows, sources).withColumn("epoch", F.explode(epochs)).withColumn("key", key(seed, F.col("epoch"), F.col("doc_id")))
    at = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(at * F.col("buckets") / F.lit(2**32)).cast("long"))
    per = rows.groupBy("_s", "epoch", "bucket").agg(F.sum("n_tokens").alias("sum"))
    per = per.select("_s", "epoch", "bucket", (F.sum("sum").over(Window.partitionBy("_s", "epoch").orderBy("bucket")) - F.col("sum")).alias("before"))
    by_key = Window.partitionBy("_s", "epoch", "bucket").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("_s", "epoch", "bucket", "key")
    inside = F.sum("n_tokens").over(by_key) - F.sum("n_tokens").over(same)
    return rows.withColumn("inside", inside).join(per, ["_s", "epoch", "bucket"]).withColumn("before", F.col("before") + F.col("inside"))


def mixture(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0, block_tokens: int = 1 << 20, seed: int = 7) -> DataFrame:
    """One row per realised copy: doc_id, source, n_tokens, epoch, block.

    Tokens are words and an end id. The mixture has ``budget`` tokens (default:
    as many as there are), in blocks of ``block_tokens``, each with every source
    in its weight. ``entropy_share`` is the target entropy over that of equal
    weights; ``max_repeats`` bounds how often a source is passed over.

    Defined cases: null sources form a source of their own; a null or empty
    text is one token; rows that share a doc_id stand at one place of the order
    and come or go together; an empty table gives no rows.
    """
    rows, sources = targets(docs, budget, entropy_share, max_repeats, seed)
    total = sources.agg(F.sum("target")).first()[0] or 0
    blocks = max(1, -(-total // block_tokens))
    start = F.col("epoch") * F.col("tokens") + F.col("before")
    taken = placed(rows, sources, F.sequence(F.lit(0), F.col("passes")), seed).where(start < F.col("target"))
    return taken.select("doc_id", "source", "n_tokens", "epoch", F.floor(start * F.lit(blocks) / F.col("target")).cast("long").alias("block"))


def mixed(docs: DataFrame, budget: int | None = None, entropy_share: float = 0.95, max_repeats: float = 4.0, seed: int = 7) -> DataFrame:
    """The documents of the mixture, a row for each copy, with the columns of ``docs``. Texts are not shuffled.

    Defined cases: as in ``mixture``; columns of any other name travel unchanged;
    an empty table gives an empty table.
    """
    rows, sources = targets(docs, budget, entropy_share, max_repeats, seed)
    beyond = placed(rows, sources, F.array("passes"), seed).where(F.col("before") >= F.col("rest"))
    cuts = beyond.groupBy("_s").agg(F.min("key").alias("cut"))
    sources = cut(sources.join(cuts, "_s", "left").select("_s", "passes", "cut"))
    part = F.when(F.col("cut").isNull() | (key(seed, F.col("passes"), F.col("doc_id")) < F.col("cut")), 1).otherwise(0)

    def copied(held: DataFrame) -> DataFrame:
        out = with_sources(held.withColumn("_s", F.to_json(F.struct("source"))), sources).withColumn("_n", F.col("passes") + part)
        return out.where("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n"))))

    return set_aside(docs, ("doc_id", "text", "source", "lang", "n_chars"), copied)
