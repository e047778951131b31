"""SpotSigs fingerprints, with DataFrame operations only.

A spot signature is a common word (the anchor) and the chain of the next two
content words, whatever common words stand between these; of a run of common
words, the last is the anchor. A document's fingerprint is its whole set of spot
signatures, however long the text. Likeness is the Jaccard similarity of two
whole sets. Where both texts of a pair have fewer than ``FEW`` spots, as very
short ones do and those of languages whose common words are not known, their
sets of words are compared instead, which the fingerprints of such texts hold too.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinvector.llm.common import below, bound, cut

BUCKET_ROWS, MOST_BUCKETS = 500, 10_000
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "had", "has", "have", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
    "au", "avec", "dans", "de", "des", "du", "en", "est", "et", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von", "zu",
    "con", "del", "el", "las", "los", "no", "para", "por", "se", "su", "una", "y",
)


#: Spots below which a fingerprint also holds the words.
FEW = 16


def hashes(text):
    """struct<spots, words>: distinct hashes of a text's spots and, where these are few, of its words; without words, of itself.

    Time is linear in the text: words are looked up once, and a content word
    finds its anchor and the next content word by their places.
    """
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    common = lambda w: w.isin(*ANCHORS)

    def spots(content):
        def spot(x, k):
            after = F.get(content, k + 1)
            return F.when(common(x["before"]) & after.isNotNull(), F.xxhash64(x["before"], x["w"], after["w"]))

        return F.array_distinct(F.filter(F.transform(content, spot), lambda h: h.isNotNull()))

    def of(ws):
        placed = F.transform(ws, lambda w, i: F.struct(F.get(ws, i - 1).alias("before"), w.alias("w")))
        found = bound(F.filter(placed, lambda x: ~common(x["w"])), spots)
        own = F.when(F.size(ws) > 0, F.transform(F.array_distinct(ws), lambda w: F.xxhash64(w))).otherwise(F.array(F.xxhash64(text)))
        none = F.array().cast("array<bigint>")
        return bound(found, lambda f: F.struct(f.alias("spots"), F.when(F.size(f) < FEW, own).otherwise(none).alias("words")))

    return bound(F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>")), of)


def fingerprint(text):
    """struct<n, spots, words>: how many spots a text has, their hashes and those of its words, lowest first."""
    return bound(hashes(text), lambda h: F.struct(F.size(h["spots"]).cast("long").alias("n"), F.sort_array(h["spots"]).alias("spots"), F.sort_array(h["words"]).alias("words")))


def written(fp):
    """The count of spots, their hashes, and those of the words where the fingerprint has them."""
    hexed = lambda hs: F.lower(F.concat_ws(",", F.transform(hs, lambda h: F.lpad(F.hex(h), 16, "0"))))
    return F.concat(fp["n"].cast("string"), F.lit(":"), hexed(fp["spots"]), F.when(fp["n"] < FEW, F.concat(F.lit(";"), hexed(fp["words"]))).otherwise(F.lit("")))


def jaccard(a, b):
    return bound(F.size(F.array_intersect(a, b)), lambda both: both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def likeness(a, b):
    """Jaccard similarity of two fingerprints: of their spots, or of their words where both have few spots."""
    return F.when((a["n"] < FEW) & (b["n"] < FEW), jaccard(a["words"], b["words"])).otherwise(jaccard(a["spots"], b["spots"]))


def dealt(rows: DataFrame) -> DataFrame:
    """Adds ``bucket``: ranges of (doc_id, th) of about ``BUCKET_ROWS`` rows, in their order, ``MOST_BUCKETS`` or so at most.

    Ranges follow the quantiles of doc_id, so neither gaps nor outlying ids fill
    one range; an id that holds several ranges, and null ids, are dealt by th,
    which is a hash.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    ranges = lambda k: min(MOST_BUCKETS, max(1, -(-k // BUCKET_ROWS)))
    wanted = ranges(n - nulls)
    cuts = (rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 10 * wanted)).first()[0] if wanted > 1 else None) or []
    times = Counter(cuts)
    edges = sorted(times)
    several = {e: k for e, k in times.items() if k > 1}
    part = lambda parts: F.floor((F.col("th") / F.lit(2.0**64) + 0.5) * parts).cast("long")
    own = F.lit(-1).cast("long")  # ids of a range that are below its edge
    if several:
        parts = F.element_at(F.from_json(F.lit(json.dumps({str(e): k for e, k in several.items()})), "map<string,int>"), F.col("doc_id").cast("string"))
        own = F.coalesce(part(parts), own)
    place = F.when(F.col("doc_id").isNull(), F.struct(F.lit(-1).alias("range"), part(F.lit(ranges(nulls))).alias("part"))).otherwise(F.struct(below(F.col("doc_id"), edges).alias("range"), own.alias("part")))
    return rows.withColumn("bucket", place)


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text, fp and those of the next document by descending doc_id, after the last the first.

    Documents are dealt by ranges of doc_id; each range also gets the first
    document of the range below, so one shuffle of the texts is enough and no
    task sorts all documents. Fingerprints are taken after that shuffle, which
    carries texts only.
    """
    rows = dealt(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text")))
    heads = cut(rows.groupBy("bucket").agg(F.max(F.struct("doc_id", "th")).alias("h")))
    ends = Window.orderBy("bucket")  # a row per range of ids, of which there is a bounded number
    above = F.coalesce(F.lead("bucket").over(ends), F.min("bucket").over(ends))
    heads = heads.select(F.col("h.doc_id").alias("_d"), F.col("h.th").alias("_t"), above.alias("_to"))
    first = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "text", "th", F.col("_to").alias("bucket"))
    both = rows.withColumn("extra", F.lit(0)).unionByName(first.withColumn("extra", F.lit(1))).repartition("bucket").withColumn("fp", fingerprint(F.col("text")))
    w = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("doc_id"), F.desc("th"))
    return both.select("doc_id", "text", "fp", "extra", F.lead("text").over(w).alias("next_text"), F.lead("fp").over(w).alias("next_fp")).where("extra = 0")


def edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents, of their edited texts, and likeness to both.

    Returns doc_id, n_chars, text, edited, fp, edited_fp, near_edited, near_next.

    Defined cases: a null text is empty; a text without words has one signature,
    its own; rows that share a doc_id follow each other by a hash of the text; null
    ids come last; a single document is its own next; an empty table gives no
    rows; only doc_id and text are read, so other columns may have any name.
    """
    rows = neighbours(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - k).cast("int")), F.substr("next_text", F.lit(1), k)))
    rows = rows.withColumn("edited_fp", fingerprint(F.col("edited")))
    return rows.select("doc_id", "n_chars", "text", "edited", "fp", "edited_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of classes of equal fingerprints whose likeness reaches the threshold: a, b, likeness.

    Classes are named by their smallest doc_id. Set lengths are cut into
    partitions such that only neighbours can hold similar sets; within them,
    sets meet through the rarest signatures of each (as many as the threshold
    lets differ, and one), and are compared in full. Sets of spots meet where one
    side has ``FEW`` or more, sets of words where neither has.
    """
    kinds = F.array(
        F.when(F.col("fp.n") >= F.ceil(F.lit(FEW * threshold)), F.struct(F.lit("spots").alias("kind"), F.col("fp.spots").alias("s"))),
        F.when(F.col("fp.n") < FEW, F.struct(F.lit("words").alias("kind"), F.col("fp.words").alias("s"))),
    )
    prints = docs.where("doc_id is not null").select("doc_id", fingerprint(F.coalesce("text", F.lit(""))).alias("fp"))
    classes = cut(prints.groupBy(F.xxhash64("fp").alias("h")).agg(F.min(F.struct("doc_id", "fp")).alias("m")).select(F.col("m.doc_id").alias("id"), F.col("m.fp").alias("fp")))
    sets = classes.select("id", F.col("fp.n").alias("spots"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("x")).select("id", "spots", "x.kind", "x.s", F.size("x.s").alias("n"))
    part = F.floor(F.log("n") / F.log(F.lit(1 / threshold))).cast("int")
    each = sets.select("id", "kind", "spots", "n", part.alias("part"), F.explode("s").alias("h"))
    seen = each.groupBy("kind", "h").agg(F.count("*").alias("k"))
    rare = each.join(seen, ["kind", "h"]).groupBy("id", "kind", "spots", "n", "part").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    probe = rare.select("id", "kind", "spots", "n", "part", F.explode(first).alias("x")).where("x.k > 1").select("id", "kind", "spots", "n", "part", "x.h")
    left = probe.select(F.col("id").alias("a"), "kind", F.col("spots").alias("sa"), F.col("n").alias("na"), "part", "h")
    right = probe.select(F.col("id").alias("b"), "kind", F.col("spots").alias("sb"), F.col("n").alias("nb"), F.explode(F.array("part", F.col("part") - 1, F.col("part") + 1)).alias("part"), "h")
    able = F.least("na", "nb") >= F.greatest("na", "nb") * threshold
    pairs = left.join(right, ["kind", "part", "h"]).where("a < b").where(able & ((F.col("kind") == "words") | (F.greatest("sa", "sb") >= FEW))).select("a", "b").distinct()
    both = pairs.join(classes.select(F.col("id").alias("a"), F.col("fp").alias("fa")), "a").join(classes.select(F.col("id").alias("b"), F.col("fp").alias("fb")), "b")
    return both.select("a", "b", likeness(F.col("fa"), F.col("fb")).alias("likeness")).where(F.col("likeness") >= threshold)
