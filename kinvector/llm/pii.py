"""Personal data: base patterns and bootstrapped contextual extraction, with DataFrame operations only.

Base spans are the seeds, and so are keys of public formats (kind ``secret``).
Candidates are identifier-shaped words that no base span touches, and runs of up
to four words of digits. Seeds and candidates stand in lexical patterns: the
word before, the two words before, the words on both sides, and the form of the
value itself. Patterns and instances form a graph. A pattern's score for a kind
is the mean score of its distinct instances; a candidate's is the noisy-or of its
patterns. Scores are iterated until no new instance is accepted: accepted
candidates support patterns in the next round, and candidates that end above
``accept`` become spans of the kind, which don't overlap. ``recovered`` hides
part of the seeds and tells how many of them the patterns find again.

All positions of a text come from one pass of each pattern: running sums go over
chunks of ``CHUNK`` matches and over chunks, so that time stays linear in the
number of matches up to some millions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinvector.llm.common import bound, cut

KINDS = ("email", "ip", "card", "phone")
#: The base patterns with possessive repeats, and matches begun only where a longer one can't begin earlier: same matches, time linear in the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a candidate of a kind must look like; the last is of keys and passwords.
SHAPES = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^(?:[0-9]{1,3}(?:[.:,_][0-9]{1,3}){3,7}|[0-9A-Fa-f]*+(?::[0-9A-Fa-f]*+){3,7})$",
    "card": r"^(?:[0-9][ ._/-]?){12,19}$",
    "phone": r"^\+?(?:[(). /-]*[0-9]){7,15}$",
    "secret": r"^(?=(?:[^0-9]*+[0-9]){3})(?=(?:[^A-Za-z]*+[A-Za-z]){3})[A-Za-z0-9+/_-]{12,128}={0,2}$",
}
SECRET = len(KINDS)
#: Public formats of keys, the seeds of secrets.
KEYS = r"^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,})$"
#: Words of which a candidate of several words may consist.
PART = r"^[+(]*[0-9][0-9()./-]*$"
MOST_WORDS = 4
#: A name before a value in one word, which is context.
NAME = r"^[A-Za-z_.-]{2,40}[=:]+"
QUOTES, ENDS = "\"'([{<,;:!?.*#$%&", "\"'()[]{}<>,;:!?.*#$%&"
CHUNK = 64
SPAN = "struct<start:int,rank:int,end:int,value:string>"
CONTEXT = "struct<l1:string,l2:string,r1:string>"


def running(values, zero, op):
    """For each of an array of int what ``op`` makes of all before it, by chunks."""
    none = F.array().cast("array<int>")

    def fold(xs, step):
        return F.aggregate(xs, F.struct(zero.cast("int").alias("at"), none.alias("all")), lambda s, x: F.struct(op(s["at"], step(x)).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")))

    def whole(xs):
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        parts = F.transform(starts, lambda c: fold(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)), lambda x: x))
        return bound(parts, lambda ps: F.flatten(F.zip_with(ps, fold(ps, lambda x: x["at"])["all"], lambda p, b: F.transform(p["all"], lambda y: op(y, b)))))

    return bound(values, lambda xs: F.when(F.size(xs) > 0, whole(xs)).otherwise(none))


def found(text, pattern: str, good):
    """array<struct<start,end,value,before,after>> of the matches that are ``good``, in code points.

    before and after are up to 80 code points of text around a match, as far as
    the matches next to it reach.
    """
    text_of = lambda xs, i: F.coalesce(F.get(xs, i), F.lit(""))
    last = lambda s: F.substring(s, -80, 80)
    first = lambda s: F.substring(s, 1, 80)

    def step(b, value, i):
        hits, gaps = b["hits"], b["gaps"]
        before = last(F.concat(last(text_of(hits, i - 2)), last(text_of(gaps, i - 1)), last(text_of(hits, i - 1)), last(text_of(gaps, i))))
        after = first(F.concat(first(text_of(gaps, i + 1)), first(text_of(hits, i + 1)), first(text_of(gaps, i + 2))))
        around = lambda ok: [F.when(ok, x).alias(n) for x, n in ((before, "before"), (after, "after"))]
        return bound(F.coalesce(good(value), F.lit(False)), lambda ok: F.struct(F.char_length(text_of(gaps, i)).alias("gap"), F.char_length(value).alias("size"), ok.alias("ok"), value.alias("value"), *around(ok)))

    def placed(steps):
        at = running(F.transform(steps, lambda x: x["gap"] + x["size"]), F.lit(0), lambda x, y: x + y)
        put = lambda x, n: F.struct((n + x["gap"]).alias("start"), (n + x["gap"] + x["size"]).alias("end"), x["ok"].alias("ok"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.filter(F.zip_with(steps, at, put), lambda x: x["ok"])

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    return bound(both, lambda b: bound(F.transform(b["hits"], lambda value, i: step(b, value, i)), placed))


def digits(value):
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value):
    d = F.reverse(digits(value))
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda n, i: n + F.when(i % 2 == 1, F.substr(d, i, F.lit(1)).cast("int")).otherwise(doubled(F.substr(d, i, F.lit(1)).cast("int"))))
    return total % 10 == 0


def valid(kind: str, value):
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(value)).between(14, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text):
    """array<struct<start,rank,end,value,before,after>> by start, then kind."""
    rare = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<start:int,rank:int,end:int,value:string,before:string,after:string>>")
    parts = []

    def ranked(rank, kind):
        put = lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return F.transform(found(text, BASE[kind], lambda v: valid(kind, v)), put)

    for rank, kind in enumerate(KINDS):
        parts.append(F.when(rare[kind], ranked(rank, kind)).otherwise(none) if kind in rare else ranked(rank, kind))
    return F.sort_array(F.concat(*parts))


def context(before, after):
    """The lower-cased words around a span, digits as 0: struct<l1,l2,r1>."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    return F.struct(
        plain(F.regexp_extract(before, r"(?<!\S)(\S++)\s*+$", 1)).alias("l1"),
        plain(F.regexp_extract(before, r"(?<!\S)(\S++\s++\S++)\s*+$", 1)).alias("l2"),
        plain(F.regexp_extract(after, r"^\s*+(\S++)", 1)).alias("r1"),
    )


def candidates(text):
    """array<struct<start,end,value,before,after>>: words with a digit or @, without quotes and names around them, and runs of words of digits."""

    def stripped(x):
        name = F.regexp_extract(x["value"], NAME, 0)
        own = F.substr(x["value"], F.char_length(name) + 1)
        lead = F.char_length(name) + F.char_length(own) - F.char_length(F.ltrim(own, F.lit(QUOTES)))
        value = F.btrim(own, F.lit(ENDS))
        return F.struct((x["start"] + lead).alias("start"), (x["start"] + lead + F.char_length(value)).alias("end"), value.alias("value"), F.concat(x["before"], name).alias("before"), x["after"].alias("after"))

    def runs(words, n):
        """Runs of n words with one blank between neighbours."""
        def joined(x, i):
            parts = [x, *[F.get(words, i + k) for k in range(1, n)]]
            apart = [q["start"] == p["end"] + 1 for p, q in zip(parts, parts[1:])]
            digital = [p["value"].rlike(PART) for p in parts[:-1]] + [F.rtrim(parts[-1]["value"], F.lit(ENDS)).rlike(PART)]
            ok = reduce(lambda a, b: a & b, apart + digital)
            value = F.concat_ws(" ", *[p["value"] for p in parts[:-1]], F.rtrim(parts[-1]["value"], F.lit(",;:!?.*#$%&")))
            return F.when(ok, F.struct(x["start"].alias("start"), (x["start"] + F.char_length(value)).alias("end"), value.alias("value"), x["before"].alias("before"), parts[-1]["after"].alias("after")))

        return F.filter(F.transform(words, joined), lambda x: x.isNotNull())

    return bound(found(text, WORD, lambda v: F.lit(True)), lambda words: F.concat(F.transform(words, stripped), *[runs(words, n) for n in range(2, MOST_WORDS + 1)]))


def free(xs, spans):
    """Those of ``xs`` that no span touches, by running ends and starts over both in order."""
    end_of_all = 2**31 - 1

    def told(u):
        ends = running(F.transform(u, lambda x: F.when(x["i"] < 0, x["end"]).otherwise(-1)), F.lit(-1), F.greatest)
        starts = F.reverse(running(F.reverse(F.transform(u, lambda x: F.when(x["i"] < 0, x["start"]).otherwise(end_of_all))), F.lit(end_of_all), F.least))
        clear = F.zip_with(F.zip_with(u, ends, lambda x, e: F.struct(x["i"].alias("i"), x["end"].alias("end"), (e <= x["start"]).alias("ok"))), starts, lambda x, s: F.when((x["i"] >= 0) & x["ok"] & (s >= x["end"]), x["i"]))
        return F.filter(clear, lambda i: i.isNotNull())

    def of(b):
        union = F.sort_array(F.concat(F.transform(b["spans"], lambda x: F.struct(x["start"].alias("start"), F.lit(-1).alias("i"), x["end"].alias("end"))), F.transform(b["xs"], lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end")))))
        return F.when(F.size(b["spans"]) > 0, F.transform(bound(union, told), lambda i: F.get(b["xs"], i))).otherwise(b["xs"])

    return bound(F.struct(xs.alias("xs"), spans.alias("spans")), of)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), base spans, words (candidates) and seeds with contexts: the one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("th"), text.rlike("[0-9@]").alias("some"))
    where_some = lambda x: F.when(F.col("some"), x)
    rows = rows.withColumn("spans", where_some(base_spans(F.col("text"))))
    shaped = lambda x: reduce(lambda a, b: a | b, [x["value"].rlike(p) for p in SHAPES.values()])
    inner = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), context(x["before"], x["after"]).alias("c"))
    words = F.transform(free(F.filter(candidates(F.col("text")), shaped), F.col("spans")), inner)
    seeds = F.transform("spans", lambda x: F.struct(x["rank"].alias("rank"), x["value"].alias("value"), context(x["before"], x["after"]).alias("c")))
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["value"].alias("value")))
    rows = rows.select("doc_id", "th", base.alias("base"), where_some(words).alias("words"), seeds.alias("seeds"))
    keys = F.transform(F.filter("words", lambda x: x["value"].rlike(KEYS)), lambda x: F.struct(F.lit(SECRET).alias("rank"), x["value"].alias("value"), x["c"].alias("c")))
    kinds = {"base": f"array<{SPAN}>", "words": f"array<struct<start:int,end:int,value:string,c:{CONTEXT}>>", "seeds": f"array<struct<rank:int,value:string,c:{CONTEXT}>>"}
    rows = rows.withColumn("seeds", F.concat("seeds", keys))
    return rows.select("doc_id", "th", *[F.coalesce(n, F.array().cast(t)).alias(n) for n, t in kinds.items()])


def form(value):
    """What a value looks like: digits as 0 and runs of letters as a; keys by their letters."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), r"\p{L}+", "a")
    return F.when(value.rlike("^[0-9a-f]{16,}$"), "hex").when(value.rlike("^[0-9A-Z]{16,}$"), "capitals").when(value.contains("@"), F.regexp_replace(plain, "0+", "0")).otherwise(plain)


def bootstrap(scan: DataFrame, rounds: int, support: int, precise: float, accept: float) -> DataFrame:
    """(value, rank, score) of accepted candidates."""
    patterns = lambda v, c: F.array(F.concat(F.lit("l1 "), c["l1"]), F.concat(F.lit("l2 "), c["l2"]), F.concat(F.lit("lr "), c["l1"], F.lit(" _ "), c["r1"]), F.concat(F.lit("form "), form(v)))
    worded = lambda p: ~p.rlike(r"^(?:l[12] |lr (?: _ .*|.* _ ))$")
    seed = scan.select(F.explode("seeds").alias("x")).select("x.value", "x.rank", F.lit(1.0).alias("score"), F.explode(F.filter(patterns(F.col("x.value"), F.col("x.c")), worded)).alias("pattern")).distinct()
    cand = scan.select(F.explode("words").alias("x")).select("x.value", F.explode(F.filter(patterns(F.col("x.value"), F.col("x.c")), worded)).alias("pattern")).distinct()
    seed, cand = cut(seed), cut(cand)
    fits = F.filter(F.array(*[F.when(F.col("value").rlike(p), F.lit(i)) for i, p in enumerate(SHAPES.values())]), lambda i: i.isNotNull())
    known_values = seed.select("value").distinct()
    all_of = cut(seed.select("pattern", "value").unionByName(cand).distinct().groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    cand = cut(cand.join(known_values, "value", "left_anti").select("value", "pattern", F.explode(fits).alias("rank")).join(all_of.select("pattern"), "pattern", "left_semi"))
    scores, before = None, -1
    for _ in range(rounds):
        known = seed if scores is None else seed.unionByName(cand.join(scores.where(F.col("score") >= accept), ["value", "rank"]).select("value", "rank", "score", "pattern"))
        good = known.groupBy("pattern", "rank").agg(F.sum("score").alias("s"), F.count("*").alias("k")).where(F.col("k") >= support)
        good = good.join(all_of, "pattern").select("pattern", "rank", (F.col("s") / F.col("n")).alias("p")).where(F.col("p") >= precise)
        scores = cut(cand.join(good, ["pattern", "rank"]).groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-9)))))).alias("score")))
        now = scores.where(F.col("score") >= accept).count()
        if now == before:
            break
        before = now
    own = seed.select("value", "rank", "score").distinct()  # also where the base patterns could not match them
    return scores.where(F.col("score") >= accept).unionByName(own)


def apart(spans):
    """Of spans by start, and at one start by preference, those that none kept before them touches.

    A chunk of ``CHUNK`` spans is gone over at a time, so arrays that grow stay short and time linear.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def step(s, x):
        free = x["start"] >= s["end"]
        return F.struct(F.when(free, x["end"]).otherwise(s["end"]).alias("end"), F.when(free, F.concat(s["kept"], F.array(x))).otherwise(s["kept"]).alias("kept"))

    def chunk(xs, s, c):
        part = F.aggregate(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)), F.struct(s["end"].alias("end"), none.alias("kept")), step)
        return bound(part, lambda p: F.struct(p["end"].alias("end"), F.concat(s["all"], F.array(p["kept"])).alias("all")))

    def whole(xs):
        starts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / CHUNK).cast("int"))
        return F.flatten(F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.array().cast(f"array<array<{SPAN}>>").alias("all")), lambda s, c: chunk(xs, s, c), lambda s: s["all"]))

    return bound(spans, lambda xs: F.when(F.size(xs) > 1, whole(xs)).otherwise(xs))


def personal_data(docs: DataFrame, rounds: int = 8, support: int = 5, precise: float = 0.6, accept: float = 0.75) -> DataFrame:
    """doc_id, base, added and secrets (arrays of start, rank, end, value; rank numbers ``KINDS``, secrets come after them).

    A pattern counts with ``support`` distinct instances and a score of
    ``precise`` or more; at most ``rounds`` rounds are taken.

    Defined cases: a null or empty text has no spans; repeated rows get a row
    each; base spans of two kinds may overlap, added ones and secrets touch no
    base span and not each other; where they compete the one that begins first
    stays, at one place that of the higher score, then the longer one; an empty
    table gives no rows; only doc_id and text are read, so other columns may have
    any name.
    """
    scan = cut(scanned(docs))
    taken = bootstrap(scan, rounds, support, precise, accept)
    best = taken.groupBy("value").agg(F.max(F.struct("score", -F.col("rank"))).alias("m")).select("value", F.col("m.score").alias("score"), (-F.col("m.col2")).alias("rank"))
    words = scan.select("doc_id", "th", F.explode("words").alias("x")).distinct().select("doc_id", "th", "x.start", "x.end", "x.value")
    order = F.struct("start", (-F.col("score")).alias("score"), (F.col("start") - F.col("end")).alias("size"), "rank", "end", "value")
    more = words.join(best, "value").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(order)).alias("more"))
    more = more.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["value"].alias("value"))).alias("more"))
    more = more.withColumn("more", apart(F.col("more")))
    out = scan.join(more, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left")
    of = lambda secret: F.coalesce(F.filter("more", lambda x: (x["rank"] == SECRET) == F.lit(secret)), F.array().cast(f"array<{SPAN}>"))
    return out.select("doc_id", "base", of(False).alias("added"), of(True).alias("secrets"))


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["rank"] == KINDS.index(kind))).cast("long")


def written(spans):
    """kind:start:end, joined by commas, in the order of the spans; secrets are a kind of their own."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def recovered(docs: DataFrame, part: int = 10, rounds: int = 8, support: int = 5, precise: float = 0.6, accept: float = 0.75) -> DataFrame:
    """What the patterns find of seeds that were hidden: kind, hidden, found, wrong, and other, a row for each kind.

    Seeds whose value has a hash that ``part`` divides are made candidates.
    ``found`` of the ``hidden`` values are accepted for their own kind, ``wrong``
    for another; ``other`` values that are no seeds are accepted besides.
    """
    secret = lambda x: F.crc32(x["value"].cast("binary")) % part == 0
    scan = scanned(docs)
    hidden = scan.select(F.explode(F.filter("seeds", secret)).alias("x")).select("x.value", "x.rank").distinct()
    hide = F.transform(F.filter("seeds", secret), lambda x: F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), x["value"].alias("value"), x["c"].alias("c")))
    scan = cut(scan.select("doc_id", "th", F.concat("words", hide).alias("words"), F.filter("seeds", lambda x: ~secret(x)).alias("seeds")))
    seeds = scan.select(F.explode("seeds").alias("x")).select("x.value").distinct()
    taken = bootstrap(scan, rounds, support, precise, accept).join(seeds, "value", "left_anti").groupBy("value").agg(F.max(F.struct("score", -F.col("rank"))).alias("m")).select("value", (-F.col("m.col2")).alias("said"))
    rows = cut(hidden).join(taken, "value", "full_outer")
    kind = F.element_at(F.array(*map(F.lit, (*KINDS, "secret"))), F.coalesce("rank", "said") + 1)
    return rows.groupBy(kind.alias("kind")).agg(F.count("rank").alias("hidden"), F.count_if(F.col("rank") == F.col("said")).alias("found"), F.count_if(F.col("rank") != F.col("said")).alias("wrong"), F.count_if(F.col("rank").isNull()).alias("other"))
