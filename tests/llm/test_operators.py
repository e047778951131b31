"""Every operator against brute force on texts with nulls, blanks, ties, repeats and long rows."""

import hashlib
import itertools
import math
import os
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kinvector.llm import common, itq, language_id, line_dedup, mixing, near_dedup, packing, pii, queries, registry, repeats, spotsigs, sstable, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, sequence_id string"
LONG = "this is one of the repeated lines that everybody has in their documents"


def sample(n=60, seed=4):
    r = random.Random(seed)
    words = "the of and to in is was alpha beta gamma delta épsilon Zeta eta theta iota kappa lambda mu".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 120))) for _ in range(n)]
    texts += [LONG + "\n" + t for t in texts[:6]] + ["  " + LONG.upper() + "\t\nend"]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2].upper(), None, "", " ", "\n\n", "...", "x" * 3000, "word " * 5000]
    rows = [(i, t, r.choice(["en", "fr", None]), r.choice(["a", "a", "b", None])) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "a"), (5, "another text of the id five", "fr", "b"), (None, "a text of no id", "en", "a")]
    return [(i, t, lang, s, len(t or ""), "x", "y", "z") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(x):
    return tuple((v is not None, str(v)) for v in x)


def test_lines(docs, rows, none):
    blank = " \t\n\x0b\x0c\r"
    fold = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(blank))
    held, last = {}, {}
    for i, t, *_ in rows:
        for k in {fold(x) for x in (t or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
            last[k] = max(last.get(k, -1), -1 if i is None else i)
    want = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(fold(x)) >= 40 and held[fold(x)] >= 5 and last[fold(x)] != (-1 if i is None else i))]
        want.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    got = line_dedup.line_dedup(docs)
    assert got.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_dropped"]
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key) == sorted(want, key=key)
    assert sum(w[3] for w in want) >= 5
    assert line_dedup.line_dedup(none).count() == 0
    few = line_dedup.line_dedup(docs, min_chars=1, min_docs=2)
    many = line_dedup.line_dedup(docs, min_chars=1, min_docs=2, shard_keys=1)  # lines are dealt to their shards
    assert sorted(map(tuple, few.collect()), key=key) == sorted(map(tuple, many.collect()), key=key)


def test_line_keys(spark):
    """Keys are stripped of six blanks and folded in A-Z alone; lines are split at line feeds alone, hashed as Spark does, and no plan folds letter by letter."""
    rows = [(1, "Ab É\u2028İ Σß\x85 z\r\n \t\x0b\x0cÉA \n\n\xa0AB\xa0"), (1, "aB É\u2028İ Σß\x85 Z\nAb É\u2028İ Σß\x85 z"), (2, None), (None, ""), (3, "xyz"), (4, "ÉÉ\r"), (4, "éé\r\r\n😀Q ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    keys = [(i, {re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")}) for i, t in rows]
    held = [(i, k) for i, ks in keys for k in ks if len(k) >= 2]
    made = spark.createDataFrame(held, "doc_id long, k string").select("doc_id", F.xxhash64("k").alias("h"), F.xxhash64(F.concat(F.lit("\n"), "k")).alias("print"))
    want = made.groupBy("h", "print").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    found = line_dedup.repeated(docs, 2, 1)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 7
    assert "translate" not in found._jdf.queryExecution().toString()
    line, again = "Ab É\u2028İ Σß\x85 z", "aB É\u2028İ Σß\x85 Z"
    some = spark.createDataFrame([(1, f"{line}\r\nQ"), (2, f"q\n{again}\n{line}"), (3, f"\t{again}"), (5, None), (6, "ÉÉ\néé\n")], "doc_id long, text string")
    for size in (500_000, 1):
        got = line_dedup.line_dedup(some, min_chars=2, min_docs=2, shard_keys=size)
        assert sorted(map(tuple, got.collect()), key=key) == [(1, "Q", 2, 1), (2, "q", 3, 2), (3, f"\t{again}", 1, 0), (5, "", 1, 0), (6, "ÉÉ\néé\n", 3, 0)]


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 2**64, 5000, np.uint64)
    sizes, bits = line_dedup.build_mph(keys)
    assert sorted(line_dedup.probe_mph(keys, sizes, bits, np.cumsum(bits) - 1)) == list(range(5000))


def test_lines_that_share_their_keys():
    p = np.array([5, 6, 7], np.uint64)
    h = np.array([1, 0, 3], np.uint64)
    h[1] = h[0] ^ common.mix(p[:1])[0] ^ common.mix(p[1:2])[0]
    rows = line_dedup.pd.DataFrame({"h": h.view(np.int64), "print": p.view(np.int64), "n": [5, 6, 7], "last": [1.0, 2.0, None], "shard": [0, 0, 0]})
    shard = line_dedup.Shard(line_dedup.build_shard(rows).to_dict("records")[0])
    assert shard.salt > 0 and shard.dropped(h, p, np.array([9, 2, 9]), 5).tolist() == [True, False, True]


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, blanks):
    r = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\xa0", "'s", "1", "é", "é", "!", "<|endoftext|>", "\x1c", "\x85", "Σ", "中", "​", "\r\n", "İ", "😀", "abc,", "x.", "\0", "\0ab"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    want = [x.ids + [0] for x in t.encode_batch(texts, add_special_tokens=False)]
    e = tokens.Encoder(P.path(name), blanks, most_words=700)
    assert [x.tolist() for i in range(0, 3000, 100) for x in e.encode(texts[i : i + 100])] == want


def test_packing(docs, rows, none):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, x, *_ in rows:
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, s, len(ids[s : s + 512]), zlib.crc32(ids[s : s + 512].tobytes())) for k, s in enumerate(range(0, len(ids), 512))]
    got = packing.best_fit_packing(docs, P.path("word_bpe_49k.json"), 512).collect()
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        ends = list(itertools.accumulate((n for _, n in sorted(parts)), initial=0))
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 512
    assert len(bins) <= -(-sum(w[3] for w in want) // 512) + 1
    assert packing.best_fit_packing(none, P.path("word_bpe_49k.json")).count() == 0


def test_placing_keeps_no_encoders(spark, docs):
    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(not isinstance(k, str) for k in common.worker_state())])], names=["n"])

    limits = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # so that each worker places
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        packing.best_fit_packing(docs, P.path("word_bpe_49k.json"), 512).collect()
        assert {r.n for r in spark.range(0, 24, 1, 24).mapInArrow(held, "n long").collect()} == {0}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_fillings_are_all_that_are_undominated():
    r = random.Random(6)
    for _ in range(30):
        counts = np.bincount([r.randint(3, 14) for _ in range(7)], minlength=31)
        items = [i for i, k in enumerate(counts.tolist()) for _ in range(k)]
        every = {c for k in range(8) for c in itertools.combinations(items, k) if sum(c) <= 30}
        every = {tuple(sorted(c, reverse=True)) for c in every}
        got = [x for x in packing.fillings(30, counts) if x is not None]
        assert len(set(got)) == len(got) and set(got) <= every and [sum(x) for x in got] == sorted((sum(x) for x in got), reverse=True)
        assert all(any(packing.covers(x, c) for x in got) for c in every)


def test_bins_of_short_lengths():
    r = np.random.default_rng(1)
    for low, high, n, most in ((300, 400, 20_000, 1.05), (400, 700, 20_000, 1.011), (20, 60, 2000, 1.0)):
        counts = np.bincount(r.integers(low, high + 1, n), minlength=2049)
        plan = packing.bin_completion(counts)
        used = np.zeros(2049, int)
        for x, k in plan:
            assert sum(x) <= 2048
            np.add.at(used, list(x), k)
        assert (used == counts).all() and sum(k for _, k in plan) <= most * packing.lower_bound(counts)


def test_bin_completion_is_near_the_bound():
    r = np.random.default_rng(0)
    for n in (30, 2000, 50_000):
        counts = np.bincount(np.clip(r.lognormal(6, 1, n).astype(int), 1, 2048), minlength=2049)
        plan = packing.bin_completion(counts)
        used = np.zeros(2049, int)
        for filled, times in plan:
            assert sum(filled) <= 2048
            np.add.at(used, list(filled), times)
        assert (used == counts).all()
        assert sum(t for _, t in plan) <= packing.lower_bound(counts) * 1.01 + 1


def test_bins_of_small_cases_are_the_fewest(spark):
    r = random.Random(8)

    def fewest(items, capacity):
        """By trying every bin for every item."""
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity and bins[k] not in bins[:k]:
                    go(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    for _ in range(60):
        items = sorted((r.randint(1, 30) for _ in range(r.randint(1, 10))), reverse=True)
        plan = packing.bin_completion(np.bincount(items, minlength=31))
        assert sum(t for _, t in plan) == fewest(items, 30)


def test_shards(spark, docs, rows, none, tmp_path):
    path = P.path("byte_bpe_50k.json")
    shards = sstable.write_shards(docs, path, root=str(tmp_path / "s"), shards=4)
    t, start, want = Tokenizer.from_file(path), 0, []
    for i, x, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, sstable.read_shards(shards, sstable.crc_of).collect()), key=key) == sorted(want, key=key)
    found = 0
    for r in shards.collect():
        fs, name = common.open_shared(r.path)
        reader = sstable.Reader(fs.open_input_file(name))
        held = list(reader)
        assert [i for i, _ in held] == sorted((i for i, _ in held), key=lambda i: (i is not None, i or 0))
        for i, ids in held:
            assert any((x == ids).all() for x in reader.get(i) if len(x) == len(ids))
        assert reader.get(10**15) == []
        found += len(held)
    assert found == len(rows)
    assert sstable.read_shards(sstable.write_shards(none, path), sstable.crc_of).count() == 0


def test_shards_of_one_doc_id(spark, tmp_path):
    """Documents that all share an id, or have none, are spread over the shards."""
    path = P.path("byte_bpe_50k.json")
    for i in (7, None):
        df = spark.createDataFrame([(i, f"{k} text") for k in range(400)], "doc_id long, text string").repartition(4)
        shards = sstable.write_shards(df, path, root=str(tmp_path / f"s{i}"), shards=4).cache()
        back = sstable.read_shards(shards, sstable.crc_of).collect()
        assert shards.count() == 4 and len(back) == 400 and {r.doc_id for r in back} == {i}
        starts = sorted((r.start, r.n_tokens) for r in back)
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_a_hot_line_is_looked_up_by_many_tasks(spark, monkeypatch):
    hot = "this line stands in a third of all documents of the table"
    rows = [(i, f"{hot}\nown line {i} of this document, which nobody else has" if i % 3 == 0 else f"a line that document {i % 50} and some others hold, thirty of them") for i in range(900)]
    df = spark.createDataFrame(rows + [(5, hot), (5, hot), (None, hot)], "doc_id long, text string").repartition(5)
    want = sorted(map(tuple, line_dedup.line_dedup(df).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key)
    monkeypatch.setattr(line_dedup, "TASK_LINES", 40)
    found = line_dedup.repeated(df, 40, 5)
    tasks = {r["_shard"]: r["tasks"] for r in line_dedup.tasks_of(found, 7).collect()}
    assert max(tasks.values()) >= 8 and found.count() == 51
    got = sorted(map(tuple, line_dedup.line_dedup(df, shard_keys=5).select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key)
    assert got == want and sum(r[3] for r in want) > 800


def test_language(spark, none):
    r = random.Random(2)
    words = {"en": "the and with that this have from they would there".split(), "fr": "les des une avec pour dans sont cette leur être".split()}
    data = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randint(3, 40))), lang) for i in range(400) for lang in (r.choice(["en", "fr"]),)]
    odd = [(1000, None, "en"), (1001, "12 34 !", "fr"), (1002, "", None), (None, "avec les dans", None), (7, data[7][1], data[7][2])]
    df = spark.createDataFrame([(i, t, lang, "s", 0, "x", "y", "z") for i, t, lang in data + odd], SCHEMA).repartition(3)
    got = language_id.language_id(df)
    assert set(got.columns) == set(df.columns) | {"lang_pred", "score", "held_out"}
    out = {r.doc_id: r for r in got.collect()}
    assert np.mean([out[i].lang_pred == lang for i, _, lang in data if out[i].held_out]) > 0.97
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[None].lang_pred == "fr"
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, *_ in data) and all(0 <= r.score <= 1 for r in out.values())
    assert language_id.language_id(none).count() == 0
    assert {r.lang_pred for r in language_id.language_id(df.withColumn("lang", df.lang.substr(9, 1)).replace("", None, "lang")).collect()} == {"und"}


def test_equal_probabilities_give_the_first_language(spark):
    model = {"names": ["de", "fr"], "idf": np.ones(1 << language_id.BITS), "w": np.zeros(((1 << language_id.BITS) + 1, 2), np.float32), "t": 1.0}
    out = language_id.predict(spark.createDataFrame([("a text",), (None,)], "text string"), model).collect()
    assert [(x.lang_pred, x.score) for x in out] == [("de", 0.5), ("und", 0.0)]


def test_language_features():
    """n-grams counted by name, then by the buckets of their hashes."""
    table, mask = language_id.letters(), 2**32 - 1
    scramble = lambda h: h ^ h >> 15
    for text in ("Ab c, d!", "É1é  x", "a", "\n\nZ😀z\t", "𝔘𝔫i", "l'été -- 12 été"):
        cleaned = "".join(c if c.isalpha() else " " for c in text.lower())
        cleaned = " " + re.sub("  +", " ", cleaned) + " "
        want = np.zeros(1 << language_id.BITS, np.int64)
        for n in (1, 2, 3):
            for i in range(len(cleaned) - n + 1):
                c = [ord(x) for x in cleaned[i : i + n]]
                one = [x * 0x9E3779B1 & mask for x in c]
                h = one[0]
                if n > 1:
                    h = (scramble(one[0]) * 0x85EBCA77 + one[1]) & mask
                if n > 2:
                    h = ((h ^ h >> 13) * 0xC2B2AE3D + one[2]) & mask
                h = h * {1: 1, 2: 0x27D4EB2F, 3: 0x165667B1}[n] & mask
                want[h >> 32 - language_id.BITS] += 1
        cols, counts = language_id.ngrams(text, table)
        got = np.zeros_like(want)
        got[cols] = counts
        assert (got == want).all(), text
    idf = np.linspace(1, 2, 1 << language_id.BITS)
    x = language_id.weigh(np.array([3, 9]), np.array([1, 4]), idf)
    raw = np.array([idf[3], (1 + np.log(4)) * idf[9]])
    assert np.allclose(x, raw / np.sqrt((raw * raw).sum()))


def test_ftrl_against_plain_steps():
    """Follow-the-regularised-leader with elastic net, one number at a time."""
    r, size, classes = random.Random(4), 12, 3
    alpha, beta, l1, l2, epochs = 0.7, 1.1, 0.02, 0.05, 3
    rows = []
    for _ in range(60):
        y = r.randrange(classes)
        cols = sorted(r.sample(range(size), r.randint(1, 4)) + [])
        rows.append((np.array(cols), np.array([r.uniform(0.1, 1) + (c % classes == y) for c in cols]), y))
    z, n, w = ([[0.0] * classes for _ in range(size + 1)] for _ in range(3))
    for _ in range(epochs):
        for cols, x, y in rows:
            pairs = [*zip(cols.tolist(), x.tolist()), (size, 1.0)]
            logits = [sum(v * w[c][k] for c, v in pairs) for k in range(classes)]
            e = [math.exp(a - max(logits)) for a in logits]
            p = [a / sum(e) for a in e]
            for c, v in pairs:
                for k in range(classes):
                    g = v * (p[k] - (k == y))
                    sigma = (math.sqrt(n[c][k] + g * g) - math.sqrt(n[c][k])) / alpha
                    z[c][k] += g - sigma * w[c][k]
                    n[c][k] += g * g
                    lead = max(abs(z[c][k]) - l1, 0.0)
                    w[c][k] = -math.copysign(lead, z[c][k]) / ((beta + math.sqrt(n[c][k])) / alpha + l2)
    got = language_id.fit_ftrl(rows, classes, size, alpha, beta, l1, l2, epochs)
    assert np.allclose(got, w, atol=1e-12) and (got != 0).all()
    sparse = language_id.fit_ftrl(rows, classes, size, alpha, beta, 3.0, l2, epochs)
    assert 0 < (sparse == 0).sum() < sparse.size
    strong = language_id.fit_ftrl(rows, classes, size, alpha, beta, 1e6, l2, epochs)
    assert not strong.any()  # the L1 penalty leaves nothing


def test_temperature_against_a_grid():
    r = np.random.default_rng(3)
    y = r.integers(0, 3, 400)
    for sharp in (0.2, 1.0, 5.0):
        logits = sharp * (1.5 * np.eye(3)[y] + r.normal(size=(400, 3)))
        loss = lambda t: np.mean([-math.log(max(math.exp(a[k] / t) / sum(math.exp(b / t) for b in a), 1e-12)) for a, k in zip(logits.tolist(), y)])
        grid = np.exp(np.linspace(math.log(0.05), math.log(15), 250))
        best = min(map(float, grid), key=loss)
        t = language_id.fit_temperature(logits, y)
        assert abs(math.log(t / best)) < 0.03 and loss(t) <= loss(best) + 1e-9
    assert language_id.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def brute_near(rows, k, percent):
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(parent, 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            parent[max(top(a), top(b))] = min(top(a), top(b))
    return sets, {i: top(i) for i in parent} | {None: None}


@pytest.mark.parametrize("k,outer,inner", [(2, 1000, 10_000), (5, 1000, 10_000), (2, 3, 4)])
def test_near_documents(spark, docs, rows, none, k, outer, inner, monkeypatch):
    monkeypatch.setattr(near_dedup, "OUTER_ROWS", outer)
    monkeypatch.setattr(near_dedup, "INNER_ROWS", inner)
    r = random.Random(9)
    base = [f"w{r.randint(0, 300)}" for _ in range(150)]
    extra = []
    for j in range(70):  # one large group of near copies around a text, some just below the threshold
        w = list(base)
        for _ in range(r.randint(0, 22 // k)):
            w[r.randrange(len(w))] = f"v{r.randint(0, 9999)}"
        extra.append((2000 + j, " ".join(w), "en", "a", 0, "x", "y", "z"))
    df = docs.unionByName(spark.createDataFrame(extra, SCHEMA))
    sets, component = brute_near(rows + extra, k, 80)
    got = near_dedup.near_duplicates(df, k).collect()
    assert len(got) == len(rows) + len(extra)
    for g in got:
        assert g.component_id == component[g.doc_id] and g.kept == (g.doc_id == component[g.doc_id])
        assert g.n_shingles in {len(s) for s in sets[g.doc_id]}
    assert near_dedup.near_duplicates(none).count() == 0


def test_word_hashes_beyond_the_table():
    t = near_dedup.tables()
    whole = near_dedup.word_hashes(("ab cd " * 200_000 + "x" * 1_100_000 + " ab").encode(), t)
    assert len(whole) == 400_002 and len(set(whole.tolist())) == 3 and whole[-1] == whole[0]


@pytest.mark.parametrize("small,tile", [(200, 1000), (4, 7)])
def test_near_vectors(spark, small, tile, monkeypatch):
    monkeypatch.setattr(itq, "SMALL", small)
    monkeypatch.setattr(itq, "TILE_ROWS", tile)
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 16))
    x[100:200] = x[:100] + r.normal(size=(100, 16)) * 0.25
    x[200:230] = x[0]
    data = [(i, [float(v) for v in row], int(i % 3)) for i, row in enumerate(x)]
    data += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [1.0] * 8, 1), (905, [1.0] * 8, 1), (906, [1.0] * 8, None), (None, [1.0] * 8, 1), (907, [float(v) * 3 for v in x[1]], 1)]
    data += [(910 + i, [float(v) * m for v in x[i]], int(i % 3)) for i, m in ((2, 1e200), (3, 1e-200), (4, 1e300), (5, 1e-310))] + [(920, [1e308, -1e308] + [0.0] * 14, 2)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<double>, label int, score string")
    ok = {i: np.array(v) / np.abs(v).max() for i, v, label in data if i is not None and label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    labels = {i: label for i, _, label in data}
    links, parent = dict.fromkeys([i for i, *_ in data], 0), {i: i for i, *_ in data}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ok, 2):
        u, v = ok[a], ok[b]
        if labels[a] == labels[b] and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
            links[a] += 1
            links[b] += 1
            parent[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.vec_id: r for r in itq.near_vectors(df).collect()}
    assert len(got) == len(data) and sum(links.values()) > 300
    assert {i: r.n_links for i, r in got.items()} == links
    assert all(r.component_id == (None if i is None else top(i)) for i, r in got.items())
    assert itq.near_vectors(df.limit(0)).count() == 0


def test_a_rotation_is_learned_in_one_array():
    x = np.random.default_rng(6).normal(size=(4000, 12))
    x[:50], x[:, 3] = 0, 0  # products that are zero, of either sign
    r = np.linalg.qr(np.random.default_rng(11).normal(size=(12, 12)))[0]
    for _ in range(30):
        u, _, w = np.linalg.svd(x.T @ np.where(x @ r >= 0, 1.0, -1.0))
        r = u @ w
    itq.learn_rotation(x[:50], np.random.default_rng(11))
    tracemalloc.start()
    got = itq.learn_rotation(x, np.random.default_rng(11))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, r) and peak < 1.6 * x.nbytes


def test_rotations_are_dealt_to_tasks(spark, monkeypatch):
    x = itq.unit_rows(np.random.default_rng(4).normal(size=(200, 6)))
    whole = itq.learn_some(x, 0, 5, np.random.default_rng(11))
    rng = np.random.default_rng(11)
    assert all(np.array_equal(a, itq.learn_rotation(x, rng)) for a in whole)
    assert np.array_equal(np.stack(whole[2:4]), itq.learn_some(x, 2, 4, np.random.default_rng(11)))
    tasks = itq.dealt([2, 64, 100], 480)
    assert max((end - first) * d for d, first, end in tasks if d < 65) <= itq.COLUMNS and all(end - first == 1 for d, first, end in tasks if d > 32)
    for d, turns in ((2, 240), (64, 8), (100, 5)):
        assert [i for k, first, end in tasks if k == d for i in range(first, end)] == list(range(turns))
    assert itq.dealt([], 480) == []
    r = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r.normal(size=16 if i % 4 else 8)], i % 2) for i in range(60)]
    rows += [(100 + i, [v * 2 + 0.1 for v in e], k) for i, e, k in rows[:30]] + [(200, None, 1), (201, [0.0] * 16, 1), (202, [1.0] * 16, None), (None, [1.0] * 16, 1), (203, [], 0), (204, [1.0], 0), (205, [5.0], 0)]
    df = spark.createDataFrame(rows + rows, "vec_id long, embedding array<double>, label int")
    seen, run = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: (seen.extend([self.count()] * (schema == itq.MODEL)), run(self, f, schema))[1])
    monkeypatch.setattr(type(df.groupBy()), "applyInPandas", None)  # the sample is read from its files, not shuffled to its tasks
    got = []
    for columns in (16, 10**9):
        monkeypatch.setattr(itq, "COLUMNS", columns)
        got.append(sorted(map(tuple, itq.near_vectors(df).collect()), key=key))
    assert got[0] == got[1] and len(got[0]) == 2 * len(rows) and sum(x[1] > 1 for x in got[0]) > 20
    assert len(seen) == 2 and seen[0] > 20 and seen[1] == 3


@pytest.mark.parametrize("share", [0.7, 0.9])
def test_near_vectors_around_a_large_mean(spark, share):
    r = np.random.default_rng(8)
    d, n = 32, 1500
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = np.sqrt(1 - share) * unit(r.normal(size=(n, d)))
    x[:, 0] = np.sqrt(share)
    x = unit(x)
    u = r.normal(size=x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.9305 * x + np.sqrt(1 - 0.9305**2) * u])
    cos = x @ x.T
    want = (cos >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {y.vec_id: y.n_links for y in itq.near_vectors(df).collect()}
    assert want.sum() >= 2 * n and sum(got.values()) >= 0.9995 * want.sum()
    assert all(got[i] <= want[i] for i in range(len(x)))


def test_personal_data(spark, none):
    r = random.Random(3)
    parts = [*"0123456789", "@", ".", "-", " ", "+", "(", ")", "a", "b.c", "😀", "é", "1.2.3.4", "a@b.c", "4111111111111111", "%", "_"]
    data = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 40)))) for i in range(1500)] + [(5000, None), (5001, ""), (5002, "a." * 20000 + "x@" + "b." * 9000 + "c 1" + ".1" * 20000), (7, "a@b.cd")]
    data += [(7000 + i, f"write mail: {x}@ex{i}.com now") for i, x in enumerate("abcdefghijkl")] + [(7100, "write mail: joe@localhost now, mail: v2 yes")]
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in data], SCHEMA)
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")

    def good(rank, v):
        d = re.sub("[^0-9]", "", v)
        if rank == 1:
            return all(int(x) <= 255 for x in v.split("."))
        if rank == 2:
            return 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return rank == 0 or 10 <= len(d) <= 15

    want = sorted(((i, sorted((m.start(), k, m.end(), m[0]) for k, p in enumerate(patterns) for m in re.finditer(p, t or "") if good(k, m[0]))) for i, t in data), key=str)
    out = pii.personal_data(df).collect()
    assert sorted(((r.doc_id, [tuple(x) for x in r.base]) for r in out), key=str) == want
    assert [x.value for r in out if r.doc_id == 7100 for x in r.added] == ["joe@localhost"]
    assert pii.personal_data(none).count() == 0


def test_personal_data_is_found_by_contexts_and_forms(spark):
    r = random.Random(5)
    number = lambda: f"+1 ({r.randint(200, 999)}) 555-{r.randint(0, 9999):04d}"
    key40 = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"some {r.randint(1, 10**9)}x call {number()} or" for _ in range(30)] + [f"w{i} token = \"{key40()}\" and" for i in range(20)]
    texts += ["now +1 (269) 555-3296 4524132264652876 and", "a token = \"0a1b2c3d4e5f6\" here", "version 2.0, of 1999 and 12 34", None, ""]
    texts += [f"pay {c} now" for c in ("4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220", "378282246310005", "6011111111111117")]
    out = {x.doc_id: x for x in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(len(out[i].base) == 1 and not out[i].added for i in range(30)) and all(len(out[i].secrets) == 1 for i in range(30, 51 + 1) if i != 50)
    mixed = out[50]
    assert not mixed.base and [(x.rank, x.value) for x in mixed.added][:1] == [(3, "+1 (269) 555-3296")]
    assert all(texts[50][x.start : x.end] == x.value for x in mixed.added)
    assert [x.value for x in out[51].secrets] == ["0a1b2c3d4e5f6"]
    assert not any(out[i].base or out[i].added or out[i].secrets for i in (52, 53, 54))


def test_personal_data_in_texts_of_many_hits(spark):
    one = "to a.b@ex.com, 10.0.0.1 or +1 (279) 555-0216 x9\n"
    x = pii.personal_data(spark.createDataFrame([(1, one * 8000)], "doc_id long, text string")).select("base").first().base
    assert len(x) == 24_000 and (x[-1].start, x[-1].end) == (len(one) * 7999 + one.index("+"), len(one) * 7999 + one.index(" x9"))


def test_hidden_seeds_are_found_again(spark):
    """A tenth of the seeds is hidden; contexts and forms find most of them, and no number that only looks like a card."""
    r = random.Random(9)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    key40 = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    texts = [f"word{i} mail: user{i}@host{i}.example.org for more" for i in range(150)] + [f"w{i} token = {key40()} and" for i in range(150)]
    texts += [f"{r.choice('abc')} call +1 ({r.randint(200, 999)}) 555-{digits(4)} or" for _ in range(150)] + [f"order {digits(16)} of" for _ in range(300)]
    got = {x.kind: x for x in pii.recovered(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for kind in ("email", "secret", "phone"):
        assert got[kind].hidden >= 8 and got[kind].found == got[kind].hidden and got[kind].wrong == got[kind].other == 0
    assert got["card"].other == got["card"].wrong == 0


def test_competing_spans(spark):
    """The first, then the better stays; the time is linear in the spans."""
    import time

    spans = [(0, 1, 5, "a"), (0, 3, 9, "b"), (4, 1, 6, "c"), (5, 2, 7, "d"), (8, 0, 9, "e")]
    kind = pii.SPAN.replace("struct<", "array<struct<") + ">"
    df = spark.createDataFrame([(spans,), ([],), (spans[:1],)], f"s {kind}")
    assert [[x.value for x in row.k] for row in df.select(pii.apart(pii.F.col("s")).alias("k")).collect()] == [["a", "d", "e"], [], ["a"]]
    many = pii.F.transform(pii.F.sequence(pii.F.lit(1), pii.F.col("n")), lambda i: pii.F.struct((i * 3).alias("start"), pii.F.lit(1).alias("rank"), (i * 3 + 4).alias("end"), pii.F.lit("v").alias("value")))
    began = time.time()
    rows = spark.createDataFrame([(16_000,), (64_000,)], "n int").select("n", pii.F.size(pii.apart(many)).alias("k")).collect()
    assert [(x.n, x.k) for x in rows] == [(16_000, 8000), (64_000, 32_000)] and time.time() - began < 15


def test_secrets_are_spans(spark):
    key = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    df = spark.createDataFrame([(1, f"of token = {key} a@b.cd end"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.personal_data(df).select("doc_id", pii.written(pii.F.sort_array(pii.F.concat("base", "added", "secrets"))).alias("spans")).collect()}
    assert out[1].spans == "secret:11:51,email:52:58" and out[2].spans == ""


def test_mixing(spark, docs, rows, none):
    out = mixing.mixture(docs, max_repeats=3.0, entropy_share=1.0).collect()
    tokens_of = {}
    for _, t, _, s, *_ in rows:
        tokens_of[s] = tokens_of.get(s, 0) + 1 + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.n_tokens
    total = sum(tokens_of.values())
    for s, n in tokens_of.items():
        assert taken[s] <= 3.0 * n + 5001
        assert abs(taken[s] - min(total / len(tokens_of), 3.0 * n)) < 0.3 * total
    copies = {}
    for r in mixing.mixed(docs, max_repeats=3.0, entropy_share=1.0).collect():
        copies[r.doc_id, r.text] = copies.get((r.doc_id, r.text), 0) + 1
    whole = {}
    for r in out:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + 1
    by_id = {}
    for (i, _), n in copies.items():
        by_id[i] = by_id.get(i, 0) + n
    assert by_id == whole
    assert mixing.mixture(none).count() == 0 and mixing.mixed(none).columns == none.columns


def test_spots(spark, docs, rows, none):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    out = spotsigs.edited(docs).collect()
    assert len(out) == len(rows)
    prints = {}
    for r in out:
        prints.setdefault(r.text, set()).add((r.fp.n, tuple(r.fp.spots), tuple(r.fp.words)))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert all(len(x) == 1 for x in prints.values())
    ids = [r[0] for r in order]
    got = {r.doc_id: r for r in out}
    for (i, t, *_), (j, u, *_) in zip(order, order[1:] + order[:1]):
        if ids.count(i) == 1 and ids.count(j) == 1:
            t, u = t or "", u or ""
            k = len(t) // 3
            assert got[i].edited == t[: len(t) - k] + u[:k] and got[i].n_chars == len(t)
    assert spotsigs.edited(none).count() == 0
    pairs = {(r.a, r.b): r.likeness for r in spotsigs.near_pairs(docs).collect()}
    assert all(v >= 0.8 for v in pairs.values())
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(tuple(map(frozenset, plain_spots(t or ""))), []).append(i)
    want = {tuple(sorted((min(i), min(j)))) for (x, i), (y, j) in itertools.combinations(sets.items(), 2) if plain_likeness(x, y) >= 0.8}
    assert {tuple(sorted(p)) for p in pairs} == want and len(want) > 2


def test_spots_of_outlying_and_shared_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "BUCKET_ROWS", 5)
    ids = [*range(60), 10**15, -(2**63), 2**63 - 1, *[7] * 40, *[None] * 30]
    rows = [(i, f"text number {k} of the table") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = spotsigs.dealt(df.withColumn("th", spotsigs.F.xxhash64("text"))).cache()
    sizes = [r["count"] for r in dealt.groupBy("bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 20 and len(sizes) > 15
    order = [r.text for r in dealt.orderBy(spotsigs.F.desc_nulls_last("doc_id"), spotsigs.F.desc("th")).collect()]
    got = {r.text: r.edited for r in spotsigs.edited(df).collect()}
    for t, u in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        assert got[t] == t[: len(t) - k] + u[:k]


def plain_spots(text):
    """(spots, words if there are few spots) of a text, word by word."""
    words = regex.sub(r"[^\p{L}\p{N}]+", " ", text.lower()).split()
    content = [(words[i - 1] if i else None, w) for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    spots = {(a, w, content[k + 1][1]) for k, (a, w) in enumerate(content[:-1]) if a in spotsigs.ANCHORS}
    return spots, (set(words) or {("", text)}) if len(spots) < spotsigs.FEW else set()


def plain_likeness(x, y):
    kind = 1 if max(len(x[0]), len(y[0])) < spotsigs.FEW else 0
    return len(x[kind] & y[kind]) / len(x[kind] | y[kind])


def test_spots_against_plain_ones(spark):
    r = random.Random(10)
    vocabulary = ["the", "of", "der", "las", "alpha", "Été", "x1", "the", "b", "日本", "and,", "Gamma!", "a-b"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 90))) for _ in range(40)] + ["the", "the of alpha", "the alpha of beta", "", "?!", None]
    texts += [" ".join(r.choice(["the", "of", "in", *(f"w{r.randint(0, 40)}" for _ in range(4))]) for _ in range(n)) for n in (1500, 1500, 2500, 900)]
    texts += [texts[-1] + " the last words", "no common words here " * 30, "no common words here " * 29 + "but one"]
    for x in spotsigs.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        one, two, after = plain_spots(x.text), plain_spots(x.edited), plain_spots(texts[x.doc_id - 1] or "")
        assert (x.fp.n, x.edited_fp.n, len(x.fp.words)) == (len(one[0]), len(two[0]), len(one[1])), x.text
        assert x.near_edited == plain_likeness(one, two) and x.near_next == plain_likeness(one, after)


def test_spots_of_short_texts_around_the_line(spark):
    """A text with FEW spots and its copy with fewer are compared by spots; two short ones by words."""
    long = " ".join(f"the n{i} m{i}" for i in range(spotsigs.FEW))
    short = long.rsplit(" the ", 1)[0]
    for a, b, want in ((long, short, (spotsigs.FEW - 1) / spotsigs.FEW), (short, short + " more", None), ("", None, 1.0), ("...", "", 0.0)):
        df = spark.createDataFrame([(a or "", b or "")], "a string, b string")
        got = df.select(spotsigs.likeness(spotsigs.fingerprint(spotsigs.F.col("a")), spotsigs.fingerprint(spotsigs.F.col("b")))).first()[0]
        assert got == plain_likeness(plain_spots(a or ""), plain_spots(b or "")) and got == (want if want is not None else got)
    pairs = spotsigs.near_pairs(spark.createDataFrame([(1, long), (2, short), (3, short + " more"), (4, "une autre"), (5, None)], "doc_id long, text string"))
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 2), (1, 3), (2, 3)}


def test_long_runs_of_common_words_take_linear_time(spark):
    import time

    texts = ["alpha beta " + "the " * 200_000 + "last words", "of " * 150_000, ("the of in " * 30_000 + "a b c d ") * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    df.limit(0).collect()
    began = time.time()
    out = {r.doc_id: r for r in spotsigs.edited(df).select("doc_id", "fp", "near_edited").collect()}
    assert time.time() - began < 30  # 100 seconds for 20,000 where a run is looked over from each of its words
    assert out[0].fp.n == 1 and len(out[0].fp.words) == 5 and out[1].fp.n == 0


@pytest.mark.parametrize("hot", [2, 20_000])
def test_repeats(spark, none, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    r = random.Random(5)
    base = "".join(r.choice("abé d") for _ in range(3000))
    data = []
    for i in range(40):
        t = ""
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, 2500)
            t += r.choice([base[a : a + r.choice([100, 330, 400, 420, 700])], "".join(r.choice("abc ") for _ in range(r.randint(0, 500))), "be " * r.randint(1, 300), "a" * r.randint(1, 900)])
        data.append((i, t))
    data += [(200, None), (201, ""), (202, "x" * 399), (203, "y" * 400), (204, "z" * 401), (3, data[3][1]), (4, "another"), (None, base), (206, base)]
    seen = {}
    for _, t in data:
        b = (t or "").encode()
        for j in range(len(b) - 399):
            seen[b[j : j + 400]] = seen.get(b[j : j + 400], 0) + 1
    want = []
    for i, t in data:
        b = (t or "").encode()
        m = bytearray(len(b))
        for j in range(len(b) - 399):
            if seen[b[j : j + 400]] > 1:
                m[j : j + 400] = b"\1" * 400
        want.append((i, len(b), sum(m), len(re.findall(b"\1+", bytes(m))), bytes(x for x, y in zip(b, m) if not y)))
    df = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z") for i, t in data], SCHEMA).repartition(3)
    got = [(*tuple(x)[:4], bytes(x.kept)) for x in repeats.drop_repeats(df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert repeats.drop_repeats(none).count() == 0


def test_shared_passages(spark):
    r = random.Random(12)
    words = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage = words(200)
    texts = [" ".join(words(r.randint(0, 90)) + passage[a : a + n] + words(r.randint(0, 90))) for n in (51, 52, 60, 120, 30, 45, 35) for a in (r.randint(0, 80) for _ in range(6))]
    texts += [" ".join(words(5) + passage[:90]).upper().replace(" ", "\n"), " ".join(words(300)), None, "", " ".join(passage[:50]), " ".join(["same"] * 70)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.n_shared for x in repeats.drop_repeats(df).collect()}
    runs = lambda t, k: {tuple(w[j : j + k]) for w in ((t or "").lower().split(),) for j in range(len(w) - k + 1)}
    for i, t in enumerate(texts):
        long, short = (any(runs(t, k) & runs(u, k) for j, u in enumerate(texts) if i != j) for k in (51, repeats.SHARED))
        assert got[i] > 0 if long else short or got[i] == 0
    assert sum(x > 0 for x in got.values()) > 20 and got[len(texts) - 1] == 0


def test_repeats_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.sql("""
        with b as (select doc_id, encode(coalesce(text, '')) as raw from documents),
        w as (select doc_id, unnest(range(0, octet_length(raw) - 399)) as i, raw from b where octet_length(raw) >= 400),
        h as (select doc_id, i, md5(raw[i + 1 : i + 400]) as h from w),
        s as (select h.doc_id, h.i from h join (select h from h group by h having count(*) > 1) using (h)),
        m as (select distinct doc_id, unnest(range(i, i + 400)) as p from s),
        r as (select doc_id, p, lag(p) over (partition by doc_id order by p) as q from m)
        select b.doc_id, cast(octet_length(raw) as bigint), count(p), count(*) filter (where p is not null and q is distinct from p - 1)
        from b left join r on b.doc_id = r.doc_id group by b.doc_id, raw
    """).fetchall()
    got = registry.queries()["op10_repeats"](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans").collect()
    assert sorted(map(tuple, got)) == sorted(want) and sum(x[2] for x in want) > 1000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200}


def test_pipeline_against_its_stages(spark, rows, tmp_path):
    """Every stage keeps what a plain version of it keeps."""
    folder = tmp_path / "in"
    spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(folder / "documents.parquet"))
    docs = spark.read.parquet(str(folder / "documents.parquet"))
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = common.cut(stage(spark, docs, str(folder)))
        assert docs.columns == names
        after = docs.collect()
        if name == "language_id":
            assert {r.text for r in before} - {r.text for r in after} >= {None, "", " ", "\n\n", "..."}
        if name == "line_dedup":
            assert len(after) == len(before) and sum(LONG in (r.text or "").lower() for r in after) == 1
        if name == "near_dedup":
            _, component = brute_near([tuple(r) for r in before], 5, 80)
            assert {r.doc_id for r in after} == {i for i, c in component.items() if i == c and i in {r.doc_id for r in before}}
        if name == "mixing":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(folder))
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(folder)).count() == packed.count()


CLASHING = ("passes", "cut", "_s", "_n", "_d", "_t", "_salt", "_gone", "lang_pred", "score", "held_out", "n_lines", "n_dropped", "key", "row", "set_aside", "text_")


def test_columns_of_clashing_names_travel(spark, rows):
    few = [r[:5] for r in rows[:30]] + [(900, None, None, None, 0), (901, "", "en", None, 0)]
    df = spark.createDataFrame([(*r, *[f"{c}{i}" for c in CLASHING]) for i, r in enumerate(few)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns, name
        want = {tuple(r)[5:] for r in df.collect()}
        assert {tuple(r)[5:] for r in out.collect()} <= want, name
    for op in (line_dedup.line_dedup, language_id.language_id, pii.personal_data, near_dedup.near_duplicates, repeats.drop_repeats, spotsigs.edited, mixing.mixture):
        assert op(df).count() >= 20
    assert sorted(r["_gone"] for r in line_dedup.line_dedup(df, 1, 2, 1).select("_gone").collect()) == sorted(f"_gone{i}" for i in range(len(few)))


def test_columns_with_a_dot_in_their_names_travel(spark, rows):
    few = [r[:5] for r in rows[:30]] + [(900, None, None, None, 0)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "d.doc_id", "text.", "`", "set_aside", "n_lines"]
    df = spark.createDataFrame([(*r, *[f"{c}{i}" for c in names[5:]]) for i, r in enumerate(few)], "doc_id long, text string, lang string, source string, n_chars long, `d.doc_id` string, `text.` string, ```` string, set_aside string, n_lines string")
    plain = df.select("doc_id", "text", "lang", "source", "n_chars")
    shape = lambda out, at: sorted(str([r[c] for c in at]) for r in out.collect())
    want = {r["doc_id"]: tuple(r)[5:9] for r in df.collect()}
    for op, added in ((language_id.language_id, ["held_out", "lang_pred", "score"]), (line_dedup.line_dedup, ["n_lines", "n_dropped"]), (lambda d: line_dedup.line_dedup(d, 1, 2, 1), ["n_lines", "n_dropped"])):
        out = op(df)
        assert out.columns == [c for c in names if c not in added] + added
        assert {r["doc_id"]: tuple(r)[5:9] for r in out.collect()} == want
        assert shape(out, ["doc_id", "text", *added]) == shape(op(plain), ["doc_id", "text", *added])
    for op in (pii.personal_data, near_dedup.near_duplicates, repeats.drop_repeats, spotsigs.edited, mixing.mixture):
        assert op(df).count() >= 20
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        assert out.count() >= 1 and (name == "packing" or out.columns == names), name


def test_names():
    names = registry.queries()
    assert [n.split("_")[0] for n in sorted(names, key=lambda n: int(re.sub(r"\D", "", n.split("_")[0])))] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.oracle_sql()) == {"op5_mixing", "op6_near_dedup", "op7_near_vectors", "op8_line_dedup", "op11_importance", "op12_hilbert_shards", "op13_filter_audit"}
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0") and queries.vocabulary("word_bpe_49k.json").endswith(".json")
