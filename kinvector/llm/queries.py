"""One query for each numbered operator, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinvector.llm import line_dedup as lines
from kinvector.llm import filter_audit, importance, itq, language_id, mixing, near_dedup, packing, pii, repeats, sharding, spotsigs, sstable
from kinvector.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_personal_data(spark, sf_dir):
    out = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = [pii.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in pii.KINDS]
    spans = pii.written(F.sort_array(F.concat("base", "added", "secrets")))
    more = [F.size("added").cast("long").alias("n_added"), F.size("secrets").cast("long").alias("n_secret"), F.size(F.concat("base", "added", "secrets")).cast("long").alias("n_found")]
    return out.select("doc_id", *counts, F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans.alias("spans"), *more)


def op2_best_fit_packing(spark, sf_dir):
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op4_token_shards(spark, sf_dir):
    shards = sstable.write_shards(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return sstable.read_shards(shards, sstable.crc_of)


def op5_mixing(spark, sf_dir):
    return mixing.mixture(table(spark, sf_dir, "documents"))


OP5 = r"""
with recursive d as (
  select doc_id, source, 1 + coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as n_tokens from documents
), s as (
  select source, cast(sum(n_tokens) as double) as tokens from d group by source
), t as (
  select sum(tokens) as total, count(*) as n, cast(0.95 as double) * ln(count(*)) as goal from s
), even(i, low, high) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select i + 1, case when h >= goal then (low + high) / 2 else low end, case when h >= goal then high else (low + high) / 2 end
  from (select i, low, high, goal,
               (select ln(sum(pow(tokens / total, (low + high) / 2))) - sum(pow(tokens / total, (low + high) / 2) * ln(pow(tokens / total, (low + high) / 2))) / sum(pow(tokens / total, (low + high) / 2)) from s) as h
        from even, t where i < 30)
), few(i, low, high) as (
  select 0, cast(0 as double), cast(1 as double)
  union all
  select i + 1, case when r <= 4 then low else (low + high) / 2 end, case when r <= 4 then (low + high) / 2 else high end
  from (select i, low, high, (select max(pow(tokens / total, (low + high) / 2) / (tokens / total)) / sum(pow(tokens / total, (low + high) / 2)) from s) as r
        from few, t where i < 30)
), ends as (
  select (select ln(sum(1)) >= max(goal) from s, t) as even0,
         (select -sum(tokens / total * ln(tokens / total)) >= max(goal) from s, t) as even1,
         (select max(total / tokens) / count(*) <= 4 from s, t) as few0
), alpha as (
  select greatest(case when even1 then 1 when not even0 then 0 else (select low from even where i = 30) end,
                  case when few0 then 0 else (select high from few where i = 30) end) as a from ends
), w as (
  select source, cast(tokens as bigint) as tokens,
         cast(round(pow(tokens / total, a) / (select sum(pow(tokens / total, a)) from s, t, alpha) * total) as bigint) as target
  from s, t, alpha
), p as (
  select doc_id, d.source, n_tokens, tokens, target, epoch, md5('7:' || epoch || ':' || doc_id) as key
  from d join w on d.source = w.source, lateral (select unnest(range(0, target // tokens + 1)) as epoch)
), q as (
  select *, epoch * tokens + coalesce(sum(n_tokens) over (partition by source, epoch order by key rows between unbounded preceding and 1 preceding), 0) as start from p
), b as (
  select greatest(1, -(-sum(target) // 1048576)) as blocks from w
)
select doc_id, source, n_tokens, cast(epoch as int) as epoch, cast(floor(start * blocks / target) as bigint) as block from q, b where start < target
"""


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


OP6 = r"""
with recursive w as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w
), n as (
  select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as same from s group by doc_id
), rep as (
  select same, min(doc_id) as rep, any_value(n) as n from n group by same
), t as (
  select rep.rep as doc_id, s.s, rep.n from s join rep on s.doc_id = rep.rep
), f as (
  select s, count(*) as k from t group by s
), o as (
  select doc_id, t.s, n, row_number() over (partition by doc_id order by k, t.s) as place from t join f on t.s = f.s
), p as (
  select doc_id, s, n from o where place <= n - ceil(n * 0.8 - 1e-9) + 1
), c as (
  select distinct a.doc_id as u, b.doc_id as v, a.n + b.n as both_n from p a join p b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), link as (
  select c.u, c.v from c join t a on a.doc_id = c.u join t b on b.doc_id = c.v and a.s = b.s group by c.u, c.v, both_n having 100 * count(*) >= 80 * (both_n - count(*))
), e as (
  select u, v from link union select v, u from link union select n.doc_id, rep from n join rep on n.same = rep.same union select rep, n.doc_id from n join rep on n.same = rep.same
), reach(u, v) as (
  select doc_id, doc_id from documents union select r.u, e.v from reach r join e on r.v = e.u
), m as (
  select u, min(v) as m from reach group by u
)
select documents.doc_id, coalesce(n.n, 0) as n_shingles, m as component_id, documents.doc_id = m as kept
from documents join m on documents.doc_id = m.u left join n on n.doc_id = documents.doc_id
"""


def op7_near_vectors(spark, sf_dir):
    return itq.near_vectors(table(spark, sf_dir, "embeddings"))


OP7 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings
  where label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
        and list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link as (
  select a.vec_id as u, b.vec_id as v from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= cast(0.93 as double)
), reach(u, v) as (
  select vec_id, vec_id from embeddings union select r.u, l.v from reach r join link l on r.v = l.u
)
select r.u as vec_id, (select count(*) from link l where l.u = r.u) as n_links, min(r.v) as component_id, r.u = min(r.v) as kept
from reach r group by r.u
"""


def op8_line_dedup(spark, sf_dir):
    out = lines.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


OP8 = r"""
with l as (
  select doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(s) as line, generate_subscripts(s, 1) as i
        from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from documents))
), f as (
  select k, max(doc_id) as last from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5
), m as (
  select l.doc_id, l.i, l.line, (f.k is not null and l.doc_id <> f.last) as gone from l left join f on l.k = f.k
)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""


def op9_spotsigs(spark, sf_dir):
    out = spotsigs.edited(table(spark, sf_dir, "documents"))
    sha = F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256")
    prints = [spotsigs.written(F.col(c)).alias(name) for c, name in (("fp", "fingerprint"), ("edited_fp", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", sha, *prints, "near_edited", "near_next")


def op10_repeats(spark, sf_dir):
    out = repeats.drop_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "n_shared", F.sha2("kept", 256).alias("kept_sha256"))


#: CRC-32 in SQL: a table made by its rule, and a step for each byte of a list.
CRC = "tab(tab) as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)))"
CRC_OF = "xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode({x})), '..'), lambda h: cast('0x' || h as bigint)), lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1]), 4294967295))"


def op11_importance(spark, sf_dir):
    out = importance.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


OP11 = rf"""
with {CRC}, d as (
  select 0 as side, doc_id, coalesce(text, '') as text from documents union all select 1, item_id, coalesce(text, '') from benchmark
), w as (
  select side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from d
), f as (
  select side, doc_id, unnest(w) as f from w union all select side, doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
), b as (
  select f, {CRC_OF.format(x="f")} % 10000 as b from (select distinct f from f), tab
), n as (
  select b, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t from f join b using (f) group by b
), g as (
  select b, cast(floor(1000 * ln(cast(t + 1 as double) * (sum(s) over () + 10000) / (cast(s + 1 as double) * (sum(t) over () + 10000)))) as bigint) as gain from n
), e as (
  select doc_id, cast(floor(cast(sum(gain) as double) / count(*)) as bigint) as weight, count(*) as n_features from f join b using (f) join g using (b) where side = 0 group by doc_id
), a as (
  select w.doc_id, len(w.w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('7:' || w.doc_id), 1, 8) as bigint) + cast(0.5 as double)) / cast(4294967296 as double)))) as bigint) as score
  from w left join e on w.doc_id = e.doc_id where side = 0
), r as (
  select *, row_number() over (order by score desc, doc_id) as place, count(*) over () as able from a where n_words >= 20
)
select a.doc_id, a.n_features, a.weight, a.score, case when place <= 25 * able // 100 then place end as rank from a left join r on a.doc_id = r.doc_id
"""


def op12_hilbert_shards(spark, sf_dir):
    out = sharding.sharded(table(spark, sf_dir, "documents"))
    more = [F.col(c) for c in ("source", "lang", "hilbert")]
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *more)


def hilbert_sql(bits: int) -> str:
    """Common tables from h0 (coordinates a, b and c of a grid) to ``curve``, with the place on the Hilbert curve: one for each step."""
    made = []

    def step(*changes: str):
        made.append(f"h{len(made) + 1} as (select * replace ({', '.join(changes)}) from h{len(made)})")

    for k in range(bits - 1, 0, -1):
        low = (1 << k) - 1
        step(f"case when a & {1 << k} <> 0 then xor(a, {low}) else a end as a")
        for x in "bc":
            hit, swap = f"{x} & {1 << k} <> 0", f"(xor(a, {x}) & {low})"
            step(f"case when {hit} then xor(a, {low}) else xor(a, {swap}) end as a", f"case when {hit} then {x} else xor({x}, {swap}) end as {x}")
    step("xor(a, b) as b", "xor(xor(a, b), c) as c")
    for k in range(bits - 1, 0, -1):
        step(f"case when c & {1 << k} <> 0 then xor(t, {(1 << k) - 1}) else t end as t")
    index = " + ".join(f"((xor({x}, t) >> {k}) & 1) * {1 << (3 * k + 2 - i)}" for k in range(bits) for i, x in enumerate("abc"))
    return f"{', '.join(made)}, curve as (select *, cast({index} as bigint) as hilbert from h{len(made)})"


def cell_sql(name: str, bits: int) -> str:
    """Cells of a column by the rows below each value."""
    return f"cell_{name} as (select {name}, coalesce(cast(floor(coalesce(sum(count(*)) over (order by {name} nulls first rows between unbounded preceding and 1 preceding), 0) * {1 << bits} / (select count(*) from documents)) as int), 0) as cell from m group by {name})"


OP12 = f"""
with {CRC}, m as (
  select doc_id, source, lang, cast(octet_length(encode(coalesce(text, ''))) + 16 as bigint) as size, cast({CRC_OF.format(x="coalesce(text, '')")} as bigint) as text_crc32 from documents, tab
), {', '.join(cell_sql(x, sharding.BITS) for x in sharding.DIMENSIONS)}, h0 as (
  select m.*, x.cell as a, y.cell as b, z.cell as c, 0 as t from m join cell_source x on m.source is not distinct from x.source join cell_lang y on m.lang is not distinct from y.lang join cell_size z on m.size = z.size
), {hilbert_sql(sharding.BITS)}, r as (
  select *, row_number() over (order by hilbert, text_crc32, size, doc_id) - 1 as place, count(*) over () as n from curve
)
select doc_id, source, lang, size, text_crc32, hilbert, 'rows' as law, cast(place * 40 // n as int) as shard, cast(place - ((place * 40 // n) * n + 39) // 40 as bigint) as slot, cast(null as int) as grown_shard from r
"""


def op13_filter_audit(spark, sf_dir):
    out = filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


OP13 = r"""
with recursive w as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), l as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(w) < 200 then 'A' else '' end || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
         || case when 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * len(text) then 'C' else '' end
         || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
         || case when w.doc_id > min(w.doc_id) over (partition by text) then 'E' else '' end as fails
  from w left join l on w.doc_id = l.doc_id
), orders(o) as (
  select '' union all select o || x from orders, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) where not contains(o, x)
), steps as (
  select o, unnest(range(1, 6)) as step from orders where len(o) = 5
), k as (
  select part, good, toxic, fails, count(*) as n from f group by all
), r as (
  select part, o, step, substr(o, step, 1) as x, fails, good, toxic, n,
         list_bool_or(list_transform(range(1, step), lambda i: contains(fails, substr(o, i, 1)))) is true as before, contains(fails, substr(o, step, 1)) as here
  from k, steps
), t as (
  select part, o as filter_order, cast(step as int) as step, x, coalesce(sum(n) filter (where not before and not here), 0) as kept, coalesce(sum(n) filter (where here and not before), 0) as removed,
         coalesce(sum(n) filter (where here and before), 0) as redundant, coalesce(sum(n) filter (where fails = x), 0) as unique_fails,
         coalesce(sum(n) filter (where here and not before and good), 0) as good_lost, coalesce(sum(n) filter (where here and not before and toxic), 0) as toxic_lost
  from r group by part, o, step, x
)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from t
"""
