"""The registered queries of the text operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, bpe, collocations, common, fingerprints, hard_negatives, jaccard_join, ngram_rules, packing, quality_net, substring_dedup, tiktoken_bpe, token_counts, toxicity


def op4_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_rules.judge(common.documents(spark, sf_dir), common.labels(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(common.documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def _predicted(scored: DataFrame, folds: int, fold: int) -> DataFrame:
    return scored.select("doc_id", common.held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = quality_net.score(docs, quality_net.fit(docs, quality_net.training_fold(common.labels(spark, sf_dir))))
    return _predicted(out, quality_net.FOLDS, quality_net.HELD_OUT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compared(common.documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprints.as_text(F.col("bits")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_bits")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(common.documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.encode(common.documents(spark, sf_dir), decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return back.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    out = toxicity.score(docs, toxicity.fit(docs, toxicity.training_fold(common.labels(spark, sf_dir))))
    return _predicted(out, toxicity.FOLDS, toxicity.HELD_OUT)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(common.documents(spark, sf_dir))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are rounded to six places, within which sums in any order agree."""
    out = backoff_lm.score(common.documents(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("base_score", "score")})
    held = common.held_out(F.col("doc_id"), backoff_lm.FOLDS, backoff_lm.HELD_OUT).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(common.documents(spark, sf_dir)))


def op11_tiktoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = tiktoken_bpe.encode(common.documents(spark, sf_dir), decoded=True)
    ids_sha256 = F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256, F.sha2("raw", 256).alias("decoded_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    scaled = lambda x: F.lit(256.0) * x.cast("double")
    vector = F.transform("embedding", lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return hard_negatives.mine(rows.select("vec_id", label.alias("label"), vector.alias("vector")), F.col("vec_id") % 100 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(common.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_net": op1_quality_net,
        "op2_fingerprints": op2_fingerprints,
        "op3_token_counts": op3_token_counts,
        "op4_ngram_rules": op4_ngram_rules,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_bpe": op6_bpe,
        "op7_toxicity": op7_toxicity,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_backoff_lm": op9_backoff_lm,
        "op10_packing": op10_packing,
        "op11_tiktoken": op11_tiktoken,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
    }


#: Words of a text in the oracle engine's dialect; null texts have none.
_WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_OP5 = f"""
with w as (select doc_id, {_WORDS_SQL} as ws from documents),
starts as (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as pos from w where len(ws) >= 50),
windows as (select doc_id, pos, md5(array_to_string(list_slice(ws, pos, pos + 49), ' ')) as h from starts),
firsts as (select h, min(doc_id) as lo from windows group by h),
dead as (select doc_id, pos from windows join firsts using (h) where doc_id > lo),
spots as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as pos from w),
told as (select s.doc_id, s.word, s.pos, max(case when d.pos is null then 0 else 1 end)
           over (partition by s.doc_id order by s.pos rows between 49 preceding and current row) as gone
         from spots s left join dead d on d.doc_id = s.doc_id and d.pos = s.pos),
kept as (select doc_id, cast(sum(gone) as bigint) as n_removed,
           coalesce(string_agg(word, ' ' order by pos) filter (gone = 0), '') as kept from told group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
"""

_OP8 = f"""
with recursive texts as (select coalesce(text, '') as text, min(doc_id) as rep, count(*) as copies from documents group by 1),
w as (select rep, copies, {_WORDS_SQL} as ws from texts),
sh as (select distinct rep, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(list_slice(ws, pos, pos + 4), ' ') end as s
       from (select rep, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) as pos from w where len(ws) > 0)),
n as (select rep, count(*) as n from sh group by rep),
overlap as (select a.rep as a, b.rep as b, count(*) as k from sh a join sh b on a.s = b.s and a.rep <> b.rep group by 1, 2),
links as (select a, b from overlap join n x on x.rep = a join n y on y.rep = b where k >= 0.8 * (x.n + y.n - k) - 1e-9),
reach(a, b) as (select rep, rep from texts union select reach.a, links.b from reach join links on links.a = reach.b),
class as (select a as rep, min(b) as class_id from reach group by a),
counted as (select a as rep, sum(copies) as more, count(*) as texts from links join texts on rep = b group by a)
select d.doc_id, c.class_id, t.copies as n_copies, cast(t.copies - 1 + coalesce(k.more, 0) as bigint) as n_links, coalesce(k.texts, 0) as n_text_links
from documents d join texts t on coalesce(d.text, '') = t.text join class c using (rep) left join counted k using (rep)
"""

#: crc32 of an id as text, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

_LOW = backoff_lm.LEAST_TRIGRAM
_OP9 = f"""
with rows as (select row_number() over () as row, doc_id, coalesce({_CRC_SQL} % {backoff_lm.FOLDS} = {backoff_lm.HELD_OUT}, false) as held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') as ws from documents),
tokens as (select row, held_out, unnest(ws) as w, unnest(list_prepend(' ', ws[:-2])) as v, unnest(list_prepend(null, list_prepend(' ', ws[:-3]))[:len(ws)]) as u from rows),
uni as (select w, count(*) as c from tokens where not held_out group by w),
histories as (select w as v, c from uni union all select ' ', count(*) from rows where not held_out),
total as (select coalesce(sum(c), 0) as n, coalesce(sum(c), 0) + 0.5 * (count(*) + 1) as space from uni),
bi as (select v, w, count(*) as c from tokens where not held_out group by v, w),
tri as (select u, v, w, count(*) as c from tokens where not held_out and u is not null group by u, v, w having count(*) >= {_LOW}),
d as (select (select least(greatest(case when sum((c = 1)::int) > 0 then 1 - 2.0 * sum((c = 2)::int) / sum((c = 1)::int) else 0.5 end, 0.1), 0.9) from bi) as d2,
  (select least(greatest(case when sum((c = {_LOW})::int) > 0 then {_LOW} - {_LOW + 1}.0 * sum((c = {_LOW + 1})::int) / sum((c = {_LOW})::int) else {_LOW / 2} end, {0.1 * _LOW}), {0.9 * _LOW}) from tri) as d3),
h1 as (select v, d2 * count(*) / any_value(h.c) as left2 from bi join histories h using (v) cross join d group by v, d2),
h2 as (select t.u, t.v, any_value(b.c) as c2, (any_value(b.c) - sum(t.c) + d3 * count(*)) / any_value(b.c) as left3 from tri t join bi b on b.v = t.u and b.w = t.v cross join d group by t.u, t.v, d3),
lower_order as (select t.*, n, d3, uni.c is not null as known, (coalesce(uni.c, 0) + 0.5) / space as p1, coalesce((b.c - d2) / h.c, 0) + coalesce(h1.left2, 1) * (coalesce(uni.c, 0) + 0.5) / space as p2
  from tokens t cross join total cross join d left join uni using (w) left join bi b on b.v = t.v and b.w = t.w left join histories h on h.v = t.v left join h1 on h1.v = t.v),
scored as (select l.row, known, n, p1, case when h2.c2 is null then p2 else coalesce((x.c - d3) / h2.c2, 0) + h2.left3 * p2 end as p
  from lower_order l left join h2 on h2.u = l.u and h2.v = l.v left join tri x on x.u = l.u and x.v = l.v and x.w = l.w)
select doc_id, held_out, count(*) as n_tokens, cast(sum(known::int) as bigint) as n_known, cast(max(n) as bigint) as train_tokens,
  round(sum(log10(p1)), 6) as base_score, round(sum(log10(p)), 6) as score
from scored join rows using (row) group by row, doc_id, held_out
"""


_OP12 = """
with v as (select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
a as (select min(row) as row, vec_id, label, q from v where vec_id % 100 = 0 group by vec_id, label, q),
pairs as (select a.row as a, a.vec_id as anchor_id, a.label <> v.label as other, v.row, v.vec_id, list_inner_product(a.q, v.q)::bigint as s
  from a join v on v.vec_id is distinct from a.vec_id),
p as (select * from pairs where not other qualify row_number() over (partition by a order by s desc, vec_id nulls last, row) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.row order by n.s desc, n.vec_id nulls last, n.row) as rank,
  n.vec_id as negative_id, p.s as positive_score, n.s as negative_score
from p join pairs n on n.a = p.a and n.other and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s
qualify row_number() over (partition by p.a, p.row order by n.s desc, n.vec_id nulls last, n.row) <= 10
"""


_OP13 = r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
g as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, ws, k, unnest(generate_series(1, len(ws) - k + 1)) as i from w, (values (1), (2), (3), (4)) t(k)) group by all),
n as (select lang, cast(sum(f) as bigint) as n from g where k = 1 group by lang),
c as (select lang, phrase, f as a, k, string_split(phrase, ' ') as ws from g where k > 1 and f >= 30),
cuts as (select c.lang, c.phrase, c.a, cut, l.f as l, r.f as r, cast(2000000 * c.a::hugeint // (l.f + r.f) as bigint) as score
  from (select *, unnest(generate_series(1, k - 1)) as cut from c) c
  join g l on l.lang = c.lang and l.phrase = array_to_string(c.ws[:cut], ' ') join g r on r.lang = c.lang and r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
inner_phrases as (select lang, array_to_string(ws[i : i + size - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(generate_series(1, k - size + 1)) as i from (select c.*, unnest(generate_series(2, k - 1)) as size from c)) group by all)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from best b join n using (lang) left join inner_phrases x using (lang, phrase) where x.longer is null or 100 * x.longer::hugeint < 80 * a::hugeint
qualify row_number() over (partition by b.lang order by score desc, a desc, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op13_collocations": _OP13,
        "op12_hard_negatives": _OP12,
        "op9_backoff_lm": _OP9,
        "op8_jaccard_join": _OP8,
        "op5_substring_dedup": _OP5,
    }
