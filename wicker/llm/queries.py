"""The registered queries of this package and the SQL that expresses some of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import bpe, chat, divergence, fingerprints, html_extract, lm_scoring, mixing, near_dedup, quality, substring_dedup, token_counts, toxicity, vector_codes


def _held_out(modulus: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus)) == remainder


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), _held_out(7, 2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), _held_out(5, 0))
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = r"\### Assistant: </turn> ok"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", marked), (-7, 1, "assistant", marked)], rows.schema))
    # the table's rows in two layouts by turns, so that each record's own fingerprint must tell which it is
    keep = {"ignoreNullFields": "false"}
    plain = F.to_json(F.struct("role", "text"), keep)
    nested = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")), keep)
    record = F.when(F.xxhash64("conv_id", "turn") % 2 == 0, plain).otherwise(nested)
    done = chat.format_records(rows.select("conv_id", "turn", record.alias("record"))).select("conv_id", "formatted", "segments", chat.parsed(F.col("formatted")).alias("turns"))
    loss = F.filter("segments", lambda s: s["loss"])
    masked = F.array_join(F.transform(loss, lambda s: chat.unescape(s["text"])), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.withColumn("masked", masked).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated(table(spark, sf_dir, "documents"), digests=True)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests=True)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        *(op1_near_dedup, op2_lm_scoring, op3_toxicity, op4_chat_formatting, op5_fingerprints, op6_quality_rules, op7_substring_dedup),
        *(op8_mixing, op9_html_extraction, op10_byte_bpe, op11_vector_codes, op12_token_counts, op13_source_divergence, pipeline),
    )
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _lloyd() -> str:
    """The rounds of op11 as SQL: exhaustive assignment, then means rounded down."""
    distance = "select vec_id, x.part, e.entry, (x.v[1] - e.v[1]) ** 2 + (x.v[2] - e.v[2]) ** 2 + (x.v[3] - e.v[3]) ** 2 + (x.v[4] - e.v[4]) ** 2 d from x join b{0} e on x.part = e.part"
    near = "select vec_id, part, entry, d from (select *, row_number() over (partition by vec_id, part order by d, entry) r from (" + distance + ")) where r = 1"
    mean = ", ".join("((sum(x.v[{0}]) - (sum(x.v[{0}]) % count(*) + count(*)) % count(*)) // count(*))::bigint".format(i) for i in range(1, 5))
    sql = ""
    for k in range(2):
        sql += f"""
a{k} as ({near.format(k)}),
m{k} as (select x.part, a.entry, [{mean}] v from a{k} a join x on x.vec_id = a.vec_id and x.part = a.part group by x.part, a.entry),
b{k + 1} as (select b.part, b.entry, coalesce(m.v, b.v) v from b{k} b left join m{k} m on m.part = b.part and m.entry = b.entry),"""
    return sql + f"\na2 as ({near.format(2)})"


ORACLE_SQL = {
    "op11_vector_codes": rf"""
with k as (select vec_id, label, embedding from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
w as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from k),
x as (select vec_id, part, v[1 + part * len(v) // 16:(part + 1) * len(v) // 16] v from w, (select unnest(range(16)) part)),
b0 as (select part, row_number() over (partition by part order by vec_id) - 1 entry, v from x where vec_id in (select vec_id from k order by vec_id limit 64)),{_lloyd()},
c as (select vec_id, string_agg(printf('%02x', entry), '' order by part) code, sum(d)::bigint error from a2 group by vec_id),
l as (select label, sum(error)::bigint label_error from c join w using (vec_id) group by label),
s as (select sha256(string_agg(c::varchar, ',' order by part, entry, i)) codebooks_sha256 from (select part, entry, unnest(v) c, unnest(range(len(v))) i from b2))
select vec_id, code, error, label_error, codebooks_sha256 from c join w using (vec_id) join l on l.label is not distinct from w.label, s""",
    "op13_source_divergence": r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
t as (select r, lang, source, unnest(ts) term from d),
k as (select lang, term, count(*) whole from t group by lang, term having count(distinct r) >= 10),
v as (select lang, count(*) v, sum(whole) n from k group by lang),
c as (select lang, source, term, count(*) c from t semi join k using (lang, term) group by all),
g as (select lang, source, coalesce(n, 0) n, coalesce(v, 0) v from (select distinct lang, source from d) left join (select lang, source, sum(c) n from c group by all) using (lang, source) left join (select lang, v from v) using (lang)),
p as (select g.lang, g.source, k.term, k.whole, coalesce(c.c, 0) c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 2)) // (g.n + 2 * g.v) p from g join k using (lang) left join c using (lang, source, term)),
pairs as (select a.lang, a.source, b.source item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) val from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
terms as (select lang, source, term item, ((p - q) * (p - q)) // (p + q) val from (select p.*, 1 + (1000000000::hugeint * (p.whole + 2)) // (v.n + 2 * v.v) q from p join v using (lang)) where c > 0 and p > q),
all_parts as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(val, 0) val from g a join g b on a.lang = b.lang and a.source <> b.source left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', item, val from terms),
ranked as (select *, row_number() over (partition by lang, source, part order by val desc, item) rk from all_parts)
select lang, source, part, item, val::bigint "value", rk::integer "rank" from ranked where part = 'pair' or rk <= 10""",
    "op1_near_dedup": rf"""
with recursive w as (
  select doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ws from documents),
i as (select doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) i from w where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') sh from i),
sizes as (select doc_id, count(*) cnt from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
e as (select a, b from p join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.cnt + y.cnt - c)),
both_ways as (select a, b from e union all select b, a from e),
r(doc_id, root) as (select doc_id, doc_id from documents union select r.doc_id, b from r join both_ways on a = root),
m as (select doc_id, min(root) component_id from r group by doc_id)
select d.doc_id, coalesce(cnt, 0)::bigint n_shingles, component_id, d.doc_id = component_id kept
from documents d join m on m.doc_id = d.doc_id left join sizes on sizes.doc_id = d.doc_id""",
    "op4_chat_formatting": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
x as (select *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + 15 as chars from t),
g as (
  select conv_id, count(*) n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) turns,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') loss, sum(chars) chars
  from x group by conv_id)
select conv_id, n_turns::bigint n_turns, sha256(turns) turns_sha256, length(loss)::bigint loss_chars, sha256(loss) loss_sha256, chars::bigint formatted_chars from g""",
    "op6_quality_rules": rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS.format("text")} ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) lines from documents),
i as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') win from (select doc_id, ws, unnest(generate_series(1, len(ws) - 7)) i from w where len(ws) >= 8)),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, win) c from i) where c > 1),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from rep) group by doc_id),
m as (
  select w.doc_id, lang, source, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, len(lines)::bigint n_lines, coalesce(n, 0)::bigint n_repeat_words
  from w left join cov on cov.doc_id = w.doc_id),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
    n_symbols / greatest(word_chars, 1)::double a, n_dup_lines / greatest(n_lines, 1)::double b, n_repeat_words / greatest(n_words, 1)::double c, word_chars / greatest(n_words, 1)::double d from m),
q as (select lang, source, quantile_disc(a, [0.05, 0.25, 0.75, 0.95]) qa, quantile_disc(b, [0.05, 0.25, 0.75, 0.95]) qb, quantile_disc(c, [0.05, 0.25, 0.75, 0.95]) qc, quantile_disc(d, [0.05, 0.25, 0.75, 0.95]) qd from f where not base_failed group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
  and a between least(qa[2] - 4.0 * (qa[3] - qa[2]), qa[1]) - {quality.MARGIN["symbol_ratio"]} and greatest(qa[3] + 4.0 * (qa[3] - qa[2]), qa[4]) + {quality.MARGIN["symbol_ratio"]}
  and b between least(qb[2] - 4.0 * (qb[3] - qb[2]), qb[1]) - {quality.MARGIN["dup_line_ratio"]} and greatest(qb[3] + 4.0 * (qb[3] - qb[2]), qb[4]) + {quality.MARGIN["dup_line_ratio"]}
  and c between least(qc[2] - 4.0 * (qc[3] - qc[2]), qc[1]) - {quality.MARGIN["repeat_ratio"]} and greatest(qc[3] + 4.0 * (qc[3] - qc[2]), qc[4]) + {quality.MARGIN["repeat_ratio"]}
  and d between least(qd[2] - 4.0 * (qd[3] - qd[2]), qd[1]) - {quality.MARGIN["word_length"]} and greatest(qd[3] + 4.0 * (qd[3] - qd[2]), qd[4]) + {quality.MARGIN["word_length"]} kept
from f left join q on f.lang is not distinct from q.lang and f.source is not distinct from q.source""",
    "op7_substring_dedup": rf"""
with w as (select doc_id, {_WORDS.format("text")} ws from documents),
i as (select doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) win from (select doc_id, ws, unnest(generate_series(1, len(ws) - 34)) i from w where len(ws) >= 35)),
rep as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -1000) gap from (select doc_id, i, count(*) over (partition by win) c from i) where c > 1),
pos as (select doc_id, unnest(generate_series(case when gap < 35 then i + 35 - gap else i end, i + 34)) j from rep),
word as (select doc_id, unnest(ws) word, unnest(generate_series(1, len(ws))) j from w where len(ws) > 0),
k as (select word.doc_id, string_agg(word, ' ' order by word.j) filter (pos.j is null) kept, count(pos.j) n_removed from word left join pos on pos.doc_id = word.doc_id and pos.j = word.j group by word.doc_id)
select w.doc_id, len(ws)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(kept, '')) kept_sha256 from w left join k on k.doc_id = w.doc_id""",
    "op8_mixing": rf"""
with d as (select doc_id, source, len({_WORDS.format("text")})::bigint size, md5(coalesce(doc_id::varchar, '') || ' 0') h from documents),
per as (select source, sum(size)::bigint source_size from d group by source),
wt as (select *, ([5, 2, 1])[1 + (row_number() over (order by source nulls last) - 1) % 3]::bigint weight from per),
lv as (select *, (150 * sum(source_size) over () / 100.0 - coalesce(sum(2 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) lev from wt),
tg as (select source, source_size, weight, case when lev * weight >= 2 * source_size then (2 * source_size)::double else least(2 * source_size, max(lev) filter (lev * weight < 2 * source_size) over () * weight)::double end target,
    0.5 - (weight - 1) / 4.0::double slope from lv),
p as (select d.doc_id, size, source_size, target, slope, h, coalesce(sum(size) over (partition by d.source order by h, doc_id, size rows between unbounded preceding and 1 preceding), 0) pos
  from d join tg on d.source is not distinct from tg.source),
t as (select *, least(greatest(ceil(target) - pos, 0), size)::bigint first_taken, least(greatest(ceil(target) - pos - source_size, 0), size)::bigint second_taken,
    least(pos / greatest(target, 1.0), 1.0) u1, least((pos + source_size) / greatest(target, 1.0), 1.0) u2 from p)
select doc_id, size, source_size, target, first_taken + second_taken taken, first_taken, second_taken,
  2 * u1 / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * u1, 0.0))) "position",
  case when second_taken > 0 then 2 * u2 / (1 - slope + sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * u2, 0.0))) end second_position
from t""",
}
