"""The queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import decontam, fingerprints, importance, langid, quality, ranked, simhash, substring_dedup, suffix_dedup, token_counts, topk
from tracemill.llm.common import crc_part, spread, table
from tracemill.llm.line_dedup import MIN_PAGES, RATIO, drop_boilerplate
from tracemill.llm.packing import pack


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "lines_total", "lines_dropped", F.md5("text").alias("kept_md5"))


OP1_SQL = f"""
with pages_ as (select row_number() over () page, doc_id, source, text, string_split(text, chr(10)) ls from documents),
lines as (select page, source, unnest(ls) line, generate_subscripts(ls, 1) pos from pages_ where text is not null),
totals as (select source, count(*) total from pages_ group by source),
counted as (select source, line, count(distinct page) n from lines where trim(line) <> '' group by source, line),
drops as (select c.source, line from counted c join totals t on t.source is not distinct from c.source where n >= {MIN_PAGES} and n / total > {RATIO}),
kept as (
  select l.page, count(*) n, count(d.line) gone, string_agg(l.line, chr(10) order by pos) filter (d.line is null) rest
  from lines l left join drops d on d.source is not distinct from l.source and d.line = l.line group by l.page
)
select doc_id, source, coalesce(n, 0) lines_total, coalesce(gone, 0) lines_dropped, case when text is not null then md5(coalesce(rest, '')) end kept_md5
from pages_ left join kept using (page)
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", "text")
    return token_counts.count(docs.withColumn("edits", token_counts.sample_edits()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).withColumn("held_out", crc_part("doc_id", 4) == 2)
    model = quality.fit(docs.filter("not held_out"), table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(spread(table(spark, sf_dir, "documents")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP6_SQL = f"""
with listed as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
words as (select doc_id, unnest(ws) word, generate_subscripts(ws, 1) pos from listed),
runs as (
  select doc_id, pos, string_agg(word, ' ') over w run, count(*) over w n from words
  window w as (partition by doc_id order by pos rows between current row and {substring_dedup.WINDOW - 1} following)
), ranked as (select doc_id, pos, row_number() over (partition by run order by doc_id, pos) k from runs where n = {substring_dedup.WINDOW}),
gone as (select distinct doc_id, unnest(range(pos, pos + {substring_dedup.WINDOW})) pos from ranked where k > 1),
kept as (
  select w.doc_id, count(*) n_words, count(g.pos) n_removed, string_agg(word, ' ' order by w.pos) filter (g.pos is null) rest
  from words w left join gone g on g.doc_id = w.doc_id and g.pos = w.pos group by w.doc_id
)
select doc_id, coalesce(n_words, 0) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(rest, '')) kept_sha256 from listed left join kept using (doc_id)
"""


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


OP9_SQL = f"""
with v as (
  select vec_id, [cast(floor({topk.SCALE} * cast(x as double)) as bigint) for x in embedding] v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len(embedding) > 0
), pairs as (
  select q.vec_id query_id, c.vec_id, cast(list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)]) as bigint) score
  from v q join v c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) "rank" from pairs)
select query_id, "rank", vec_id, score from ranked where "rank" <= {topk.K}
"""


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents")).withColumn("held_out", crc_part("doc_id", 5) == 0)
    dictionaries = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs.select("doc_id", "held_out", "text"), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(ranked.build(spread(table(spark, sf_dir, "documents"))), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
with held as (select row_id, doc_id, ts, len(ts) n from (select row_number() over () row_id, doc_id, {_TERMS} ts from documents) where len(ts) > 0),
totals as (select count(*) n_all, cast(sum(n) as bigint) l_all from held),
tfs as (select row_id, term, count(*) tf from (select row_id, unnest(ts) term from held) group by all),
dfs as (select term, count(*) df from tfs group by term),
asked as (
  select item_id, term, count(*) times from (select item_id, unnest({_TERMS}) term from (select distinct item_id, text from benchmark where item_id is not null)) group by all
), weights as (
  select item_id, term, times * cast(floor(1000 * ln(cast(2 * n_all + 2 as double) / (2 * df + 1))) as bigint) w from asked join dfs using (term), totals
), scores as (
  select item_id, row_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_all) // l_all)))) as bigint) score
  from weights join tfs using (term) join held using (row_id), totals group by all
), ranked as (select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) "rank" from scores where score > 0)
select item_id, "rank", doc_id, score from ranked where "rank" <= {ranked.K}
"""


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(spread(table(spark, sf_dir, "documents")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(spread(table(spark, sf_dir, "documents")), spread(table(spark, sf_dir, "benchmark")))


OP13_SQL = f"""
with crc_table as (
  select list(c order by i) t from (
    select i, list_reduce(list_concat([i], range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i))
), texts as (select 0 side, row_number() over () row_id, doc_id, text from documents union all select 1, row_number() over (), item_id, text from benchmark),
split as (
  select side, row_id, doc_id, {_TERMS} ws from texts
), features as (
  select side, row_id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))])) feature from split
), counted as (select side, row_id, feature, count(*) n from features group by all),
names as (select distinct feature from counted),
bytes as (select feature, [cast('0x' || substr(hex(encode(feature)), 2 * i + 1, 2) as bigint) for i in range(strlen(feature))] b from names),
buckets as (
  select feature, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {importance.BUCKETS} bucket from bytes, crc_table
), sides as (select bucket, coalesce(sum(n) filter (side = 0), 0) s, coalesce(sum(n) filter (side = 1), 0) t from counted join buckets using (feature) group by bucket),
totals as (select coalesce(sum(s), 0) s_all, coalesce(sum(t), 0) t_all from sides),
gains as (
  select bucket, cast(floor(1000 * ln((cast(t as double) + 1) * (cast(s_all as double) + {importance.BUCKETS}) / ((cast(s as double) + 1) * (cast(t_all as double) + {importance.BUCKETS})))) as bigint) gain from sides, totals
), weights as (
  select row_id, sum(n) n_features, cast(floor(cast(sum(n * gain) as decimal(38, 0)) / sum(n)) as bigint) weight
  from counted join buckets using (feature) join gains using (bucket) where side = 0 group by row_id
), scored as (
  select row_id, doc_id, len(ws) n_words, cast(coalesce(n_features, 0) as bigint) n_features, coalesce(weight, 0) weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{importance.SEED}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) score
  from split left join weights using (row_id) where side = 0
), ranked as (
  select row_id, row_number() over (order by score desc, doc_id) r, count(*) over () n from scored where n_words >= {importance.MIN_WORDS}
)
select doc_id, n_features, weight, score, case when r <= {importance.SHARE} * n // 100 then r end "rank" from scored left join ranked using (row_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_suffix_array_dedup": op8_suffix_array_dedup,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_document_fingerprints": op12_document_fingerprints,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op6_substring_dedup": OP6_SQL, "op9_exact_top_k": OP9_SQL, "op11_ranked_search": OP11_SQL, "op13_importance_resampling": OP13_SQL}
