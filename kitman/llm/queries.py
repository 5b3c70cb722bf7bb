"""The registered queries of the operators, with production parameters, and
their DuckDB SQL where SQL can express them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (conversations, decontaminate, fingerprints, langid, mixing, neighbours, quality, sharding, simhash, spelling,
               substrings, tokens, urlfilter)
from .common import fold, save, shared_path, table

SHARDS = 24
END_ID = 1


def _crc(text: str):
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = sharding.keyed(docs, "doc_id", sharding.size_of().alias("size"), _crc("text").alias("text_crc32"))
    return sharding.assign(keys, sharding.plan(keys, SHARDS)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, fold("doc_id", 4) != 2)
    return langid.predict(docs, model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a path is the document that the page shows; its label
    (low quality or toxic) is the page's."""
    pages = table(spark, sf_dir, "pages")
    shown = F.regexp_extract(urlfilter.host_path("url")[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("shown")).agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("block"))
    labelled = pages.select("url", F.try_to_number(F.nullif(shown, F.lit("")), F.lit("9" * 18)).cast("long").alias("shown")).join(labels, "shown")
    return urlfilter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "confidence")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = save(tokens.write(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"),
                                 public_tokenizers.path("word_bpe_49k.json"), END_ID), "manifest")
    return tokens.read(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return got.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired_after_damage(table(spark, sf_dir, "conversations"))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def build() -> dict:
    import corpus_pipeline  # noqa: F401  the pipeline belongs to this subpackage

    return {f.__name__: f for f in (
        op1_sharding, op2_url_filter, op3_simhash_dedup, op4_substring_dedup, op5_token_files, op6_decontaminate,
        op7_mixing, op8_quality, op9_language, op10_fingerprints, op11_spelling_variants, op12_conversation_repair,
        op13_nearest_neighbours, pipeline)}


OP4_SQL = r"""
with w as (select doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as ws from documents),
win as (select doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) as h
        from w, unnest(range(1, greatest(len(ws) - 48, 1))) t(p) where len(ws) >= 50),
least as (select h, min(doc_id) as first_doc from win group by h),
bad as (select distinct win.doc_id, p + k as pos from win join least using (h), unnest(range(0, 50)) t(k) where win.doc_id > first_doc),
pos as (select doc_id, i, ws[i] as word from w, unnest(range(1, len(ws) + 1)) t(i)),
kept as (select pos.doc_id, string_agg(word, ' ' order by i) as s, count(*) as n
         from pos anti join bad on pos.doc_id = bad.doc_id and pos.i = bad.pos group by pos.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(s, '')) as kept_sha256
from w left join kept using (doc_id)
"""

_SHINGLES = r"""
{name}_w as (select {id}, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] as ws from {table}),
{name} as (select distinct {id}, array_to_string(ws[p:p + 4], ' ') as g from {name}_w, unnest(range(1, greatest(len(ws) - 3, 2))) t(p) where len(ws) > 0)"""

OP6_SQL = ("with" + _SHINGLES.format(name="d", id="doc_id", table="documents") + ","
           + _SHINGLES.format(name="b", id="item_id", table="benchmark") + r""",
size as (select item_id, count(*) as n from b group by item_id),
met as (select doc_id, item_id, count(*) as c from d join b using (g) group by doc_id, item_id)
select doc_id, item_id, n::integer as item_shingles, c::integer as contained, c::double / n as containment
from met join size using (item_id) where c >= 0.8 * n - 1e-9
""")

_U52 = "('0x' || substr(md5({}), 1, 13))::bigint"
OP7_SQL = f"""
with recursive size as (select source, sum(strlen(coalesce(text, '')))::double as size from documents group by source),
rate as (select source, (select sum(size) from size) * (1.0::double / (select count(*) from size)::double) / size as lam from size),
cdf as (select source, lam, 0 as k, exp(-lam) as p, exp(-lam) as c from rate
        union all select source, lam, k + 1, p * lam / (k + 1), c + p * lam / (k + 1) from cdf where k < 100),
draw as (select d.*, (select count(*) from cdf where cdf.source = d.source and
                      c <= {_U52.format("'7:' || doc_id || ':1'")} / 4503599627370496.0::double)::integer as n_copies from documents d)
select draw.* exclude (n_copies), copy_no::integer as copy_no, n_copies,
       {_U52.format("'shuffle:7:' || doc_id || ':' || copy_no")} as shuffle_key
from draw, unnest(range(1, n_copies + 1)) t(copy_no)
"""

# the exact neighbours; the operator may miss one in twenty, here it finds all
OP13_SQL = """
with v as (select vec_id, embedding::double[] as e from embeddings
           where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
                 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
met as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.e, v.e) as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as n from met)
select query_id, n::integer as rank, vec_id, score from ranked where n <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring_dedup": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_mixing": OP7_SQL,
            "op13_nearest_neighbours": OP13_SQL}
