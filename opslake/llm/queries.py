"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.llm import (chat, collocations, decontaminate, jaccard_join, lang_id, licenses, order_minhash, packing, quality,
                         sharding, topk, toxicity, whitening)
from opslake.sources.tables import table

#: vocabulary file of the packing query; a parameter, never copied into the repository
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def crc_mod(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def held(n: int, r: int):
    """Whether a row is held out; one without doc_id is not."""
    return F.coalesce(crc_mod(n) == r, F.lit(False)).alias("held_out")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(docs.where(crc_mod(4) != 2).select("doc_id", "text", "lang"))
    return lang_id.identify(docs, model).select("doc_id", held(4, 2), "lang_pred", "score", "rejected")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), ngram=3, similarity=0.9)
    return got.select("doc_id", "n_shingles", "component_id")


def _labels(spark: SparkSession, sf_dir: str, col: str) -> DataFrame:
    """Training labels: rows whose crc32(doc_id) mod 5 is not 0."""
    return table(spark, sf_dir, "labels").where(crc_mod(5) != 0).select("doc_id", F.col(col).alias("label"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_scores(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "quality"))
    return got.select("doc_id", held(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"), shards=40)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "home_shard")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=1)
    # the digest is taken from the operator's ids before the shuffle, which then moves short columns only
    placed = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.format_chats(chat.with_probe(table(spark, sf_dir, "conversations"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"))
    return got.select("doc_id", held(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                      "matched_clauses")


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = order_minhash.edited_fingerprints(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
                      "edited_fingerprint", "near_edited", "near_next")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors, whitening.fit(vectors, components=4, scale=256), scale=256)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), top=2000, least=30, drop_percent=80)


QUERIES = {f.__name__: f for f in (op1_lang_id, op2_jaccard_join, op3_quality, op4_sharding, op5_packing, op6_decontaminate,
                                   op7_licenses, op8_chat_format, op9_toxicity, op10_order_minhash, op11_whitening, op12_topk,
                                   op13_collocations)}
ORACLES: dict[str, str] = {
    "op12_topk": """
        with v as (select vec_id, list_transform(embedding, lambda e: floor(64 * e::double)::bigint) as x
                   from embeddings where embedding is not null
                   and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
        s as (select q.vec_id as query_id, c.vec_id,
                     list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint as score
              from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20""",
    "op13_collocations": r"""
        with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        s as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
        g as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from s),
        f as (select lang, ws[i:i + k - 1] as ph, k, count(*)::hugeint as a from g, (select unnest([1, 2, 3, 4]) as k)
              where i + k - 1 <= len(ws) group by all),
        n as (select lang, sum(a) as n from f where k = 1 group by lang),
        c as (select * from f where k > 1 and a >= 30),
        longer as (select lang, k, a, ph, unnest(range(1, k)) as size from c),
        inner_ as (select lang, a, ph, size, unnest(range(1, (k - size + 2)::bigint)) as i from longer where size > 1),
        best as (select lang, ph[i:i + size - 1] as ph, max(a) as most from inner_ group by all),
        kept as (select c.* from c left join best using (lang, ph) where best.most is null or 100 * best.most < 80 * c.a),
        cut as (select lang, ph, k, a, unnest(range(1, k)) as j from kept),
        sc as (select cut.lang, cut.ph, cut.a, x.a as l, y.a as r, j, 2000000 * cut.a // (x.a + y.a) as score
               from cut join f x on x.lang = cut.lang and x.ph = cut.ph[1:j]
               join f y on y.lang = cut.lang and y.ph = cut.ph[j + 1:cut.k]),
        low as (select *, row_number() over (partition by lang, ph order by score, j) as o from sc),
        ranked as (select lang, array_to_string(ph, ' ') as phrase, a, l, r, score from low where o = 1),
        top as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from ranked)
        select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
        from top join n using (lang) where rank <= 2000""",
}
