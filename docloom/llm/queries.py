"""The registered queries of the thirteen operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op6_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .additive import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pages import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_avi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import avi

    return avi.describe(avi.to_avi(table(spark, sf_dir, "documents")))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of all media."""
    from . import avi

    return avi.clip_rows(avi.to_avi(table(spark, sf_dir, "documents")))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_words

    return repeated_words(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.lower(F.hex("kept_sha256")).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import planted, report

    return report(planted(table(spark, sf_dir, "documents")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pii, op2_mixing, op3_bpe, op4_simhash, op5_language, op6_additive, op7_html, op8_toxicity, op9_avi, op10_substrings, op11_whitening, op12_periodic, op13_minhash, media_clips)
    return {f.__name__: f for f in found}


#: Windows as texts of fifty words, their least doc_id, and the words that later ones cover.
SUBSTRINGS_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
e as (select doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: {'i': i, 'h': md5(array_to_string(ws[i:i + 49], ' '))}), recursive := true) from w where len(ws) >= 50),
o as (select h, min(doc_id) as lo, max(doc_id) as hi from e group by h having min(doc_id) < max(doc_id)),
c as (select distinct doc_id, unnest(range(i, i + 50)) as p from e join o using (h) where doc_id > lo),
g as (select doc_id, list(p) as gone from c group by doc_id),
k as (select w.doc_id, ws, coalesce(gone, []) as gone from w left join g using (doc_id))
select doc_id, len(ws) as n_words, len(gone) as n_removed,
  sha256(coalesce(array_to_string(case when len(gone) = 0 then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end, ' '), '')) as kept_sha256 from k"""


def oracle_sql() -> dict[str, str]:
    """Only windows of words can be said in SQL: the others need XXH64, Luhn sums, merges, trained models or media."""
    return {"op10_substrings": SUBSTRINGS_SQL}
