"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline

from . import bpe, ordermin, packing, pii, quality, secrets, sstable, tokencount, topk, warc
from .common import read_table


def op1_randomness_secrets(spark, sf_dir):
    return secrets.query(read_table(spark, sf_dir, "documents"))


def op2_impact_topk(spark, sf_dir):
    return topk.query(read_table(spark, sf_dir, "embeddings"))


def op3_content_addressed_warc(spark, sf_dir):
    return warc.query(read_table(spark, sf_dir, "pages"))


def op4_quality_cascade(spark, sf_dir):
    return quality.query(read_table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.query(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_pair_index_bpe(spark, sf_dir):
    return bpe.query(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_transducer_counts(spark, sf_dir):
    return tokencount.query(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sstable_shards(spark, sf_dir):
    return sstable.query(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_boosted_pii(spark, sf_dir):
    return pii.query(read_table(spark, sf_dir, "documents"))


def op10_order_minhash(spark, sf_dir):
    return ordermin.query(read_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_randomness_secrets": op1_randomness_secrets,
        "op2_impact_topk": op2_impact_topk,
        "op3_content_addressed_warc": op3_content_addressed_warc,
        "op4_quality_cascade": op4_quality_cascade,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_pair_index_bpe": op6_pair_index_bpe,
        "op7_transducer_counts": op7_transducer_counts,
        "op8_sstable_shards": op8_sstable_shards,
        "op9_boosted_pii": op9_boosted_pii,
        "op10_order_minhash": op10_order_minhash,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_impact_topk": topk.SQL,
        "op3_content_addressed_warc": warc.SQL,
        "op4_quality_cascade": quality.SQL,
    }
