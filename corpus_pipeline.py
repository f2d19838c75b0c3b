"""Corpus pipeline over ``documents``: five stages, each on all that the one before kept.

language ID -> near-dedup -> benchmark decontamination -> mixing -> token files

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result
as Parquet in the shared checkpoint folder and rereads it, so a lost executor
costs one stage's tasks at most.

* language ID drops documents without recognisable language (no letters, a
  posterior under one half, or mostly characters of scripts foreign to the model); the model is
  trained on the stage's own labelled rows.
* near-dedup keeps one document of every component of SimHash fingerprints
  (three-word shingles) within three bits.
* decontamination drops documents with a ten-word window of a benchmark item.
* mixing repeats documents by Poisson counts towards smoothed source weights
  and shuffles them globally.
* token files encodes the mix and reads it back: doc_id, start, n_tokens, ids_crc32.

The language model and the fingerprints cannot be computed in SQL, so there is
no ORACLE_SQL; tests/llm/test_pipeline.py compares every stage with a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import base, decontam, langid, mixing, simhash, tokens


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, base.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(*tokens.write_tokens(docs, tokens.tokenizer_path()))


def _tuned(stage):
    def run_stage(spark, docs, sf_dir):
        return stage(base.tune(spark), docs, sf_dir)
    run_stage.__name__ = stage.__name__
    return run_stage


STAGES = [(f.__name__, _tuned(f)) for f in (language_id, near_dedup, decontamination, source_mixing, token_output)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = base.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            out = base.write_table(out, f"pipeline-{name}")
        if k:
            base.drop_table(docs)          # nothing reads it again: what follows reads written tables only
        docs = out
    return docs
