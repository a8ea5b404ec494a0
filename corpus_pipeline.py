"""Corpus pipeline over ``documents``: five stages, each one operator of ``tabvet.llm``.

1. language ID: rows without a recognisable language (``und``) go; ``lang`` becomes the
   predicted language. Where no row is labelled, no language can be learned: rows without
   a letter go, the others stay with their ``lang`` as it is;
2. MinHash near-dedup: one document of each group stays, and one of equal rows;
3. benchmark decontamination: contaminated documents go;
4. mixing: documents stand as often as the mix takes them, plus one row of further words;
5. token ids: the mix is encoded, written in blocks and read back.

Every stage sees the whole of what the one before kept. Rows are judged and removed as
rows: ids may be null or repeated, in the input as after the mix, and a row never goes
because another one has its id. Rows with null texts go in stage 1; texts without words
are copies of nothing. An empty table stays empty. Further columns may have any name.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm import decontaminate, language_crf, minhash_dedup, mixing, token_ids
from tabvet.llm.common import in_shared_folder, small_batches, table
from tabvet.llm.row_keys import RowKeys


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    field = language_crf.learn(docs.where(~language_crf.held_out() & F.col("doc_id").isNotNull()))
    if not field.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # Columns by place, so that none clashes with those of the operator.
    own = docs.toDF(*[c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    judged = language_crf.identify(own, field).where(F.col("lang_pred") != language_crf.UND)
    return judged.select(*[F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in zip(docs.columns, own.columns, strict=True)])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = RowKeys(docs)
    gone = minhash_dedup.near_duplicates(keys.texts()).where("NOT kept").select("doc_id").distinct()
    return keys.one_each_without(in_shared_folder(gone, "gone"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keys = RowKeys(docs)
    found = decontaminate.judged(decontaminate.contamination(keys.texts(), table(spark, sf_dir, "benchmark")))
    return keys.without(in_shared_folder(found.where("contaminated").select("doc_id").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    blocks = token_ids.write_token_ids(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read_token_ids(blocks, with_ids=False)


STAGES = [("language_id", language), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("mixing", mix), ("token_ids", encode)]

#: The fitted field and the tokenizer are beyond SQL; tests/llm holds the stages in a row against brute force (the mix by its operator).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = in_shared_folder(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
