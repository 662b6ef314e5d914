"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of ``documents``:

1. classify   - documents unlike the labelled good ones go;
2. exact      - of equal texts one row stays;
3. near       - of each SimHash class one document stays;
4. repeats    - 50-byte strings that an earlier document has too are cut out;
5. pack       - what is left is packed into sequences of 4096 tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from coweave.llm import classifier, exact_dedup, packing, simhash, suffix_dedup
from coweave.llm.common import with_package
from coweave.session import cut_lineage
from coweave.sources.testdata import table

# No SQL: stages 1, 3, 4 and 5 are not expressible in it; see tests/llm.
ORACLE_SQL = None


@with_package
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: importance resampling towards the labelled rows."""
    return classifier.keep_target_like(docs, table(spark, sf_dir, "labels"))


@with_package
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: the row with the largest doc_id of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs)


@with_package
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: 3-word shingles, at most 3 differing bits."""
    return simhash.keep_class_representatives(docs, 3, 3)


@with_package
def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup of 50-byte strings."""
    return suffix_dedup.drop_repeats(docs, 50)


@with_package
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: one row per piece with its place."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("classify", classify), ("exact", exact), ("near", near), ("repeats", repeats), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two is written once."""
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
