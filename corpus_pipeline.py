"""A training corpus from ``documents``: good documents, one of each near-duplicate group, mixed by weight, as token ids.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's docs. All but
the last keep the columns of ``documents``. ``run`` applies them in turn.

The mixture takes as many tokens as the corpus has left, from each source at most
twice; a document that is taken twice is two rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import bpe, mixing, quality, simhash
from changelens.llm.common import bound_batches, checkpoint, table
from changelens.llm.queries import MIX_EPOCHS, MIX_PATH, MIX_SEED, MIX_WEIGHTS, TRAIN

TOKENIZER = "byte_bpe_50k.tiktoken"
SHINGLE, SIMILARITY = 5, 0.8
MIX_PERCENT = 100


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score reaches the threshold.

    The score is of the text alone: a null text counts as empty, and an empty one has a score too. Repeated rows and rows with
    equal texts stay or go together; null ids are scored like others, but teach nothing. An empty table keeps
    nothing; without labels of both classes the score is their share. Extra columns, whatever their names, stay as they are.
    """
    bound_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), TRAIN)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id.

    Texts link by their sets of five words at a similarity of 0.8, as they are, in any order. Null and empty texts are near copies of one another, as are texts
    without words. Of repeated rows one stays; of rows with one id and texts that aren't alike, all. Rows without an id come after those with
    one, in a fixed order. Ids are whole numbers below 2^62. Extra columns, whatever their names, stay as they are, and tell rows apart.
    """
    bound_batches(spark)
    return simhash.keep_one_similar(docs, words=SHINGLE, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them: not at all, once or twice, a row each time.

    Texts count by their words, so a null or empty one costs nothing; null sources and languages are leaves of their own. Places in a leaf go by
    a seeded digest of the id: rows with one id, repeated or not, are taken or left together, and so are all without one. An
    empty table gives no rows. Extra columns, whatever their names, stay as they are.
    """
    return mixing.mix(docs, MIX_PATH, MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to its very bytes.

    A row for each row, repeated ones too; a null or empty text has no ids and is exact. Extra columns aren't returned, whatever their names; null ids, languages and sources stay null.
    """
    bound_batches(spark)
    ranks = bpe.read_ranks(spark, public_tokenizers.path(TOKENIZER))
    out = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "exact")


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("tokens", tokenize)]

#: A trained discriminant, XXH64 and byte-pair merges have no SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else checkpoint(docs), sf_dir)
    return docs
