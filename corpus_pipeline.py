"""A pipeline over documents: each stage works on all that the one before it kept.

toxicity (rejected documents go), MinHash near-dedup (one document of each
group stays), secret scans (secrets are replaced), mixing sources to target
weights (documents in training order, as often as they are taken), and
SentencePiece encoding and decoding. Stages take a session, documents and the
folder of the tables; all but the last return the columns of documents.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from editwake.llm.collisions import drop_near_duplicates
from editwake.llm.common import prepare, table, written
from editwake.llm.curriculum import mixed_documents
from editwake.llm.pieces import encode_documents
from editwake.llm.secret_scan import redact
from editwake.llm.toxicity import drop_toxic, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels does not find toxic."""
    return drop_toxic(docs, train(docs, table(prepare(spark), sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, 80 percent alike."""
    prepare(spark)
    return drop_near_duplicates(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced."""
    prepare(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    prepare(spark)
    return mixed_documents(docs, weights=(1, 2, 3))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mixed documents, in training order.

    Documents have no column for the position, but the files of a written table
    are numbered in its order, and so are the rows of a file. Spark reads files
    in another order; the short results are sorted back. Rows that are read from
    no files come as they are.
    """
    prepare(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    place = ("_file", "_row")
    try:
        placed = docs.withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
        placed.schema  # fails here without files
    except AnalysisException:
        return encode_documents(docs, model)
    return encode_documents(placed, model, keep=place).orderBy(F.length("_file"), *place).drop(*place)


STAGES = [
    ("toxicity", toxicity),
    ("minhash_near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("source_mixing", mixing),
    ("sentencepiece", sentencepiece),
]

# A trained model and a merge encoding are not SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last as a written table."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
