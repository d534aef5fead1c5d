"""The training-data pipeline: quality rules, n-gram Jaccard join, PII, mixing of sources, SentencePiece encoding.

Every stage takes (spark, docs, sf_dir), works on all rows it is given, and returns the columns of ``documents``;
the last adds ``pieces`` and ``n_pieces``. Rows may repeat after mixing, once for each copy that the mix takes.
Its rows depend on divergences and sampled segmentations, which SQL can't express.
"""

from pyspark.sql import functions as F

from ledgerloom.llm import mixing, ngram_join, pieces, pii, quality

ORACLE_SQL = None


def quality_rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality.rate(docs).where("kept").select(*docs.columns)


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near duplicates stays."""
    return ngram_join.keep_one(docs)


def redact(spark, docs, sf_dir):
    """Personal data is replaced by the name of its kind."""
    return pii.redact(docs)


def mix(spark, docs, sf_dir):
    """Each document is emitted as often as the mix takes it."""
    mixed = mixing.mix(docs)
    return mixed.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def encode(spark, docs, sf_dir):
    """Sampled segmentation into pieces, keyed by the document."""
    return pieces.encode(docs)


STAGES = [("quality", quality_rules), ("jaccard", jaccard_join), ("pii", redact), ("mixing", mix), ("sentencepiece", encode)]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
