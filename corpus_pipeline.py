"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from pyspark.sql import functions as F

from planeloom.llm import bpe, language_id, mixing, near_copies, suffix_dedup
from planeloom.llm.components import small_batches, stored


#: Bytes of a passage that goes where it repeats: below fifty words of four letters and a space.
PASSAGE = 200


def identify(spark, docs, sf_dir):
    """Language ID: rows without a language (null text, no letters) go; a null lang becomes the predicted one.

    Where no row trains (an empty table, lang null throughout) all rows with letters stay as they are.
    """
    small_batches(spark)
    return language_id.identified(docs, language_id.fit(docs))


def near_dedup(spark, docs, sf_dir):
    """SimHash near-dedup: of near copies (five-word shingles, similarity 0.8 or more, and chains of such) one row stays.

    It is the row with the smallest doc_id, null ids last; of equal ids the one with the smaller hash of the row.
    """
    small_batches(spark)
    return near_copies.firsts(docs)


def cut_repeats(spark, docs, sf_dir):
    """Suffix-array dedup: bytes of passages of PASSAGE bytes or more that repeat go from the texts; n_chars follows."""
    small_batches(spark)
    cut = suffix_dedup.kept_texts(docs, PASSAGE)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix(spark, docs, sf_dir):
    """Mixing to target weights: rows as the budgets of their sources take them, repeated where epochs are.

    Rows without text have no tokens and go; repeated rows are taken each on their own. An empty table stays empty.
    """
    return mixing.mixed(docs).select(*docs.columns)


def encode(spark, docs, sf_dir):
    """BPE: counts and digests of ids and decoded text, a row for each row; an empty table gives none."""
    import public_tokenizers

    small_batches(spark)
    return bpe.bpe_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=100_000)


STAGES = [("language_id", identify), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", cut_repeats), ("mixing", mix), ("bpe", encode)]
#: SimHash and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name, "snappy")
    return STAGES[-1][1](spark, docs, sf_dir)
