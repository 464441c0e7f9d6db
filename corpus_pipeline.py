"""The corpus pipeline: language ID, near-dedup, substring dedup, personal data, packing.

Each stage takes all documents that the one before kept and returns documents again (doc_id, text, lang,
source, n_chars), the last one the packed pieces. run() writes each stage to the shared folder, so that
a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language, minhash, packing, personal, substrings
from corpusloom.llm.queries import piece_vocabulary, word_vocabulary
from corpusloom.llm.shared import discard, mark_tables, materialise, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SURE = 0.5
"""Texts whose best language has a lower posterior are rejected, as are those without a letter."""
REPEAT_WORDS = 50
"""Passages of so many words that an earlier document has too go."""
CAPACITY = 4096
PARTS = 150_000
"""Parts whose ids a worker of the last stage remembers: fewer than op1's, for the executor's heap has grown in the stages before."""


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language; lang becomes the predicted one."""
    model = language.train(docs, piece_vocabulary())
    known = language.predict(docs, model, keep=("text", "source", "n_chars")).where((F.col("lang_pred") != "und") & (F.col("score") >= SURE))
    return known.select("doc_id", F.col("_kept0").alias("text"), F.col("lang_pred").alias("lang"), F.col("_kept1").alias("source"), F.col("_kept2").alias("n_chars"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five-word shingles, similarity 0.8 or more), that of least id, and rows without an id.

    Rows of one id and different texts are documents of their own; rows that repeat both are one.
    """
    kept = minhash.near_duplicates(docs, 5, 80, bands=32).where("kept AND doc_id IS NOT NULL").select("doc_id", "text_key")
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    one = keyed.join(kept, ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return one.unionByName(keyed.where("doc_id IS NULL")).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long passages that an earlier document has too; documents of which nothing is left go."""
    done = substrings.remove(docs, REPEAT_WORDS, keep=("lang", "source"))
    left = done.where("n_removed = 0 OR n_removed < n_words")
    return left.select("doc_id", F.col("kept").alias("text"), "_kept.lang", "_kept.source", F.length("kept").cast("long").alias("n_chars"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets where personal data was."""
    found = personal.detect(docs, keep_text=True, keep=("lang", "source"))
    out = found.select("doc_id", personal.redact(found).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 4096 tokens."""
    return packing.pack(docs, word_vocabulary(), CAPACITY, cache_size=PARTS)


STAGES = [
    ("language ID", identify),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("personal data", redact),
    ("best-fit packing", pack),
]

#: No SQL can express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of sf_dir; once a stage's result is written, the tables it made and read are deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        began = mark_tables()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
            release(began, keep=docs)
            if before is not None:
                discard(before)
            before = docs
    return docs
