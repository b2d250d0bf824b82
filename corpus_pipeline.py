"""Corpus pipeline: language identification, near-duplicate removal, secret redaction, source mixing and piece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. All of them take
empty tables (and return no rows), texts of any length, rows without id, source or lang, and repeated rows; columns other than
those of documents are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import language, mixing, ngram_join, pieces, secret_scan
from corvane.llm.common import checkpointed
from corvane.llm.entries import tokenizer
from corvane.session import shared_folder, ship_code

MODEL = "piece_bpe_32k.model"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """lang becomes the predicted language; documents without a letter (null and empty texts are such) go. Where nothing could be
    learned, as no row has a lang, documents keep what they have. Repeated rows stay as often as they are; ties as in ``language``."""
    ship_code(spark)
    model = tokenizer(MODEL)
    counts = language.learn(docs, model, language.crc_remainder("doc_id") != 0)
    langs, p = language.probabilities(counts, language.vocabulary(model).start)
    found = language.predict(docs, model, langs, p, extra=("text", "lang", "source", "n_chars"))
    lang = F.when(F.col("lang_pred") == "und", F.col("lang")).otherwise(F.col("lang_pred"))
    return found.filter("n_words > 0").select("doc_id", "text", lang.alias("lang"), "source", "n_chars")


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents stays: of the rows of the class that leads it (the one with the smallest doc_id) the
    one with that doc_id, of several such the one with the smallest hash. Rows without an id are in groups like others, and lead
    one only if no row in it has an id. Documents without a word are linked with nothing, and stay."""
    ship_code(spark)
    keyed = docs.select(*COLUMNS).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = ngram_join.grouped(keyed, keep=("row_key",))
    same = found.groupBy("doc_id", "row_key", "cls", "lead", "component_id").agg(F.count("*").alias("n"))
    led = same.filter("cls = lead AND doc_id <=> component_id").groupBy("lead").agg(F.min(F.struct("row_key", "doc_id", "n")).alias("k")).select("k.*")
    kept = led.withColumn("wordless", F.lit(False)).unionByName(same.filter("cls IS NULL").select("row_key", "doc_id", "n", F.lit(True).alias("wordless")))
    kept = checkpointed(kept.withColumnsRenamed({"row_key": "kept_key", "doc_id": "kept_id"}))
    rows = keyed.join(kept, (F.col("row_key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_id")))
    once = rows.filter("n = 1 OR wordless")
    if kept.filter("n > 1 AND NOT wordless").isEmpty():  # no row is there twice: nothing is left to drop
        return once.select(*COLUMNS)
    return once.select(*COLUMNS).unionByName(rows.filter("n > 1 AND NOT wordless").dropDuplicates(["row_key", "doc_id"]).select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets found in texts become a mark; no document goes. Null texts stay null, n_chars follows the text (null for none)."""
    score = secret_scan.train(secret_scan.weak_labels(docs))
    clean = secret_scan.redact(docs.select(*COLUMNS), score)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents: each as often as a pass took something of it, its text cut to what was taken. Documents without a word
    have nothing to take, and are not in it; null is a source like another, the last."""
    ship_code(spark)
    drawn = mixing.Mix(docs).drawn_texts()
    return drawn.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (comma-joined) and the digests of ids and decoded text, for every row; a null text is encoded as an empty one."""
    ship_code(spark)
    return pieces.encode(docs, tokenizer(MODEL)).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]
#: None: merge rounds, forests and permutations have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again."""
    docs, own = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark, 'spark-pipeline-')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{own}/{name}")
        docs = spark.read.parquet(f"{own}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
