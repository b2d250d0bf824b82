"""Registered queries of the llm operators: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import chat, fingerprint, language, licenses, line_dedup, mixing, neighbors, ngram_join, pieces, secret_scan, sharding, spelling, turn_repair
from corvane.session import ship_code, table


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file: in CORVANE_TOKENIZERS if that is set, else where the package has it."""
    if folder := os.environ.get("CORVANE_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.findings(docs, secret_scan.train(secret_scan.weak_labels(docs)))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), byte_limit=16 << 20)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return neighbors.nearest(table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return mixing.Mix(table(spark, sf_dir, "documents")).taken()


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    said = "\\### Assistant: </turn> ok"
    more = spark.sql("SELECT -7L AS conv_id, turn, role FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)").withColumn("text", F.lit(said))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_turns(rows, window=16))  # its template renders each turn by itself


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return pieces.encode(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), texts=False)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    found = language.identify(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return found.select("doc_id", F.coalesce(language.crc_remainder("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_words")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.damaged(spelling.runs(table(spark, sf_dir, "documents")))
    return spelling.group_variants(spelling.counted(runs))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return turn_repair.digests(turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")), here="here"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_shards, op3_licenses, op4_neighbors, op5_mixing, op6_chat, op7_sentencepiece, op8_language, op9_ngram_join, op10_fingerprints, op11_line_dedup, op12_spelling, op13_turn_repair)}


def shards_sql(byte_limit: int, bits: int = 12) -> str:
    """The shards of op2 for tables of at most 2^bits buckets without repeated rows."""
    return f"""WITH h AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
    n AS (SELECT b AS bits, h >> (60 - b) AS first, sum(bytes) AS shard_bytes, count(*) AS shard_rows, min(h) = max(h) AS alike FROM h, range({bits + 1}) t(b) GROUP BY ALL),
    leaf AS (SELECT doc_id, bytes, h, min(bits) AS bits FROM h JOIN n ON n.first = h >> (60 - n.bits) WHERE shard_bytes <= {byte_limit} OR alike GROUP BY ALL)
    SELECT doc_id, bytes, CAST(leaf.bits AS INTEGER) AS bits, CASE WHEN leaf.bits = 0 THEN '' ELSE lpad(to_base(n.first, 2), CAST(leaf.bits AS INTEGER), '0') END AS shard, CAST(0 AS BIGINT) AS part,
    CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_rows FROM leaf JOIN n ON n.bits = leaf.bits AND n.first = h >> (60 - leaf.bits)"""


JOIN_SQL = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM w, unnest(range(1, greatest(len(w) - 3, 2))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * same >= 75 * (p.n + q.n - same)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

LINES_SQL = """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM s),
l AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM u),
r AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT l.*, r.last IS NOT NULL AND doc_id <> r.last AS gone FROM l LEFT JOIN r ON l.k = r.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

#: The others have no SQL form (forests, projections, permutations, merge rounds, sketches); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_shards": shards_sql(16 << 20), "op9_ngram_join": JOIN_SQL, "op11_line_dedup": LINES_SQL}
