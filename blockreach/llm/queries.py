"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from blockreach.llm import alignment, bpe, byte_bpe, decontaminate, language, ranked_search, secrets, sharding, simhash, sketches, token_files, toxicity, warc
from blockreach.llm.common import id_remainder, table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = "word_bpe_49k.json"
WORD_BPE_SIZE = 49_408
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 2


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that gives the same rows if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary_path() -> str:
    """Where the installed public vocabulary lies (the same on every node)."""
    import public_tokenizers

    return public_tokenizers.path(WORD_BPE)


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Encode all documents into shards, look every key up in the index and read the ids back."""
    files = token_files.write_token_files(table(spark, folder, "documents"), token_files.library_encoder(vocabulary_path()), WORD_BPE_SIZE, END_OF_DOCUMENT)
    return files.read(files.lookup(files.documents), "ids_crc32 bigint", token_files.crc32_of_ids).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document, learned from labels of documents whose id remainder is not 2."""
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels").select("doc_id", "toxic")
    sample = toxicity.sample_labelled(documents, labels.where(id_remainder(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return toxicity.score_documents(documents, toxicity.learn(sample)).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_bpe")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.encode_documents(table(spark, folder, "documents"), vocabulary_path(), with_text=False)


def language_model(spark: SparkSession, documents: DataFrame) -> language.LanguageModel | None:
    """Learned from documents whose id remainder is not 1."""
    return language.learn(documents, id_remainder(documents["doc_id"], 3) != 1)


@query("op4_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    documents = table(spark, folder, "documents")
    found = language.identify(documents, language_model(spark, documents))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_near_duplicates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("items")


@query("op9_secrets")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document, with linked parts of credentials."""
    return secrets.find_secrets(table(spark, folder, "documents")).drop("base", "linked")


@query("op10_fingerprints")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of every document, of its edited text and of the next document."""
    return sketches.fingerprints(table(spark, folder, "documents"))


@query("op7_shards", f"""
WITH d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), levels AS (
  SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, h >> (60 - depth) AS node FROM d, range(0, 41) AS r(depth)
), sizes AS (
  SELECT depth, node, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n FROM levels GROUP BY depth, node
)
SELECT doc_id, n_bytes, arg_min(depth || ':' || node, depth) AS shard, min(depth) AS depth, arg_min(shard_bytes, depth) AS shard_bytes
FROM levels JOIN sizes USING (depth, node)
WHERE shard_bytes <= {sharding.SHARD_BYTES} OR n = 1
GROUP BY doc_id, n_bytes
""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document."""
    return sharding.shard_rows(table(spark, folder, "documents"))


# Damage of the audited replica: another last byte in one record of 40, an unreadable first line in one of 60.
FLIPPED, LOST = 40, 60


@query("op8_warc_audit", f"""
WITH p AS (
  SELECT page_id, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CAST(ceil((SELECT count(*) FROM pages) / {warc.FILE_RECORDS}) AS BIGINT) AS files
  FROM pages
), w AS (
  SELECT page_id, h, h % greatest(files, 1) AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10) ||
         'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head, html
  FROM p
), s AS (
  SELECT page_id, h, file, head, html, sha256(head || html || chr(13) || chr(10) || chr(13) || chr(10)) AS digest,
         strlen(head) + strlen(html) + 4 AS size
  FROM w
), a AS (
  SELECT page_id, h, file, digest, CAST(sum(size) OVER (PARTITION BY file ORDER BY page_id, digest ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end", size FROM s
), l AS (
  SELECT *, "end" - size AS start FROM a
), r16 AS (
  SELECT file, start >> 16 AS node, sha256(string_agg(start || ':' || "end" || ':' || digest, ',' ORDER BY start)) AS hash FROM l GROUP BY 1, 2
), r20 AS (
  SELECT file, node >> 4 AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM r16 GROUP BY 1, 2
), r24 AS (
  SELECT file, node >> 4 AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM r20 GROUP BY 1, 2
), roots AS (
  SELECT file, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS root FROM r24 GROUP BY 1
)
SELECT page_id, file, CAST(start AS BIGINT) AS start, "end", digest, root,
       CASE WHEN h % {LOST} = 1 THEN 'missing' WHEN h % {FLIPPED} = 0 THEN 'corrupt' ELSE 'same' END AS status
FROM l JOIN roots USING (file)
""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of a replica whose records are damaged by bytes: every record with its place, its file's root and its status."""
    bits = sharding.leading_bits(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    lost = bits % LOST == 1
    records = written(warc.archived(table(spark, folder, "pages"), other=F.sha2(warc.damaged(F.col("record"), bits % FLIPPED == 0, lost), 256)), "archive")
    stored = records.drop("other")
    # A record whose first line is unreadable does not come back from a file; the records after it do.
    replica = records.where(~lost).withColumn("digest", F.col("other")).drop("other")
    trees = warc.tree(stored), warc.tree(replica)
    found = warc.differing_records(stored, replica, *trees)
    roots = trees[0][-1].select("file", F.col("hash").alias("root"))
    return (
        stored.join(found, ["file", "start"], "full").join(roots, "file", "left")
        .select("page_id", "file", "start", "end", "digest", "root", F.coalesce("status", F.lit("same")).alias("status"))
    )


@query("op11_token_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of byte-level and piece tokens of every document."""
    import public_tokenizers as tokenizers

    return alignment.align_documents(
        table(spark, folder, "documents"), tokenizers.path(BYTE_BPE), tokenizers.PATTERN, tokenizers.path(PIECE_BPE), with_groups=False)


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM_SQL = "regexp_extract_all(translate({}, '" + UPPER + "', '" + UPPER.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_ranked_search", f"""
WITH t AS (SELECT doc_id, unnest({TERM_SQL.format("text")}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (SELECT DISTINCT item_id, unnest({TERM_SQL.format("text")}) AS term FROM benchmark),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n_docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), totals GROUP BY item_id, doc_id
), r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {ranked_search.TOP}
""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The best documents of every benchmark item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_byte_bpe")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Byte-level encoding and decoding of every document, long ones in overlapping chunks."""
    import public_tokenizers

    return byte_bpe.encode_documents(table(spark, folder, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, with_text=False)


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    # The pipeline module imports this one.
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
