"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dupescope.llm import bpe, chat, langid, line_dedup, neighbours, packing, quality_model, quality_rules, simhash, spelling, suffix_tree, tokenfile, turn_repair
from dupescope.llm.common import bounded_batches, id_remainder, merged_partitions, table
from dupescope.llm.tokens import default_vocabulary
from dupescope.session import scratch_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs.coalesce(merged_partitions(docs)), default_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder("doc_id", 3) == 1
    dictionaries = langid.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), dictionaries, docs).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.margin", "p.rejected")


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree.language_model_scores(docs.coalesce(merged_partitions(docs)), id_remainder("doc_id", 10) != 0)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(both).alias("text"))
    chats = chat.format_chat(rows.unionByName(own)).select("conv_id", "formatted", chat.read_chat(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding in one pass over Arrow batches; only digests leave the workers."""
    bounded_batches(spark)
    vocabulary = default_vocabulary()
    encode, decode = bpe.encode_batches(vocabulary), bpe.decode_batches(vocabulary)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for b in decode(encode(batches)):
            ids = [np.frombuffer(x, dtype="<u4").tolist() for x in b["ids"].to_pylist()]
            yield pa.record_batch([b["doc_id"], pa.array(list(map(len, ids)), pa.int64()), pa.array([sha(" ".join(map(str, x))) for x in ids]), pa.array([sha(x) for x in b["decoded"].to_pylist()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("kept", F.lit(False)).alias("kept"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    tokenfile.write_token_files(table(spark, sf_dir, "documents"), path, default_vocabulary())
    read = tokenfile.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 4) == 2
    model = quality_model.fit(docs.where(~held_out), table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality_model.score(F.col("text"), model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Rows lost, emptied, cut short, doubled or given to the user, by the remainder of a checksum of ``conv_id:turn``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("how") == 3, 2).otherwise(1))))
    return rows.drop("col")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.summaries(turn_repair.repaired_turns(damaged_turns(conversations)))
    every = conversations.select(F.col("conv_id").alias("of")).distinct()
    longs = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, F.col("of").eqNullSafe(F.col("conv_id")), "left").select(F.col("of").alias("conv_id"), *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def misspelt(docs: DataFrame) -> DataFrame:
    """``word``: the runs of all texts, some of which lose a letter, by a checksum of ``doc_id:run``."""
    run, length = F.col("run"), F.length("run")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(F.col("h"), length).cast("int")
    rows = spelling.runs_of(docs, "text", "doc_id").select("run", h.alias("h"))
    return rows.select(F.when(F.pmod(F.col("h"), F.lit(97)) == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, length))).otherwise(run).alias("word"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(misspelt(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return spelling.spelling_groups(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", F.col("line_dedup.lines").alias("n_lines"), F.col("line_dedup.dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


REGISTRY = {
    "op1_packing": op1_packing,
    "op2_language_id": op2_language_id,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_bpe": op5_bpe,
    "op6_neighbours": op6_neighbours,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_files": op8_token_files,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_simhash": op10_simhash,
    "op11_turn_repair": op11_turn_repair,
    "op12_spelling": op12_spelling,
    "op13_line_dedup": op13_line_dedup,
}

#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op4_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(i)
), seen AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS begins,
         replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|') AS body,
         replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), '<' || chr(92) || '/|') AS head
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN begins THEN length('<|im_start|>') + length(head) + 1 + length('<|im_end|>') + 1 ELSE length('<|im_sep|>') END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id
""",
    "op12_spelling": r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), counted AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL
), coded AS (
  SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bytes FROM counted
), summed AS MATERIALIZED (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS h FROM coded
), words AS MATERIALIZED (
  SELECT word, sum(times)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM summed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), cut AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, min({'less': -other_n, 'form': other}) AS b FROM pairs GROUP BY word
), formed AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * n THEN b.form END AS form, CASE WHEN -b.less >= 2 * n THEN -b.less END AS form_n FROM words LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT walk.word, formed.form FROM walk JOIN formed ON formed.word = walk.at WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk w USING (word) JOIN formed l ON l.word = w.at AND l.form IS NULL
""",
    "op13_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, f.key IS NULL OR f.first_doc = k.doc_id AS stays FROM keyed k LEFT JOIN firsts f ON f.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE stays), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
