"""The thin queries opN_<name>: each applies its operator to the whole table and derives the columns of its contract."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkfold.llm import bpe, chat, classifier, collocations, concatenation, exact_dedup, html_extraction, packing, quality_rules, simhash, spelling, substring_dedup, warc
from inkfold.llm.common import materialize


BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chat_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; its turns come one after another, possibly over several batches."""
    state: list = []

    def done() -> list[tuple]:
        return [(state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])] if state else []

    def rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    for batch in batches:
        out: list[tuple] = []
        for conv, turn, role, text, loss, formatted in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_no", "role", "text", "loss_text", "formatted")), strict=True):
            if turn == 0:
                out += done()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += len(formatted)
        yield rows(out)
    yield rows(done())


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "conv_id bigint, turn bigint, role string, text string"
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], own)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = chat.format_conversations(rows, BYTE_BPE)
    out = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return chat.read_back(formatted, BYTE_BPE).mapInArrow(_chat_digests, out)


#: The template adds <s>, and [INST] [/INST] </s> to each turn; an escape is one character for each mark in a text.
OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, length(role) + length(text) + 17
    + len(regexp_extract_all(role || chr(10) || text, '<\\*/?s>|\[\\*/?INST\]')) AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) + 3 AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.bundles(table(spark, sf_dir, "pages")))
    return warc.records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32: the digest's 160 bits, 5 at a time.
OP3_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, min(page_id) AS f FROM p GROUP BY h),
d AS (
  SELECT h, f, octet_length(encode(h)) AS n,
    list_aggregate(list_transform(string_split_regex(sha1(h), ''), lambda x: lpad(bin(instr('0123456789abcdef', x) - 1), 4, '0')), 'string_agg', '') AS b
  FROM g)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr(b, i * 5 + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER))) AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to
FROM p JOIN d USING (h)
"""


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.measure(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: A repeat of k words is a window of k words found twice: five for the covered share, one more than both limits for the longest.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, len(w) AS n_words, greatest(50, len(w) * 15 // 100) + 1 AS beyond FROM d),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
win AS (
  SELECT doc_id, k, i, md5(array_to_string(w[i:i + k - 1], ' ')) AS h
  FROM (SELECT doc_id, w, k, unnest(range(1, n_words - k + 2)) AS i FROM (SELECT *, unnest([3, 5, beyond]) AS k FROM n))),
twice AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, h) AS c FROM win) WHERE c > 1),
words AS (SELECT doc_id, k, count(DISTINCT p) AS covered FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM twice WHERE k <= 5) GROUP BY ALL),
far AS (SELECT DISTINCT doc_id FROM twice WHERE k > 5),
m AS (
  SELECT n.doc_id, n.n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(a.covered, 0) AS n_repeat_words,
    coalesce(b.covered, 0) AS covered, far.doc_id IS NOT NULL AS too_long
  FROM n LEFT JOIN lines USING (doc_id) LEFT JOIN words a ON a.doc_id = n.doc_id AND a.k = 3 LEFT JOIN words b ON b.doc_id = n.doc_id AND b.k = 5 LEFT JOIN far ON far.doc_id = n.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * covered <= 30 * n_words AND NOT too_long AS kept
FROM m
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
dup AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM dup),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = classifier.fit(docs, labels.where(~held_out))
    found = classifier.score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _bpe_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists, texts = batch.column("ids"), batch.column("text").cast(pa.binary())
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ids, ends = memoryview(lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()), 4 * np.cumsum(n)
        cols = {
            "doc_id": batch.column("doc_id"),
            "n_tokens": pa.array(n),
            "ids_sha256": pa.array([hashlib.sha256(ids[a:b]).hexdigest() for a, b in zip((ends - 4 * n).tolist(), ends.tolist(), strict=True)], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in texts], pa.string()),
        }
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), BYTE_BPE)
    return bpe.decode(encoded, BYTE_BPE).mapInArrow(_bpe_digests, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM w)))
  GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT lang, phrase, k AS n_words, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS k FROM f WHERE k > 1),
s AS (
  SELECT c.lang, c.phrase, c.n_words, c.a, c.k, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS f
  FROM (SELECT *, unnest(range(1, n_words - m + 2)) AS i FROM (SELECT lang, string_split(phrase, ' ') AS w, n_words, a, unnest(range(2, n_words)) AS m FROM best))
  GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ USING (lang, phrase) WHERE inner_.f IS NULL OR 100 * CAST(inner_.f AS HUGEINT) < 80 * CAST(b.a AS HUGEINT))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def op13_concatenation_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concatenation.pieces(table(spark, sf_dir, "documents"), BYTE_BPE)


def queries() -> dict:
    own = (op1_chat_formatting, op2_exact_dedup, op3_warc, op4_html_extraction, op5_quality_rules, op6_simhash_near_dedup, op7_substring_dedup, op8_best_fit_packing, op9_quality_classifier, op10_bpe, op11_spelling_variants, op12_phrase_collocations, op13_concatenation_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict:
    return {"op1_chat_formatting": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op3_warc": OP3_SQL, "op5_quality_rules": OP5_SQL, "op7_substring_dedup": OP7_SQL, "op12_phrase_collocations": OP12_SQL}
