"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .archives import archive_round_trip
from .chat import rotate
from .common import UPPER, fresh_dir, table
from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .html_text import extract
from .jaccard_join import jaccard_classes
from .langid import fit, identify
from .packing import pack
from .pieces import decode, encode
from .repair import repaired_report
from .secrets import scan
from .token_files import read_files, write_files
from .whitening import whiten


def op1_chat_rotation(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))


def op2_html_text(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op4_token_files(spark, sf_dir):
    import public_tokenizers

    out = fresh_dir(spark, "token-files")
    files = write_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out)
    return read_files(spark, files, out)


def op10_archives(spark, sf_dir):
    return archive_round_trip(spark, table(spark, sf_dir, "pages"), fresh_dir(spark, "archives"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_length_buckets(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_encoder=True)


def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("ids"))
    docs = decode(encode(texts, path, column="ids"), path)
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark, sf_dir):
    return repaired_report(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS content, coalesce(turn // 64, -1) AS segment,
         CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, alone, segment ORDER BY turn NULLS FIRST, role, content) - 1 AS rn FROM t),
people AS (SELECT DISTINCT conv_id, alone, role AS perspective FROM t WHERE role <> 'system'),
shown AS (
  SELECT p.conv_id, p.alone, perspective, segment, rn // 64 AS part, rn, content, role = perspective AS own,
         CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user ' || role || '|>' END || chr(10) AS head
  FROM placed p JOIN people q ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.alone IS NOT DISTINCT FROM q.alone),
walked AS (
  SELECT *, coalesce(sum(length(head) + length(content) + 1) OVER (PARTITION BY conv_id, alone, perspective ORDER BY segment, rn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM shown)
SELECT conv_id, perspective, segment, part, count(*) AS n_turns, CAST(min(pos) AS BIGINT) AS start, string_agg(head || content || chr(10), '' ORDER BY rn) AS text,
       coalesce(list([CAST(pos + length(head) AS BIGINT), CAST(pos + length(head) + length(content) AS BIGINT)] ORDER BY rn) FILTER (WHERE own), []) AS mask,
       CAST(coalesce(sum(length(content)) FILTER (WHERE own), 0) AS BIGINT) AS n_masked
FROM walked GROUP BY conv_id, alone, perspective, segment, part
"""

OP9_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM t
"""

OP8_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (
  SELECT item_id, list_distinct(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s, least(len(w), 5) AS width
  FROM item_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS g
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM doc_words, (SELECT DISTINCT width FROM items) WHERE len(w) >= width)),
item_shingles AS (SELECT item_id, width, len(s) AS n, unnest(s) AS g FROM items)
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared, round(count(*) / n, 6) AS containment
FROM doc_shingles JOIN item_shingles USING (width, g)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 75
"""


def queries():
    return {
        "op1_chat_rotation": op1_chat_rotation,
        "op2_html_text": op2_html_text,
        "op3_secret_scan": op3_secret_scan,
        "op4_token_files": op4_token_files,
        "op10_archives": op10_archives,
        "op5_language_id": op5_language_id,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_length_buckets": op7_length_buckets,
        "op8_decontamination": op8_decontamination,
        "op9_exact_dedup": op9_exact_dedup,
        "op11_sentencepiece": op11_sentencepiece,
        "op12_whitening": op12_whitening,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql():
    return {"op1_chat_rotation": OP1_SQL, "op8_decontamination": OP8_SQL, "op9_exact_dedup": OP9_SQL}
