"""The corpus queries that __spark_entry__ registers, and their SQL."""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from .common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark) -> bytes:
    """The key of the surrogates: that in spark.palimpsest.surrogate.key, or a random one that this session keeps."""
    sc = spark.sparkContext
    if not (own := spark.conf.get("spark.palimpsest.surrogate.key", "")):
        own = sc._surrogate_key = getattr(sc, "_surrogate_key", None) or secrets.token_hex(32)
    return own.encode()


def op1_sentencepiece(spark, sf_dir, model_path=None):
    """doc_id, n_tokens, ids_crc32 of the ids, decoded_sha256 of the text decoded from them, per row of documents."""
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), model_path or vocabulary("piece_bpe_32k.model"))


def op4_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL_OP4 = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(list_zip(range(1, len(parts) + 1), parts)) AS z FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)) t,
       LATERAL (SELECT z[1] AS pos, z[2] AS line) u
), keys AS (
  SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS holder FROM lines WHERE length(key) >= 20 GROUP BY key
), judged AS (
  SELECT l.doc_id, l.pos, l.line, (k.key IS NOT NULL AND l.doc_id <> k.holder) AS gone
  FROM lines l LEFT JOIN keys k ON l.key = k.key AND k.n >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

def op7_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL_OP7 = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""

def op10_best_fit_packing(spark, sf_dir, tokenizer_path=None):
    from .packing import best_fit_packing

    return best_fit_packing(table(spark, sf_dir, "documents"), tokenizer_path or vocabulary("word_bpe_49k.json"))


def op3_exact_topk(spark, sf_dir):
    from .topk import exact_topk

    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL_OP3 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""

def op2_arc_to_warc(spark, sf_dir):
    from .warc import pages_through_archives

    found = pages_through_archives(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_pii_surrogates(spark, sf_dir, key=None):
    """doc_id, text (with surrogates), n_entities and kinds per row of documents; texts without entities are as they were."""
    from .pii import surrogates

    return surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key or surrogate_key(spark))


def op6_substring_dedup(spark, sf_dir):
    from .substring_dedup import substring_dedup

    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL_OP6 = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, list_aggregate(ws[i:i + 12], 'string_agg', ' ') AS seq FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)
), least AS (
  SELECT seq, min(doc_id) AS d FROM win GROUP BY seq
), hit AS (
  SELECT win.doc_id, win.i FROM win JOIN least USING (seq) WHERE least.d < win.doc_id
), word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 13)) AS k FROM hit)
), judged AS (
  SELECT word.doc_id, word.i, word.word, gone.i IS NOT NULL AS gone FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i
)
SELECT w.doc_id, count(j.i) AS n_words, count(*) FILTER (WHERE j.gone) AS n_removed,
       sha256(coalesce(string_agg(j.word, ' ' ORDER BY j.i) FILTER (WHERE NOT j.gone), '')) AS kept_sha256
FROM w LEFT JOIN judged j USING (doc_id) GROUP BY w.doc_id
"""


def op8_ngram_jaccard(spark, sf_dir):
    from .near_dup import ngram_jaccard_classes

    return ngram_jaccard_classes(table(spark, sf_dir, "documents"), words=3, t=(90, 100))


SQL_OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [list_aggregate(ws, 'string_agg', ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS grams FROM w
), g AS (
  SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM s
), c AS (
  SELECT min(doc_id) AS rep, n, key FROM (SELECT doc_id, len(grams) AS n, md5(list_aggregate(list_sort(grams), 'string_agg', chr(10))) AS key FROM s WHERE len(grams) > 0) GROUP BY n, key
), h AS (
  SELECT g.doc_id, g.n, g.gram FROM g JOIN c ON c.rep = g.doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), e AS (
  SELECT x, y FROM p UNION SELECT y, x FROM p UNION SELECT rep, rep FROM c
), r(x, y) AS (
  SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y
), top AS (
  SELECT x AS rep, min(y) AS least FROM r GROUP BY x
), k AS (
  SELECT doc_id, len(grams) AS n, md5(list_aggregate(list_sort(grams), 'string_agg', chr(10))) AS key FROM s
)
SELECT k.doc_id, k.n AS n_shingles, coalesce(top.least, k.doc_id) AS component_id FROM k LEFT JOIN c ON k.n > 0 AND c.n = k.n AND c.key = k.key LEFT JOIN top ON top.rep = c.rep
"""


def op9_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "n_passages")


SQL_OP2 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), g AS (
  SELECT page_id, payload, max(page_id) OVER (PARTITION BY payload) AS first FROM p
), h AS (
  SELECT *, sha1(payload) AS hex FROM g
), bits AS (
  SELECT page_id, payload, first, string_agg(format('{:04b}', ('0x' || c)::INTEGER), '' ORDER BY i) AS b
  FROM (SELECT page_id, payload, first, unnest(range(1, 41)) AS i, unnest(string_split(hex, '')) AS c FROM h) GROUP BY page_id, payload, first
)
SELECT page_id, strlen(payload) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + list_sum(list_transform(range(1, 6), lambda k: CASE WHEN substr(b, (5 * i + k)::BIGINT, 1) = '1' THEN (1 << (5 - k)::INTEGER) ELSE 0 END))::INTEGER, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits
"""


def op11_whitening(spark, sf_dir):
    from .whitening import whitened

    found = whitened(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long")).select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op12_chat_format(spark, sf_dir):
    """The conversations of the table, and -1, whose texts hold control strings of chat templates."""
    from .chat import chat_format, read_back

    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(chat_format(said.unionByName(trap))).select(F.col("tree_id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL_OP12 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(text, '', '\') AS b, replace(role, '', '\') AS r FROM t
), f AS (
  SELECT *, length(b) + len(regexp_extract_all(b, '</?s>|\[/?INST\]|<</?SYS>>')) AS n,
         length(r) + len(regexp_extract_all(r, '</?s>|\[/?INST\]|<</?SYS>>|
')) AS m FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' THEN n + 7 ELSE n + m + 14 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""


def op13_hard_negatives(spark, sf_dir):
    from .negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.withColumn("label", wrong), F.col("vec_id") % 100 == 0)


SQL_OP13 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id AS vec_id, list_dot_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_arc_to_warc": op2_arc_to_warc,
    "op3_exact_topk": op3_exact_topk,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_whitening": op11_whitening,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {"op2_arc_to_warc": SQL_OP2, "op3_exact_topk": SQL_OP3, "op4_line_dedup": SQL_OP4, "op6_substring_dedup": SQL_OP6, "op7_exact_dedup": SQL_OP7, "op8_ngram_jaccard": SQL_OP8, "op12_chat_format": SQL_OP12, "op13_hard_negatives": SQL_OP13}
