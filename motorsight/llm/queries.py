"""The thin ``opN_<name>`` queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, linededup, mixing, ngramjoin, packing, prefixtrie, quality, records, simhash, toxicity, warc, whitening
from .common import new_folder, stage, table

WORD_END_ID = 1
BYTE_END_ID = 0
SEQUENCE_TOKENS = 2048
WARC_LEAST_BYTES = 0
#: Shares of sources in the mix; sources that are not named weigh 1.
MIX_WEIGHTS = {"src0": 6.0}
MIX_SEED = 20
HOSTILE = "\\### Assistant: </turn> ok"
SIMHASH_SHINGLE = 3
SIMHASH_RADIUS = 3
JACCARD_SHINGLE = 3
JACCARD_PERCENT = 90


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page as a WARC record, then read records and payloads back and measure them."""
    folder = new_folder(spark, "op1")
    warc.write_archive(table(spark, sf_dir, "pages"), folder, WARC_LEAST_BYTES)
    back = warc.originals(spark, folder)
    return back.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                       warc.sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole document by two character models learned from the labels."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replicate every document by its source's target weight and shuffle the copies."""
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SEED)


def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as framed binary records and read them back through the index."""
    folder = new_folder(spark, "op4")
    index = records.write_records(table(spark, sf_dir, "documents"), folder,
                                  public_tokenizers.path("word_bpe_49k.json"), "word", WORD_END_ID, 2)
    back = records.read_records(index, folder)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and link fingerprints of at most 3 differing bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SIMHASH_SHINGLE, SIMHASH_RADIUS)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every row whose id is divisible by 50."""
    return ann.search(table(spark, sf_dir, "embeddings"), 5, F.col("vec_id") % 50 == 0)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every whole document by the base rules and the compression bands."""
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format every conversation and a hostile one, write the examples, read them back and measure them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                    F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    back = stage(chat.examples(rows.unionByName(hostile)), "op8", compression="zstd")
    turns = chat.parse(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    each = back.select(
        "conv_id", "alone", F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("complete"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(said, 256).alias("sha"))).alias("whole"),
        F.when(F.col("target").isNotNull(), F.struct("target", loss.alias("text"))).alias("loss"))
    by = each.groupBy("conv_id", "alone").agg(
        F.max("whole").alias("whole"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"))
    text = F.array_join("loss.text", "")
    return by.select("conv_id", F.col("whole.n").alias("n_turns"), F.col("whole.sha").alias("turns_sha256"),
                     F.length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove later occurrences of three-line windows from every document."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents"), removed_col="n_removed_lines")
    return out.select("doc_id", "text", "n_removed_lines")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into as few sequences of 2048 tokens as the matching finds."""
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  "byte", BYTE_END_ID, SEQUENCE_TOKENS)
    return packing.pack(pieces, SEQUENCE_TOKENS)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whiten every embedding by the leading 8 components of all of them."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations, one row per distinct prefix."""
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngramjoin.jaccard_groups(table(spark, sf_dir, "documents"), JACCARD_SHINGLE, JACCARD_PERCENT)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_mixing": op3_mixing,
    "op4_records": op4_records,
    "op5_simhash": op5_simhash,
    "op6_neighbours": op6_neighbours,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_line_dedup": op9_line_dedup,
    "op10_packing": op10_packing,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ngram_join": op13_ngram_join,
}

SQL: dict[str, str] = {
    "op1_warc": """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST) AS n,
         first(page_id) OVER (PARTITION BY payload ORDER BY page_id NULLS LAST, url NULLS LAST) AS first_id FROM p)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes,
       list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31) + 1, 1) FOR i IN range(0, 32)],
         'string_agg', '') AS payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first_id END AS refers_to
FROM r
""",
    "op3_mixing": f"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size,
         CASE WHEN source = 'src0' THEN {MIX_WEIGHTS["src0"]}::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM documents GROUP BY source),
rates AS (
  SELECT source, size, CASE WHEN size > 0 THEN (SELECT sum(size) / sum(weight) FROM sizes) * weight / size ELSE 1.0 END AS rate
  FROM sizes),
parts AS (SELECT *, greatest(ceil(rate / {mixing.STEP}), 1)::INT AS steps FROM rates),
cdf AS (
  SELECT source, 0 AS k, exp(-rate / steps) AS p, exp(-rate / steps) AS c FROM parts WHERE size > 0
  UNION ALL
  SELECT cdf.source, k + 1, p * (rate / steps) / (k + 1), c + p * (rate / steps) / (k + 1)
  FROM cdf JOIN parts ON cdf.source IS NOT DISTINCT FROM parts.source WHERE k + 1 < {mixing.TABLE}),
tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, CASE WHEN t.cs IS NULL THEN 1 ELSE list_sum([
    len([c FOR c IN t.cs IF c <= ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || i), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE]) FOR i IN range(1, p.steps + 1)]) END AS n
  FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
  LEFT JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, text, lang, source, n_chars, copy,
       ('0x' || substr(md5('{MIX_SEED}s|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(0, n::BIGINT))::INT AS copy FROM drawn WHERE n > 0)
""",
    "op8_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
o AS (
  SELECT *, length(role) + length(text) + 15 + length(regexp_replace(role, '[^\\\\<#:]', '', 'g'))
            + length(regexp_replace(text, '[^\\\\<#]', '', 'g')) - 1 AS chars FROM c),
w AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) AS back FROM o)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(CASE WHEN role = 'assistant' OR back = 1 THEN upto END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
""",
    "op9_line_dedup": """
WITH lines AS (
  SELECT d.doc_id, u.pos - 1 AS pos, u.line, trim(u.line, ' ' || chr(9) || chr(13)) AS word
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL) d,
       LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line,
                       generate_subscripts(string_split(d.text, chr(10)), 1) AS pos) u),
windows AS (
  SELECT * FROM (
    SELECT doc_id, pos AS a, lead(pos, 2) OVER w AS b, word AS x, lead(word) OVER w AS y, lead(word, 2) OVER w AS z
    FROM lines WHERE word <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  WHERE b IS NOT NULL),
later AS (
  SELECT * FROM (SELECT doc_id, a, b, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, a) AS n FROM windows)
  WHERE n > 1),
gone AS (SELECT DISTINCT l.doc_id, l.pos FROM lines l JOIN later r ON l.doc_id = r.doc_id AND l.pos BETWEEN r.a AND r.b),
kept AS (
  SELECT l.doc_id, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS text, count(g.pos) AS gone
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.gone, 0)::BIGINT AS n_removed_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op12_prefix_trie": """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(conv_id::VARCHAR, '')]) AS b
  FROM (SELECT DISTINCT conv_id FROM t)),
crc AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], b::BIGINT[]),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END), 4294967295::BIGINT) % 6 AS h
  FROM bits),
b AS (
  SELECT crc.conv_id, t.pos, t.role, t.text FROM crc JOIN t ON t.conv_id = crc.conv_id - crc.conv_id % 100 AND t.pos <= h
  UNION ALL SELECT t.conv_id, t.pos, t.role, t.text FROM t JOIN crc ON t.conv_id = crc.conv_id AND t.pos > h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars,
         sha256(string_agg(octet_length(encode(role)) || ':' || role || octet_length(encode(text)) || ':' || text, '') OVER w) AS path
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
ends AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
n AS (
  SELECT depth, path, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(e.conv_id::VARCHAR, ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM p LEFT JOIN ends e USING (conv_id, depth) GROUP BY depth, path),
kids AS (
  SELECT u.path, u.depth, count(*) AS n_children FROM n c JOIN p u ON u.conv_id = c.conv_id AND u.depth = c.depth - 1 GROUP BY u.path, u.depth),
nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (path, depth)),
below AS (
  SELECT a.path, a.depth, count_if(x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM nodes x JOIN p a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY a.path, a.depth)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (path, depth) LEFT JOIN p up ON up.conv_id = n.conv_id AND up.depth = n.depth - 1
LEFT JOIN n u ON u.path = up.path AND u.depth = up.depth
""",
    "op13_ngram_join": f"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {JACCARD_SHINGLE} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i : i + {JACCARD_SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {JACCARD_SHINGLE - 2})]) END AS g
  FROM words),
grams AS (SELECT rid, len(g) AS n, unnest(g) AS g FROM sets),
pairs AS (
  SELECT a.rid AS a, b.rid AS b FROM grams a JOIN grams b ON a.g = b.g AND a.rid <> b.rid
  GROUP BY a.rid, b.rid, a.n, b.n HAVING 100 * count(*) >= {JACCARD_PERCENT} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT rid, rid FROM sets UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, m.component_id
FROM sets s JOIN (SELECT r.a, min(t.doc_id) AS component_id FROM reach r JOIN sets t ON r.b = t.rid GROUP BY r.a) m ON s.rid = m.a
""",
}
