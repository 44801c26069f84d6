"""Registered queries of the operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import backoff, capfilter, decontam, minhash, phrases, replytrees, secrets, sentpiece, sharding, toxicity, veccodes, warczip, wordpieces
from veilspark.llm.common import table


def model_file() -> str:
    """The SentencePiece file of the public tokenizers; every operator takes another path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def bpe() -> tuple[bytes, str]:
    """Lines of the byte-level vocabulary, read by the driver, and its pattern."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return wordpieces.token_counts(table(spark, sf, "documents"), model_file())


def op3_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"), k=4)


def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warczip.archive_round_trip(table(spark, sf, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    coded = sentpiece.encode(table(spark, sf, "documents").select("doc_id", "text"), model_file())
    back = sentpiece.decode(coded, model_file())
    return back.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
                       (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("restored"))


def op6_embedding_caps(spark: SparkSession, sf: str) -> DataFrame:
    return capfilter.cap_links(table(spark, sf, "embeddings"))


def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.template_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op8_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf, "documents"), *bpe()).select("doc_id", "n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.interleave(table(spark, sf, "documents")).drop("source")


def op10_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return backoff.stupid_backoff(table(spark, sf, "documents"), *bpe())


def op11_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents"))


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    return veccodes.compress(table(spark, sf, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_chat_trees(spark: SparkSession, sf: str) -> DataFrame:
    saying = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(saying).alias("text"))
    talks = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return replytrees.read_turns(replytrees.format_trees(replytrees.chains(talks))).drop("rank")


QUERIES = {f.__name__: f for f in (
    op1_toxicity, op2_token_counts, op3_minhash, op4_warc, op5_sentencepiece, op6_embedding_caps, op7_decontamination, op8_secrets, op9_sharding, op10_lm_scoring,
    op11_phrases, op12_vector_codes, op13_chat_trees)}

# Distinct shingles, pairs by shared shingles, then all ids that links reach.
OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.a = w.doc_id"""

OP4 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM t"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
d AS (SELECT x, count(*) AS n FROM e GROUP BY x),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, least(a, min(b)) AS component FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN d ON d.x = vec_id LEFT JOIN c ON c.a = vec_id"""

# The checksum is folded over the bytes with the 256-entry table, which is built by its rule.
OP9 = """
WITH b AS (SELECT list(CAST(v AS BIGINT) ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
h AS (SELECT doc_id, source, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS x FROM documents),
d AS (SELECT doc_id, source, length(x) // 2 + 16 AS size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(x) // 2), lambda i: CAST(('0x' || substr(x, CAST(2 * i + 1 AS INT), 2)) AS BIGINT))),
  lambda c, y: xor(c >> 8, t[CAST(xor(c & 255, y) AS INT) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32 FROM h, b),
k AS (SELECT *, md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || CAST(text_crc32 AS VARCHAR) || ':' || CAST(size AS VARCHAR)) AS h FROM d),
f AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id) - 1 + CAST(0.5 AS DOUBLE)) / count(*) OVER (PARTITION BY source) AS part FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY part, source, h, doc_id) - 1 AS place, count(*) OVER () AS n FROM f)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 40 // n AS INT) AS shard, place - ((place * 40 // n) * n + 39) // 40 AS slot, CAST(NULL AS INT) AS grown_shard FROM o"""

OP11 = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
i AS (SELECT lang, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS phrase, a AS longer FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(longer) AS longer FROM i GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, c.a, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:], ' ') AS rest FROM c, (SELECT unnest([1, 2]) AS cut) WHERE cut < k),
v AS (SELECT s.lang, s.phrase, s.a, cut, l.a AS l, r.a AS r, (1000000::HUGEINT * s.a * s.a // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM s JOIN f l ON l.lang = s.lang AND l.phrase = first JOIN f r ON r.lang = s.lang AND r.phrase = rest),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000"""

# Parts of four components; each assignment takes the least distance, then the least index, packed into one number.
OP12_START = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, i AS part, v[i * 4 + 1] AS x0, v[i * 4 + 2] AS x1, v[i * 4 + 3] AS x2, v[i * 4 + 4] AS x3, row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS place FROM e, (SELECT unnest(range(16)) AS i)),
b0 AS (SELECT part, place AS entry, x0, x1, x2, x3 FROM p WHERE place < 64)"""
OP12_ASSIGN = """,
a{k} AS (SELECT p.vec_id, p.part, min(((p.x0 - b.x0) ** 2 + (p.x1 - b.x1) ** 2 + (p.x2 - b.x2) ** 2 + (p.x3 - b.x3) ** 2)::BIGINT * 64 + entry) AS best FROM p JOIN b{k} b ON b.part = p.part GROUP BY ALL)"""
OP12_MOVE = """,
m{k} AS (SELECT p.part, best % 64 AS entry, floor(sum(x0)::DOUBLE / count(*)) AS y0, floor(sum(x1)::DOUBLE / count(*)) AS y1, floor(sum(x2)::DOUBLE / count(*)) AS y2, floor(sum(x3)::DOUBLE / count(*)) AS y3
  FROM p JOIN a{k} a ON a.vec_id = p.vec_id AND a.part = p.part GROUP BY ALL),
b{n} AS (SELECT b.part, b.entry, coalesce(y0, x0)::BIGINT AS x0, coalesce(y1, x1)::BIGINT AS x1, coalesce(y2, x2)::BIGINT AS x2, coalesce(y3, x3)::BIGINT AS x3 FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry)"""
OP12 = OP12_START + OP12_ASSIGN.format(k=0) + OP12_MOVE.format(k=0, n=1) + OP12_ASSIGN.format(k=1) + OP12_MOVE.format(k=1, n=2) + OP12_ASSIGN.format(k=2) + """,
c AS (SELECT vec_id, string_agg(printf('%02x', (best % 64)::INT), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN e USING (vec_id), h"""

OP13 = r"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
s AS (SELECT *, length(role) + 3 + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|\||/?tool_call>|/?think>)', '\1\\\2\3', 'g')) + 5 AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars FROM s GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

SQL = {"op11_phrases": OP11, "op12_vector_codes": OP12, "op13_chat_trees": OP13, "op3_minhash": OP3, "op4_warc": OP4, "op6_embedding_caps": OP6, "op9_sharding": OP9}
