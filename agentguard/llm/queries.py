"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"


@register("op1_exact_dedup", sql=f"""
WITH d AS (SELECT doc_id, sha256({_NORMAL}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""")
def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.exact_dedup import exact_dedup as dedup

    return dedup(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_ADDED = "</s>[INST] ok [/INST]"


@register("op2_chat_format", sql=r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS is_last,
    sum(length(text) + len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\])'))
        + CASE WHEN role = 'assistant' THEN 7 ELSE 14 + length(role) END) OVER w AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars) FILTER (role = 'assistant' OR is_last)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id""")
def chat_format(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.chat_format import conversation_digest, format_conversations

    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_ADDED).alias("text"))
    return conversation_digest(format_conversations(given.unionByName(added)))


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op4_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.bpe import round_trip

    return round_trip(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@register("op9_token_files")
def token_files(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.token_files import write_and_read

    return write_and_read(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


@register("op10_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"), limit=4096)


@register("op3_language_id")
def language_id(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.language_id import identify

    return identify(table(spark, sf, "documents"))


@register("op6_source_mix")
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.mixing import plan_mixture, taken_words

    sizes, mixture = plan_mixture(table(spark, sf, "documents"))
    return taken_words(sizes, mixture).select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "shards")


@register("op7_warc", sql="""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""")
def warc(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.warc import archive_and_read

    return archive_and_read(table(spark, sf, "pages"))


@register("op8_top_k", sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10""")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.topk import search

    return search(table(spark, sf, "embeddings"), every=100, k=10)


@register("op5_ngram_join")
def ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.ngram_join import similar_components

    return similar_components(table(spark, sf, "documents"), words=3, percent=90)


@register("op11_line_dedup", sql=r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(p, 1) AS k, unnest(p) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
g AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
d AS (SELECT k.*, coalesce(keeper <> doc_id, false) AS dropped FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.line_dedup import drop_repeated_lines

    return drop_repeated_lines(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@register("op13_periodic_runs")
def periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.periodic_runs import find_runs, run_digest, with_repeated_ends

    return run_digest(find_runs(with_repeated_ends(table(spark, sf, "documents"))))


#: Unsigned crc32 of the decimal conv_id, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)))"""


@register("op12_prefix_trie", sql=f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
w AS (SELECT role, text, octet_length(encode(text)) AS bytes, row_number() OVER (ORDER BY role, text) AS code FROM (SELECT DISTINCT role, text FROM t)),
o AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, role, text) AS s FROM t JOIN w USING (role, text) GROUP BY conv_id),
c AS (SELECT conv_id, s, coalesce({_CRC} % 9, 0) AS h FROM o),
b AS (SELECT c.conv_id, coalesce(o.s[1:h], []) || c.s[h + 1:] AS s FROM c LEFT JOIN o ON o.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM b),
n AS (
  SELECT depth, s[1:depth] AS k, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
  FROM p GROUP BY 1, 2),
k AS (SELECT depth - 1 AS depth, k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * coalesce(bytes, 0) AS own FROM n LEFT JOIN k USING (depth, k) LEFT JOIN w ON code = n.k[n.depth]),
a AS (SELECT k, own, n_children, unnest(range(0, depth + 1)) AS top FROM x),
s AS (SELECT top AS depth, k[1:top] AS k, sum(own)::BIGINT AS saved_tokens, count_if(n_children = 0)::BIGINT AS n_leaves FROM a GROUP BY 1, 2)
SELECT x.conv_id, x.depth, u.conv_id AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
FROM x JOIN s USING (depth, k) LEFT JOIN n u ON u.depth = x.depth - 1 AND u.k = x.k[1:x.depth - 1]""")
def prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    from agentguard.llm.prefix_trie import encode_turns, trie_digest, with_common_starts

    return trie_digest(with_common_starts(encode_turns(table(spark, sf, "conversations"))))
