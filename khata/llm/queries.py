"""The operators as queries over the given tables, and the SQL that checks them where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, jaccard, line_dedup, mixing, pieces, prefix_trie, simhash, suffix_dedup, toxicity, url_templates, warc
from .common import scratch_path, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOXIC_AT = 0.3
TARGETS = {
    "source": {"src0": 0.25, "*": 0.75},
    "lang": {"en": 0.5, "de": 0.19, "fr": 0.19, "es": 0.12},
    "topic": {str(i): 1 / mixing.TOPICS for i in range(mixing.TOPICS)},
}
"""Shares of tokens that the mixture is raked to."""


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    """Learned from the labels that aren't held out."""
    return toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


ORACLES["op1_line_dedup"] = """
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
    SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM split
), keyed AS (
    SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), shared AS (
    SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT keyed.*, shared.k IS NOT NULL AND keyed.doc_id <> keeper AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_lexicon(spark, docs, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= TOXIC_AT).cast("int").alias("predicted"), "toxic_terms")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("payload")), path)
    # responses are judged by the payload that was read, revisits by their headers
    responses = warc.read_archives(spark, path).where("record_type = 'response'").withColumn("payload_digest", warc.base32_sha1("payload")).drop("payload")
    revisits = warc.read_archives(spark, path, payloads=False).where("record_type = 'revisit'").drop("payload")
    name = "^<urn:page:(.*)>$"
    number = {c: F.nullif(F.regexp_extract(c, name, 1), F.lit("")).cast("long") for c in ("record_id", "refers_to")}
    both = responses.unionByName(revisits)
    return both.select(number["record_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", number["refers_to"].alias("refers_to"))


ORACLES["op3_warc"] = """
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(encode(coalesce(html, ''))) AS h FROM pages
), named AS (
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
        min(page_id) OVER (PARTITION BY h) AS first_id
    FROM hashed
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM named
"""

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_templates.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template")


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op6_chat"] = """
WITH placed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n,
        '<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS message,
        to_json({'r': role, 't': text})::VARCHAR AS said
    FROM conversations
), steps AS (
    SELECT conv_id, n, md5(string_agg(said, chr(10)) OVER (PARTITION BY conv_id ORDER BY n)) AS h,
        lead(n) OVER (PARTITION BY conv_id ORDER BY n) IS NULL AS last
    FROM placed
), whole AS (
    SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_equal FROM steps WHERE last GROUP BY n, h
), keep AS (
    SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM steps WHERE NOT steps.last AND steps.n = whole.n AND steps.h = whole.h)
)
SELECT keep.conv_id, keep.n AS n_turns, n_equal, string_agg(message, '' ORDER BY placed.n) AS rendered
FROM keep JOIN placed USING (conv_id) GROUP BY keep.conv_id, keep.n, n_equal
"""


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.with_topics(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixing.mix(docs, TARGETS).select("doc_id", "source", "lang", "topic", "tokens", "keep_probability", "kept")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


NEAR_BITS = 23
"""Hamming radius of the search: what five-word Jaccard of 0.8 needs (README has the recall), and the most for which queries flip only 2 bits of a block of 16."""


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest, ``n_near``: for ids divisible by 50, how many rows have a fingerprint within NEAR_BITS."""
    prints = written(simhash.with_edits(table(spark, sf_dir, "documents")), "fingerprints")
    asked = F.col("doc_id") % 50 == 0
    near = simhash.within_radius(prints, prints.where(asked), NEAR_BITS).withColumn("asked", F.lit(True))
    return prints.withColumn("asked", F.coalesce(asked, F.lit(False))).join(near, ["fingerprint", "asked"], "left").drop("asked")


def tokenizer_file(name: str) -> bytes:
    """A vocabulary file, read by the driver and sent with the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned = align.Alignment(docs, tokenizer_file("byte_bpe_50k.json").decode(), tokenizer_file("piece_bpe_32k.model"), digest=True)
    return aligned.rows.select("doc_id", *align.FIELDS, "groups_sha256")


@query
def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.branched(table(spark, sf_dir, "conversations")))


ORACLES["op13_prefix_trie"] = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, max(n) AS own, conv_id - conv_id % 5 AS base,
        xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
            lambda i: [ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, (crc & 1) * 3988292384) END), 4294967295::BIGINT) % 9 AS h
    FROM turns GROUP BY conv_id
), convs AS (
    SELECT own.*, least(own.h, coalesce(b.own, 0)) AS taken FROM own LEFT JOIN own b ON b.conv_id = own.base
), steps AS (
    SELECT c.conv_id, t.n AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE t.n <= c.taken
    UNION ALL
    SELECT c.conv_id, c.taken + t.n - c.h, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE t.n > c.h
), keyed AS (
    SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
        md5(string_agg(to_json({'r': role, 't': text})::VARCHAR, chr(10)) OVER (PARTITION BY conv_id ORDER BY depth)) AS k
    FROM steps
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
    SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved FROM keyed GROUP BY depth, k
), named AS (
    SELECT keyed.conv_id AS member, depth, nodes.conv_id AS name FROM keyed JOIN nodes USING (depth, k)
), tree AS (
    SELECT nodes.*, named.name AS parent_conv_id FROM nodes LEFT JOIN named ON named.member = nodes.conv_id AND named.depth = nodes.depth - 1
), children AS (
    SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM tree WHERE depth > 0 GROUP BY ALL
), counted AS (
    SELECT tree.*, coalesce(n_children, 0) AS n_children FROM tree LEFT JOIN children USING (conv_id, depth)
), sums AS (
    SELECT a.name AS conv_id, a.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum(u.saved) AS saved_tokens
    FROM counted u JOIN named a ON a.member = u.conv_id AND a.depth <= u.depth GROUP BY a.name, a.depth
), ends AS (
    SELECT name AS conv_id, named.depth, string_agg(member::VARCHAR, ',' ORDER BY member) AS ids
    FROM named JOIN (SELECT conv_id, max(depth) AS length FROM keyed GROUP BY conv_id) l ON l.conv_id = member AND length = named.depth
    GROUP BY name, named.depth
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM counted JOIN sums USING (conv_id, depth) LEFT JOIN ends USING (conv_id, depth)
"""
