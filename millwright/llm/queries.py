"""Registered queries of the training-data operators and their DuckDB text, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .chat_format import conversation_turns, format_preferences, stale_reply_pairs
from .common import table
from .crosspoly import near_duplicate_vectors
from .hard_negatives import mine_hard_negatives
from .html_extract import extract_main_text
from .language_id import identify_language, train_language
from .mixing import mix_sources
from .ngram_join import ngram_jaccard_join
from .packing import pack_documents
from .periodic_runs import periodic_runs, run_digests, with_planted_periods
from .pu_quality import score_quality, train_quality
from .suffix_dedup import remove_repeats
from .token_rollups import TokenRollup, maintain_token_counts
from .topk_search import top_k


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP1_SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0),
grams AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least_seen AS (SELECT node, min(seen) AS m FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, coalesce(c.n, 0) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_seen m ON m.node = d.doc_id LEFT JOIN counted c ON c.a = d.doc_id
"""


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions per conversation with a reply; spans as text."""
    pairs = stale_reply_pairs(conversation_turns(table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws("-", s["start"], s["end"])), ";").alias(c)
    return format_preferences(pairs).select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", spans("chosen_spans"), spans("rejected_spans"))


OP2_SQL = """
WITH clean AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM clean),
replies AS (SELECT conv_id, i, text, lag(text) OVER (PARTITION BY conv_id ORDER BY i) AS stale,
                   row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back
            FROM numbered WHERE role = 'assistant'),
last_reply AS (SELECT conv_id, i, text, coalesce(stale, '') AS stale FROM replies WHERE back = 1),
prompts AS (SELECT l.conv_id, string_agg('<|' || n.role || '|>' || chr(10) || n.text || '<|end|>' || chr(10), '' ORDER BY n.i) AS prompt
            FROM last_reply l JOIN numbered n ON n.conv_id = l.conv_id AND n.i < l.i GROUP BY l.conv_id)
SELECT l.conv_id AS pair_id, CAST(l.i - 1 AS INTEGER) AS prompt_turns, coalesce(p.prompt, '') AS prompt,
       '<|assistant|>' || chr(10) || l.text || '<|end|>' || chr(10) AS chosen,
       '<|assistant|>' || chr(10) || l.stale || '<|end|>' || chr(10) AS rejected,
       '14-' || CAST(14 + length(l.text) AS VARCHAR) AS chosen_spans,
       '14-' || CAST(14 + length(l.stale) AS VARCHAR) AS rejected_spans
FROM last_reply l LEFT JOIN prompts p ON p.conv_id = l.conv_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), keep_ids=False).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.filter("vec_id % 20 = 0"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS y FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.y, x.y) AS BIGINT) AS score
           FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = TokenRollup(spark, scratch_path(spark, "token-rollup"))
    return maintain_token_counts(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), rollup)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS node, b AS seen FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
least_seen AS (SELECT node, min(seen) AS m FROM reach GROUP BY node),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(m.m, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(m.m, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least_seen m ON m.node = e.vec_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP9_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
ordered AS (SELECT *, row_number() OVER (ORDER BY source_size * 3.0e0 / w, source NULLS LAST) AS k,
                   sum(source_size) OVER () AS total FROM ranked),
prefixed AS (SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
                    sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w0 FROM ordered),
water AS (SELECT *, CAST(source_size * 3 AS DOUBLE) * CAST(w0 AS DOUBLE) < CAST(total - c0 AS DOUBLE) * w AS above FROM prefixed),
level AS (SELECT CAST(total - c0 AS DOUBLE) AS rest, CAST(w0 AS DOUBLE) AS weight FROM water WHERE NOT above ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN above THEN CAST(source_size * 3 AS DOUBLE) ELSE (SELECT rest FROM level) * w / (SELECT weight FROM level) END AS target
            FROM water),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
cumulated AS (SELECT s.doc_id, s.source, s.size, w.source_size, w.target, w.whole,
                     coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.size
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
              FROM sized s JOIN whole w ON s.source IS NOT DISTINCT FROM w.source),
counted AS (SELECT *, least(whole + CASE WHEN CAST(before * 2 + size AS DOUBLE) <= (target - whole * source_size) * 2 THEN 1 ELSE 0 END, 3) AS copies FROM cumulated)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM counted
"""


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(with_planted_periods(table(spark, sf_dir, "documents").select("doc_id", "text"))), "doc_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_hard_negatives(rows, rows.filter("vec_id % 100 = 0"))


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS y FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, x.vec_id, x.label, CAST(list_inner_product(a.y, x.y) AS BIGINT) AS score
           FROM v a JOIN v x ON a.vec_id % 100 = 0 AND x.vec_id <> a.vec_id),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND n.label <> n.anchor_label
 AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, train_language(docs))


QUERIES = {
    "op1_ngram_jaccard_join": (op1_ngram_jaccard_join, OP1_SQL),
    "op2_chat_formatting": (op2_chat_formatting, OP2_SQL),
    "op3_packing": (op3_packing, None),
    "op4_topk_search": (op4_topk_search, OP4_SQL),
    "op5_html_extraction": (op5_html_extraction, None),
    "op6_quality_classifier": (op6_quality_classifier, None),
    "op7_token_counts": (op7_token_counts, None),
    "op8_embedding_near_dedup": (op8_embedding_near_dedup, OP8_SQL),
    "op9_mixing": (op9_mixing, OP9_SQL),
    "op10_suffix_array_dedup": (op10_suffix_array_dedup, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_language_id": (op13_language_id, None),
}
