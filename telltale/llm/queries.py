"""The registered queries of the text operators, with production parameters, and their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.llm import collocations, decontamination, exact_dedup, jaccard_join, lm_scoring, packing, quality, secrets, sharding, spelling, substring_dedup, toxicity, warc
from telltale.llm.shared import read


def vocabulary() -> str:
    """Where the tokenizer's file lies on the machine that asks: driver and executors have it installed alike."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), 24)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


#: The target of the cross-entropy difference: documents of these hosts.
TARGET_SOURCES = ("src1", "src2", "src3")


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(read(spark, sf_dir, "documents"), F.col("source").isin(*TARGET_SOURCES))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = read(spark, sf_dir, "labels").where(~held_out)
    scored = toxicity.toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_by_document(read(spark, sf_dir, "documents"))


def op10_recompression_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(read(spark, sf_dir, "documents"))


def op11_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(read(spark, sf_dir, "pages"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_label_propagation_sharding, op2_quality_classifier, op3_benchmark_decontamination, op4_best_fit_packing, op5_cross_entropy_difference, op6_exact_dedup, op7_ngram_jaccard_join, op8_toxicity, op9_secret_scan, op10_recompression_substring_dedup, op11_warc_transactions, op12_phrase_collocations, op13_spelling_variants, pipeline)}

SQL = {
    "op3_benchmark_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h, length(coalesce(text, '')) AS n FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k""",
    "op10_recompression_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM r) GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c USING (doc_id)),
u AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS kept FROM (SELECT doc_id, gone, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM x) WHERE NOT list_contains(gone, p) GROUP BY doc_id)
SELECT x.doc_id, CAST(len(x.w) AS BIGINT) AS n_words, CAST(len(x.gone) AS BIGINT) AS n_removed, sha256(coalesce(u.kept, '')) AS kept_sha256 FROM x LEFT JOIN u USING (doc_id)""",
    "op11_warc_transactions": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x FROM p),
e AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS last FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> (5 * (3 - k % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM e""",
    "op12_phrase_collocations": r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
tot AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) AS s WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS c FROM g GROUP BY lang, k, p HAVING count(*) >= 10),
x AS (SELECT lang, k, p, c, string_split(p, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT lang, k, p, c, ws, unnest(range(1, k)) AS cut FROM x),
s AS (SELECT u.lang, u.k, u.p, u.c AS a, u.cut, l.c AS l, r.c AS r, CAST((CAST(u.c AS HUGEINT) * u.c * 1000000) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM u JOIN f AS l ON l.lang = u.lang AND l.p = array_to_string(u.ws[1:u.cut], ' ') JOIN f AS r ON r.lang = u.lang AND r.p = array_to_string(u.ws[u.cut + 1:], ' ')),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, p, max(c) AS c FROM (SELECT lang, array_to_string(ws[j:j + 1], ' ') AS p, c FROM (SELECT lang, ws, c, unnest([1, 2]) AS j FROM x WHERE k = 3)) GROUP BY lang, p),
o AS (SELECT m.* FROM m LEFT JOIN i ON i.lang = m.lang AND i.p = m.p WHERE i.c IS NULL OR 100 * i.c < 50 * m.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.p) AS rank, o.p AS phrase, a, l, r, n, score FROM o JOIN tot ON tot.lang = o.lang) WHERE rank <= 2000""",
}
