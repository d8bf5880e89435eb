"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.lineage import keep, shared_dir
from heliograph.llm import conversation_repair, decontaminate, html_text, language_id, lloyd, mpeg_audio, packing, quality, quote_links, surrogates, token_counts, token_files
from heliograph.llm.ngram_join import ngram_jaccard_join

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PACK_CAPACITY = 4096
#: The session's setting with the secret key of surrogates; where it is unset, a public key that suits synthetic tables only.
PII_KEY_SETTING, PUBLIC_KEY = "spark.heliograph.pii.key", "public key for synthetic tables"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_documents(docs: DataFrame, capacity: int = PACK_CAPACITY) -> DataFrame:
    """Bins without two near copies (five words, similarity 0.8), whose component is the cluster.

    A row is named by a hash of its id and text, so repeated and missing ids do
    not matter and exact copies are not dealt by their text.
    """
    keyed = docs.withColumn("row", F.when(F.col("text").isNotNull(), F.xxhash64("doc_id", "text")))
    near = ngram_jaccard_join(keyed, "row", "text", k=5, percent=80, with_words=True).where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("row")).agg(F.min("component_id").alias("cluster"), F.max("n_words").alias("words"))
    rows = keep(keyed.select("doc_id", "source", "row").join(near, "row", "left").drop("row"), "packing-rows")
    return packing.best_fit_pack(rows, F.col("words"), F.col("cluster"), capacity=capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_links.link_quotes(_table(spark, sf_dir, "conversations"))


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(PII_KEY_SETTING, PUBLIC_KEY)


def op3_surrogate_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace_checked(docs, pii_key(spark)).select("doc_id", "text", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.Vocabulary.load(vocabulary)).drop("text")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    out = language_id.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    media = mpeg_audio.store_column(docs).drop("text")
    return mpeg_audio.digest_column(media).drop("media")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", "text"), model, out="score")
    return out.select("doc_id", language_id.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    messages = conversation_repair.damage(conversations)
    plan = keep(conversation_repair.repair_plan(messages), "repair-plan")
    return conversation_repair.repair_report(conversations, messages, plan)


def op12_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(tokenizer or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        definition = file.read()
    files = token_files.write(docs, f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}", definition)
    return token_files.read(token_files.lookup(docs, files), files).withColumnRenamed("key", "doc_id")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    centroids = lloyd.fit(vectors)
    assigned = keep(lloyd.assign(vectors, centroids).drop("embedding"), "lloyd-assigned")
    return lloyd.with_inertia(assigned, centroids)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_quote_linking, op3_surrogate_pii, op4_decontamination, op5_token_counts,
        op6_html_extraction, op7_ngram_jaccard, op8_language_id, op9_media_columns, op10_quality_classifier,
        op11_conversation_repair, op12_token_files, op13_centroid_clustering,
    )
}


def _words(table: str, key: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"SELECT {key}, regexp_extract_all(coalesce({low}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}"


def _shingles(table: str, key: str, k: int) -> str:
    return (
        f"SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [len(w) || ' ' || array_to_string(w, ' ')] "
        f"ELSE list_transform(range(1, len(w) - {k} + 2), lambda i: '{k} ' || array_to_string(w[i:i + {k - 1}], ' ')) END) AS s FROM ({_words(table, key)})"
    )


OP7_SQL = f"""
WITH RECURSIVE sh AS MATERIALIZED ({_shingles("documents", "doc_id", 4)}),
sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.node, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id::BIGINT AS component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
FROM documents d JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY 1) c ON c.node = d.doc_id
LEFT JOIN sizes ON sizes.doc_id = d.doc_id LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY 1) l ON l.a = d.doc_id
"""

# An item of fewer than five words is one run of so many words, and documents are cut into runs of every such length.
_RUNS = "unnest(list_transform(range(1, len(w) - n + 2), lambda i: n || ' ' || array_to_string(w[i:i + n - 1], ' ')))"
OP4_SQL = f"""
WITH items AS (SELECT *, least(len(w), 5) AS n FROM ({_words("benchmark", "item_id")}) WHERE len(w) > 0 AND item_id IS NOT NULL),
b AS MATERIALIZED (SELECT DISTINCT item_id, {_RUNS} AS s FROM items),
d AS MATERIALIZED (SELECT DISTINCT doc_id, {_RUNS} AS s FROM ({_words("documents", "doc_id")}) JOIN (SELECT DISTINCT n FROM items) ON len(w) >= n),
sizes AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1)
SELECT doc_id, item_id, count(*)::BIGINT AS shared, any_value(sizes.n)::BIGINT AS item_shingles, count(*)::DOUBLE / any_value(sizes.n) AS containment
FROM d JOIN b USING (s) JOIN sizes USING (item_id) GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * any_value(sizes.n)
"""


# Ten rounds written out: integer floor of a quotient, as // rounds towards zero.
_FLOOR = "(s - ((s % n) + n) % n) // n"
_ROUND = """
near{i} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
  SELECT r, c, sum((v.q - m.q) * (v.q - m.q)) AS d FROM v JOIN mid{i} m USING (dim) GROUP BY 1, 2) GROUP BY 1)"""
_MOVE = f"""
mid{{j}} AS MATERIALIZED (SELECT m.c, m.dim, coalesce({_FLOOR}, m.q) AS q FROM mid{{i}} m LEFT JOIN (
  SELECT c, dim, sum(q)::HUGEINT AS s, count(*) AS n FROM v JOIN near{{i}} USING (r) GROUP BY 1, 2) t ON t.c = m.c AND t.dim = m.dim)"""
OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, unnest(e) AS q, unnest(range(64)) AS dim FROM kept),
mid0 AS MATERIALIZED (SELECT r - 1 AS c, dim, q FROM v WHERE r <= 8),
{",".join(_ROUND.format(i=i) + "," + _MOVE.format(i=i, j=i + 1) for i in range(10))},{_ROUND.format(i=10)},
inertia AS (SELECT c, sum(d) AS s, (SELECT sum(d) FROM near10) AS total FROM near10 GROUP BY 1),
shas AS (SELECT c, sha256(string_agg(q::VARCHAR, ',' ORDER BY dim)) AS h FROM mid10 GROUP BY 1)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, s::BIGINT AS cluster_inertia, total::BIGINT AS inertia, h AS centroid_sha256
FROM near10 JOIN kept USING (r) JOIN inertia USING (c) JOIN shas USING (c)
"""

ORACLES: dict[str, str] = {"op4_decontamination": OP4_SQL, "op7_ngram_jaccard": OP7_SQL, "op13_centroid_clustering": OP13_SQL}

