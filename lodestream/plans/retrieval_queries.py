"""Retrieval operators over embeddings and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions import tags
from lodestream.operators import prompt, retrieval, session
from lodestream.operators.dedup import blank_repeated_slots
from lodestream.operators.reranking import rerank_texts
from lodestream.operators.vectors import build_index
from lodestream.plans.register import Registry
from lodestream.storage import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

K = retrieval.TOP_K
#: Queries are the vectors whose id is divisible by this.
QUERY_STEP = 50
TAGS = ["l1", "l2", "l3"]

_SCORED = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, 'l' || label AS tag, round(list_cosine_similarity(qv, CAST(embedding AS DOUBLE[])), 6) AS vector_score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, vec_id) AS rank FROM s)"""
_TEXT = "'text ' || vec_id || CASE WHEN vec_id % 7 = 0 THEN '' ELSE ' of ' || tag END"


def _sql_bigrams(x: str) -> str:
    return rf"list_distinct(list_transform(range(1, length(regexp_replace({x}, '\s+', '', 'g'))), lambda i: substr(regexp_replace({x}, '\s+', '', 'g'), i, 2)))"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", "embedding", F.concat(F.lit("l"), F.col("label").cast("string")).alias("tag"))


def _queries(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").where(F.col("vec_id") % QUERY_STEP == 0)
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def _with_text(hits: DataFrame) -> DataFrame:
    end = F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit(" of "), "tag"))
    return hits.withColumn("text", F.concat(F.lit("text "), F.col("vec_id").cast("string"), end))


def _rank_long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


_TOP_K = f"WITH {_SCORED} SELECT query_id, vec_id, tag, vector_score, rank FROM r WHERE rank <= 8"


@register(_TOP_K)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _rank_long(retrieval.top_k(_queries(spark, d), _chunks(spark, d), K))


@register(_TOP_K)
def vector_index_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same through an index of cells: the nearest ones first, then those that their bounds do not rule out."""
    index = build_index(_chunks(spark, d), "vec_id", n_cells=16)
    return _rank_long(retrieval.search(index, _queries(spark, d), K)).select("query_id", "vec_id", "tag", "vector_score", "rank")


@register(
    f"""WITH {_SCORED}, f AS (SELECT query_id, vec_id, tag, vector_score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM r WHERE rank <= 64 AND tag IN ('l1', 'l2', 'l3'))
    SELECT * FROM f WHERE rank <= 8"""
)
def vector_topk_tag_post(spark: SparkSession, d: str) -> DataFrame:
    """Ranked first, filtered second; may leave fewer than k."""
    return _rank_long(retrieval.top_k_tagged(_queries(spark, d), _chunks(spark, d), TAGS, K))


@register(
    f"""WITH {_SCORED}, f AS (SELECT query_id, vec_id, tag, vector_score, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, vec_id) AS rank FROM s WHERE tag IN ('l1', 'l2', 'l3'))
    SELECT * FROM f WHERE rank <= 8"""
)
def vector_topk_tag_pre(spark: SparkSession, d: str) -> DataFrame:
    return _rank_long(retrieval.top_k_tagged(_queries(spark, d), _chunks(spark, d), TAGS, K, mode="pre"))


@register(
    f"""WITH {_SCORED}, h AS (SELECT query_id, rank, {_TEXT} AS text, round(1 - sqrt(2) * (1 - vector_score), 6) AS score FROM r WHERE rank <= 8),
    c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM h WHERE score >= 0.3 GROUP BY query_id)
    SELECT query_id, coalesce(context, '') AS context FROM (SELECT DISTINCT query_id FROM h) LEFT JOIN c USING (query_id)"""
)
def vector_threshold_context(spark: SparkSession, d: str) -> DataFrame:
    """Hits as relevances, those at the threshold or above joined into contexts."""
    hits = _with_text(retrieval.top_k(_queries(spark, d), _chunks(spark, d), K))
    scored = hits.withColumn("vector_score", F.round(retrieval.relevance(F.col("vector_score")), 6))
    return retrieval.build_context(scored, 0.3)


_COPIES = f"""{_SCORED}, h AS (SELECT query_id, vec_id % 20 AS slot, rank, {_TEXT} AS text FROM r WHERE rank <= 8)"""


@register(
    f"""WITH {_COPIES} SELECT query_id, slot, rank, CASE WHEN row_number() OVER (PARTITION BY query_id, slot ORDER BY rank) = 1 THEN text ELSE '' END AS text FROM h"""
)
def hit_slot_dedup(spark: SparkSession, d: str) -> DataFrame:
    hits = _with_text(retrieval.top_k(_queries(spark, d), _chunks(spark, d), K)).withColumn("slot", F.col("vec_id") % 20)
    return _rank_long(blank_repeated_slots(hits.select("query_id", "slot", "rank", "text"), "slot"))


@register(
    f"""WITH {_SCORED}, h AS (SELECT query_id, vec_id, rank AS r0, CAST((vec_id * 37) % 11 AS DOUBLE) AS rerank_score FROM r WHERE rank <= 8),
    n AS (SELECT query_id, vec_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r0) AS rank FROM h)
    SELECT * FROM n WHERE rank <= 3"""
)
def rerank_topn(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top_k(_queries(spark, d), _chunks(spark, d), K).select("query_id", "vec_id", "rank")
    return _rank_long(retrieval.rerank(hits, ((F.col("vec_id") * 37) % 11).cast("double"), 3))


def _sql_overlap(a: str, b: str) -> str:
    x, y = _sql_bigrams(a), _sql_bigrams(b)
    return f"CAST(len(list_intersect({x}, {y})) AS DOUBLE) / least(len({x}), len({y}))"


@register(
    f"""WITH {_SCORED}, h AS (SELECT query_id, vec_id, rank AS r0, {_TEXT} AS text, 'text ' || (query_id + 13) || ' of l' || (query_id % 7) AS query FROM r WHERE rank <= 8),
    c AS (SELECT query_id, vec_id, r0, {_sql_overlap("query", "text")} AS rerank_score FROM h),
    n AS (SELECT query_id, vec_id, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, r0) AS rank FROM c)
    SELECT * FROM n WHERE rank <= 3"""
)
def rerank_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Hits in the order of what a scorer of pairs of texts makes of them."""
    q = F.concat(F.lit("text "), (F.col("query_id") + 13).cast("string"), F.lit(" of l"), (F.col("query_id") % 7).cast("string"))
    hits = _with_text(retrieval.top_k(_queries(spark, d), _chunks(spark, d), K)).withColumn("query", q)
    return _rank_long(rerank_texts(hits, 3)).select("query_id", "vec_id", "rerank_score", "rank")


@register(f"WITH {_SCORED} SELECT query_id, vec_id, rank, CAST(NULL AS DOUBLE) AS rerank_score FROM r WHERE rank <= 3")
def rerank_off(spark: SparkSession, d: str) -> DataFrame:
    hits = retrieval.top_k(_queries(spark, d), _chunks(spark, d), K).select("query_id", "vec_id", "rank")
    return _rank_long(retrieval.rerank(hits, None, 3))


@register(
    """WITH n AS (SELECT label AS doc_id, vec_id AS sent_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), lead(CAST(embedding AS DOUBLE[])) OVER w), 6) AS distance
      FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
    t AS (SELECT doc_id, round(quantile_cont(distance, 0.88), 6) AS threshold FROM n WHERE distance IS NOT NULL GROUP BY doc_id)
    SELECT doc_id, sent_id, distance, distance >= threshold AS breaks FROM n JOIN t USING (doc_id) WHERE distance IS NOT NULL"""
)
def semantic_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sent_id"), "embedding")
    return retrieval.semantic_breaks(e)


@register(
    f"""WITH c AS (SELECT conv_id // 3 AS visitor, conv_id, turn, role, text, {_sql_bigrams("text")} AS x FROM conversations)
    SELECT visitor, conv_id, turn FROM c WHERE role = 'user'
      AND NOT EXISTS (SELECT 1 FROM c a WHERE a.visitor = c.visitor AND a.role = 'assistant' AND len(list_intersect(a.x, c.x)) / least(len(a.x), len(c.x)) >= 0.7)
      AND NOT EXISTS (SELECT 1 FROM c u WHERE u.visitor = c.visitor AND u.role = 'user' AND u.conv_id < c.conv_id AND len(list_intersect(u.x, c.x)) / least(len(u.x), len(c.x)) >= 0.8)"""
)
def contamination_suppress(spark: SparkSession, d: str) -> DataFrame:
    """Turns that neither ask what the visitor was asked, nor repeat what the same visitor said in an earlier conversation."""
    c = read_table(spark, d, "conversations").withColumn("visitor", F.expr("conv_id div 3"))
    said = c.where("role = 'user'").select("visitor", F.col("conv_id").alias("seq"), "turn", "text")
    new = session.drop_said(session.drop_asked(said, c.where("role = 'assistant'"), 0.7), said, 0.8)
    return new.select("visitor", F.col("seq").alias("conv_id"), "turn")


@register(
    f"""WITH c AS (SELECT conv_id // 3 AS visitor, conv_id, turn, role, {_sql_bigrams("text")} AS x FROM conversations)
    SELECT visitor, conv_id, turn FROM c WHERE role = 'user'
      AND NOT EXISTS (SELECT 1 FROM c a WHERE a.visitor = c.visitor AND a.role = 'assistant' AND len(list_intersect(a.x, c.x)) / least(len(a.x), len(c.x)) >= 0.4)"""
)
def asked_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Turns that none of the visitor's asks covers, as an anti join with the coverage as its condition."""
    c = read_table(spark, d, "conversations").withColumn("visitor", F.expr("conv_id div 3"))
    return session.drop_asked(c.where("role = 'user'"), c.where("role = 'assistant'"), 0.4).select("visitor", "conv_id", "turn")


@register(
    f"""WITH {_SCORED}, h AS (SELECT query_id, rank, {_TEXT} AS text FROM r WHERE rank <= 8 AND vector_score >= 0.2),
    c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM h GROUP BY query_id),
    b AS (SELECT query_id, coalesce(context, '') AS context FROM q LEFT JOIN c USING (query_id))
    SELECT query_id, context, 'The visitor''s name is not known.' || chr(10) || 'You are at the entrance.' || chr(10)
      || CASE WHEN context = '' THEN 'Nothing on record answers this; say so.' ELSE 'Records:' || chr(10) || context END || chr(10)
      || 'Question: query ' || query_id || chr(10) || 'Answer in short spoken sentences.' AS prompt FROM b"""
)
def retrieval_context(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: top-k retrieval, threshold, context and prompt for every query."""
    queries = _queries(spark, d)
    hits = _with_text(retrieval.top_k(queries, _chunks(spark, d), K))
    contexts = retrieval.build_context(hits, 0.2)
    none = F.array().cast("array<string>")
    text = prompt.ordinary(
        F.concat(F.lit("query "), F.col("query_id").cast("string")), F.col("context"), F.lit(None).cast("string"), none, none, F.lit(None).cast("string"), none
    )
    return contexts.select("query_id", "context", text.alias("prompt"))


@register(
    r"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'stage 当前在' || CASE lower(c_mktsegment) WHEN 'building' THEN 'Building' ELSE upper(c_mktsegment) END
        || '展车旁 开口话术 顾客已说 ' || c_name || ' 不要再问已经说过的内容 顾客关注 ' || CASE lower(c_mktsegment) WHEN 'building' THEN 'Building' ELSE upper(c_mktsegment) END || ' 已问过 price 价格 围绕已问过的点继续 不要编造没问过的卖点 extra'
      ELSE 'stage 尚无明确关注点 不要点名具体卖点 轻轻探问来意或下一环节 extra' END AS query FROM customer"""
)
def stage_queries(spark: SparkSession, d: str) -> DataFrame:
    """Retrieval queries of a stage, with and without what is known of the visitor."""
    c, even = read_table(spark, d, "customer"), F.col("c_custkey") % 2 == 0
    none = F.array().cast("array<string>")
    segment = F.lower("c_mktsegment")
    q = tags.stage_query(
        F.lit("stage"),
        F.when(even, segment),
        F.when(even, F.array("c_name")).otherwise(none),
        F.when(even, F.array(segment)).otherwise(none),
        F.when(even, F.array(F.lit("price"))).otherwise(none),
        F.lit("extra"),
        F.create_map(F.lit("building"), F.lit("Building")),
        F.create_map(F.lit("price"), F.lit("价格")),
    )
    return c.select("c_custkey", q.alias("query"))

