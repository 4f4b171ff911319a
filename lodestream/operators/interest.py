"""What visitors ask about: counts by entity and topic, summaries and retrieval hints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def care(count: Column) -> Column:
    n = F.coalesce(count.try_cast("int"), F.lit(0))
    return F.when(n >= 5, "很关心").when(n >= 2, "较关心").when(n >= 1, "有关注").otherwise("")


def attribute_turns(turns: DataFrame) -> DataFrame:
    """Turns (visitor, seq, ts, entities, topics): topics without an entity go to the last one named; turns without a seq come last."""
    w = Window.partitionBy("visitor").orderBy(F.col("seq").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    named = F.when(F.size("entities") > 0, F.element_at("entities", -1))
    last = F.last(named, ignorenulls=True).over(w)
    to = F.when((F.size("entities") == 0) & (F.size("topics") > 0) & last.isNotNull(), F.array(last)).otherwise(F.col("entities"))
    return turns.withColumn("entities", to)


def entity_counts(turns: DataFrame) -> DataFrame:
    """(visitor, entity, ask_count, first_at, last_at): one a turn."""
    each = turns.select("visitor", "ts", F.explode(F.array_distinct("entities")).alias("entity"))
    return each.groupBy("visitor", "entity").agg(F.count("*").alias("ask_count"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def topic_counts(turns: DataFrame) -> DataFrame:
    """(visitor, entity, topic, n, first_at, last_at)."""
    each = turns.select("visitor", "ts", F.explode(F.array_distinct("entities")).alias("entity"), "topics")
    rows = each.select("visitor", "ts", "entity", F.explode(F.array_distinct("topics")).alias("topic"))
    return rows.groupBy("visitor", "entity", "topic").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def last_entity(turns: DataFrame) -> DataFrame:
    """(visitor, entity): the last one named, the later in a turn first."""
    each = turns.select("visitor", "seq", F.posexplode("entities").alias("pos", "entity"))
    return each.groupBy("visitor").agg(F.max_by("entity", F.struct("seq", "pos")).alias("entity"))


def topic_totals(topics: DataFrame) -> DataFrame:
    """(visitor, topic, total) across entities; each counts once at least."""
    return topics.groupBy("visitor", "topic").agg(F.sum(F.greatest("n", F.lit(1))).alias("total"))


def _ordered(df: DataFrame, n: str, name: str, into: str) -> DataFrame:
    """(visitor, into): names by count, greatest first, then by name."""
    rows = F.array_sort(F.collect_list(F.struct((-F.col(n)).alias("n"), F.col(name).alias("name"))))
    return df.groupBy("visitor").agg(F.transform(rows, lambda r: r["name"]).alias(into))


def retrieval_hints(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """(visitor, entities, topics, has_interest)."""
    a, b = _ordered(entities, "ask_count", "entity", "entities"), _ordered(topic_totals(topics), "total", "topic", "topics")
    none = F.array().cast("array<string>")
    out = a.join(b, "visitor", "full").select("visitor", F.coalesce("entities", none).alias("entities"), F.coalesce("topics", none).alias("topics"))
    return out.withColumn("has_interest", (F.size("entities") > 0) | (F.size("topics") > 0))


def interest_summary(entities: DataFrame, topics: DataFrame) -> DataFrame:
    """(visitor, summary): entities in order of first mention with how much they matter and their topics."""
    listed = topics.groupBy("visitor", "entity").agg(F.array_sort(F.collect_list(F.struct("first_at", "topic"))).alias("rows"))
    named = listed.select("visitor", "entity", F.array_join(F.transform("rows", lambda r: r["topic"]), "、").alias("topics"))
    rows = entities.join(named, ["visitor", "entity"], "left").withColumn("how", care(F.col("ask_count")))
    detail = F.array_join(F.filter(F.array("how", F.coalesce("topics", F.lit(""))), lambda x: x != ""), "：")
    part = F.when(detail == "", F.col("entity")).otherwise(F.concat("entity", F.lit("（"), detail, F.lit("）")))
    grouped = rows.withColumn("part", part).groupBy("visitor").agg(F.array_sort(F.collect_list(F.struct("first_at", "entity", "part"))).alias("parts"))
    return grouped.select("visitor", F.concat(F.lit("喜好感知：已关注 "), F.array_join(F.transform("parts", lambda p: p["part"]), "；")).alias("summary"))


def by_recency(entities: DataFrame) -> DataFrame:
    """Entities of each visitor by (last asked, count), both descending."""
    w = Window.partitionBy("visitor").orderBy(F.col("last_at").desc(), F.col("ask_count").desc(), "entity")
    return entities.withColumn("pos", F.row_number().over(w))
