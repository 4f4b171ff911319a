"""Dialogue, funnel, interest and view operators over conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import iso_seconds
from lodestream.operators import dialogue, funnel, interest
from lodestream.plans.register import Registry, sql_strip
from lodestream.storage import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as asks, user turns as utterances; three conversations make up a visitor."""
    c = read_table(spark, d, "conversations").where("role <> 'system'")
    return c.select(
        F.expr("conv_id div 3").alias("visitor"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
        F.when(F.col("role") == "assistant", "ask").otherwise("utterance").alias("kind"),
        "text",
    )


_LOG = rf"""l AS (SELECT conv_id // 3 AS visitor, conv_id * 100 + turn AS seq, CASE role WHEN 'assistant' THEN 'ask' ELSE 'utterance' END AS kind, text FROM conversations WHERE role <> 'system'),
u AS (SELECT visitor, seq, t AS text FROM (SELECT visitor, seq, {sql_strip("text")} AS t, lag({sql_strip("text")}) OVER (PARTITION BY visitor ORDER BY seq) AS b
  FROM l WHERE kind = 'utterance' AND length({sql_strip("text")}) >= 2) WHERE b IS NULL OR b <> t),
a AS (SELECT visitor, seq, substr(regexp_replace({sql_strip("text")}, '\s+', ' ', 'g'), 1, 120) AS text FROM l WHERE kind = 'ask'),
p AS (SELECT visitor, seq, text, CAST(NULL AS VARCHAR) AS ask FROM u UNION ALL SELECT visitor, seq, NULL, text FROM a),
g AS (SELECT *, count(text) OVER (PARTITION BY visitor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM p),
v AS (SELECT visitor, seq, text AS reply, last_value(ask IGNORE NULLS) OVER (PARTITION BY visitor, grp ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ask FROM g)"""


@register(f"WITH {_LOG} SELECT visitor, seq, list(text) OVER (PARTITION BY visitor ORDER BY seq ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS utterances FROM u")
def rolling_utterances(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.rolling_utterances(_log(spark, d))


@register(
    f"WITH {_LOG}, f AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY visitor ORDER BY seq) AS b FROM a WHERE text <> '') WHERE b IS NULL OR b <> text) SELECT visitor, seq, list(text) OVER (PARTITION BY visitor ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS recent FROM f"
)
def recent_asks(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.recent_asks(_log(spark, d))


@register(f"WITH {_LOG} SELECT visitor, seq, ask, reply FROM v WHERE reply IS NOT NULL AND ask IS NOT NULL")
def answered_asks(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.answered_asks(_log(spark, d))


@register(
    f"WITH {_LOG}, k AS (SELECT visitor, max(seq) AS said FROM u GROUP BY visitor) SELECT visitor, arg_max(text, seq) AS ask FROM a LEFT JOIN k USING (visitor) GROUP BY visitor, said HAVING said IS NULL OR max(seq) > said"
)
def pending_asks(spark: SparkSession, d: str) -> DataFrame:
    return dialogue.pending_ask(_log(spark, d))


def _last(table: str, value: str, n: int, name: str) -> str:
    return f"""{name}_ AS (SELECT visitor, string_agg({value}, '|' ORDER BY seq) AS {name} FROM
      (SELECT *, row_number() OVER (PARTITION BY visitor ORDER BY seq DESC) AS nth FROM {table}) WHERE nth <= {n} GROUP BY visitor)"""


@register(
    f"""WITH {_LOG}, f AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY visitor ORDER BY seq) AS b FROM a WHERE text <> '') WHERE b IS NULL OR b <> text),
    w AS (SELECT * FROM v WHERE reply IS NOT NULL AND ask IS NOT NULL), {_last("u", "text", 8, "utterances")}, {_last("w", "ask || ' -> ' || reply", 6, "answered")}, {_last("f", "text", 6, "recent")},
    k AS (SELECT visitor, max(seq) AS said FROM u GROUP BY visitor),
    n AS (SELECT visitor, arg_max(text, seq) AS pending FROM a LEFT JOIN k USING (visitor) GROUP BY visitor, said HAVING said IS NULL OR max(seq) > said)
    SELECT visitor, utterances, answered, recent, pending FROM (SELECT DISTINCT visitor FROM l) LEFT JOIN utterances_ USING (visitor)
      LEFT JOIN answered_ USING (visitor) LEFT JOIN recent_ USING (visitor) LEFT JOIN n USING (visitor)"""
)
def visitor_memory(spark: SparkSession, d: str) -> DataFrame:
    memory = dialogue.memory(_log(spark, d))
    pairs = F.transform("answered", lambda p: F.concat(p["ask"], F.lit(" -> "), p["reply"]))
    return memory.select("visitor", F.array_join("utterances", "|").alias("utterances"), F.array_join(pairs, "|").alias("answered"), F.array_join("recent", "|").alias("recent"), "pending")


_TURNS = """e AS (SELECT user_id AS session, event_id AS seq, CASE WHEN event_type IN ('click', 'view') AND event_id % 3 = 0 THEN [event_type] END AS detected,
  CASE WHEN event_id % 17 = 0 THEN [CAST(NULL AS VARCHAR)][1:0] WHEN event_id % 13 = 0 THEN ['Set'] END AS explicit, CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN ['Nav'] END AS nav FROM events),
pn AS (SELECT *, CASE WHEN nav IS NOT NULL THEN ['nav'] WHEN len(explicit) = 0 THEN [CAST(NULL AS VARCHAR)][1:0] END AS pin FROM e),
pd AS (SELECT *, coalesce(last_value(pin IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), []) AS pinned,
  coalesce(last_value(pin IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM pn),
st AS (SELECT *, CASE WHEN nav IS NOT NULL THEN ['nav'] || coalesce(detected, []) WHEN explicit IS NOT NULL THEN list_transform(explicit, lambda x: lower(x)) WHEN detected IS NOT NULL THEN before || detected END AS put FROM pd),
ac AS (SELECT *, coalesce(last_value(put IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), []) AS active FROM st)"""


@register(
    f"""WITH {_TURNS} SELECT session, seq, CASE WHEN len(t) > 0 THEN t || ['general'] ELSE t END AS tags
    FROM (SELECT session, seq, CASE WHEN put IS NOT NULL THEN put ELSE pinned || list_filter(active, lambda x: NOT list_contains(pinned, x)) END AS t FROM ac)"""
)
def sticky_tags(spark: SparkSession, d: str) -> DataFrame:
    e, n, none = read_table(spark, d, "events"), F.col("event_id"), F.array().cast("array<string>")
    return dialogue.sticky_tags(
        e.select(
            F.col("user_id").alias("session"),
            n.alias("seq"),
            F.when(F.col("event_type").isin("click", "view") & (n % 3 == 0), F.array("event_type")).alias("detected"),
            F.when(n % 17 == 0, none).when(n % 13 == 0, F.array(F.lit("Set"))).alias("explicit"),
            F.when((F.col("event_type") == "purchase") & (n % 2 == 0), F.array(F.lit("Nav"))).alias("nav"),
        )
    )


#: Event types as stages, and how the stages are ordered.
STAGES = ("view", "click", "signup", "error", "purchase")


def _stages(spark: SparkSession, d: str) -> DataFrame:
    """Event types as stages, a visitor being a user on a day."""
    visitor = F.col("user_id") * 100 + F.dayofmonth("ts")
    return read_table(spark, d, "events").select(visitor.alias("visitor"), F.col("event_type").alias("stage"), "ts", "event_id")


_ASKED = """m AS (SELECT user_id * 100 + day(ts) AS visitor, event_type AS stage, min(ts) AS asked_at FROM events GROUP BY ALL),
x AS (SELECT visitor, list(stage ORDER BY stage) AS asked FROM m GROUP BY visitor),
o AS (SELECT *, list_filter(['view', 'click', 'signup', 'error', 'purchase'], lambda s: NOT list_contains(asked, s)) AS rest FROM x)"""


@register(f"WITH {_ASKED} SELECT * FROM m")
def funnel_mark(spark: SparkSession, d: str) -> DataFrame:
    return funnel.mark(_stages(spark, d))


@register(
    f"""WITH {_ASKED} SELECT visitor, asked, CAST(len(asked) AS INTEGER) AS n_asked, 5 AS n_stages, rest[1] AS first_open, len(rest) = 0 AS all_done,
      array_to_string(rest[1:3], '、') || CASE WHEN len(rest) > 3 THEN ' 等' || len(rest) || '项' ELSE '' END AS open_preview,
      '观车进度 ' || len(asked) || '/5；待讲解：' || CASE WHEN len(rest) = 0 THEN '无' ELSE array_to_string(rest[1:3], '、') || CASE WHEN len(rest) > 3 THEN ' 等' || len(rest) || '项' ELSE '' END END AS line FROM o"""
)
def funnel_progress(spark: SparkSession, d: str) -> DataFrame:
    asked = funnel.asked_stages(funnel.mark(_stages(spark, d)))
    return funnel.progress(asked, STAGES).withColumn("line", funnel.progress_line(F.col("asked"), STAGES))


@register(
    f"""WITH {_ASKED} SELECT visitor, list_filter(rest, lambda s: NOT (s = 'view' AND len(asked) > 0) AND NOT (s = 'click' AND (visitor % 4 = 0 OR len(list_filter(asked, lambda y: y NOT IN ('view', 'click'))) > 0))
      AND NOT (s IN ('error', 'purchase') AND len(list_filter(['view', 'click', 'signup'], lambda y: NOT list_contains(asked, y))) > 0))[1] AS next_stage, rest[1] AS forced,
      coalesce(rest[1], 'contact_retention') AS ask_stage FROM o"""
)
def next_pending_step(spark: SparkSession, d: str) -> DataFrame:
    asked = funnel.asked_stages(funnel.mark(_stages(spark, d)))
    no = F.lit(False)
    step = funnel.next_stage(F.col("asked"), F.col("visitor") % 4 == 0, no, no, STAGES, STAGES[:2], STAGES[-2:])
    forced = funnel.advance(F.col("asked"), STAGES)
    return asked.select("visitor", step.alias("next_stage"), forced.alias("forced"), funnel.ask_stage(F.lit(True), forced, STAGES).alias("ask_stage"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Events as turns: the key in props modulo 4 as the entity, if any, and the type as the topic."""
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    none = F.array().cast("array<string>")
    return interest.attribute_turns(
        e.select(
            F.col("user_id").alias("visitor"),
            F.col("event_id").alias("seq"),
            (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
            F.when(k % 3 == 0, F.array(F.concat(F.lit("e"), (k % 4).cast("string")))).otherwise(none).alias("entities"),
            F.array("event_type").alias("topics"),
        )
    )


_INTEREST = """t AS (SELECT user_id AS visitor, event_id AS seq, epoch_us(ts) / 1e6 AS ts, event_type AS topic,
  CASE WHEN CAST(props->>'$.k' AS INTEGER) % 3 = 0 THEN 'e' || CAST(props->>'$.k' AS INTEGER) % 4 END AS e FROM events),
w AS (SELECT visitor, seq, ts, topic, coalesce(e, last_value(e IGNORE NULLS) OVER (PARTITION BY visitor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS entity FROM t),
c AS (SELECT visitor, entity, count(*) AS ask_count, min(ts) AS first_at, max(ts) AS last_at FROM w WHERE entity IS NOT NULL GROUP BY ALL),
k AS (SELECT visitor, entity, topic, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM w WHERE entity IS NOT NULL GROUP BY ALL),
tt AS (SELECT visitor, topic, sum(n) AS total FROM k GROUP BY ALL)"""


@register(f"WITH {_INTEREST} SELECT *, CASE WHEN ask_count >= 5 THEN '很关心' WHEN ask_count >= 2 THEN '较关心' ELSE '有关注' END AS care FROM c")
def interest_counts(spark: SparkSession, d: str) -> DataFrame:
    return interest.entity_counts(_turns(spark, d)).withColumn("care", interest.care(F.col("ask_count").cast("string")))


@register(f"WITH {_INTEREST} SELECT * FROM k")
def topic_counts(spark: SparkSession, d: str) -> DataFrame:
    return interest.topic_counts(_turns(spark, d))


@register(f"WITH {_INTEREST} SELECT visitor, topic, CAST(total AS BIGINT) AS total FROM tt")
def topic_totals(spark: SparkSession, d: str) -> DataFrame:
    return interest.topic_totals(interest.topic_counts(_turns(spark, d)))


@register(
    f"""WITH {_INTEREST}, ee AS (SELECT visitor, list(entity ORDER BY ask_count DESC, entity) AS entities FROM c GROUP BY visitor),
    pp AS (SELECT visitor, list(topic ORDER BY total DESC, topic) AS topics FROM tt GROUP BY visitor)
    SELECT visitor, entities, topics, true AS has_interest FROM ee JOIN pp USING (visitor)"""
)
def interest_hints(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return interest.retrieval_hints(interest.entity_counts(turns), interest.topic_counts(turns))


@register(
    f"""WITH {_INTEREST}, l AS (SELECT visitor, entity, string_agg(topic, '、' ORDER BY first_at, topic) AS topics FROM k GROUP BY ALL)
    SELECT visitor, '喜好感知：已关注 ' || string_agg(entity || '（' || CASE WHEN ask_count >= 5 THEN '很关心' WHEN ask_count >= 2 THEN '较关心' ELSE '有关注' END || '：' || topics || '）', '；' ORDER BY first_at, entity) AS summary
    FROM c JOIN l USING (visitor, entity) GROUP BY visitor"""
)
def interest_summary(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    return interest.interest_summary(interest.entity_counts(turns), interest.topic_counts(turns))


@register(f"WITH {_INTEREST} SELECT visitor, arg_max(entity, seq) AS entity FROM w WHERE entity IS NOT NULL GROUP BY visitor")
def last_entity(spark: SparkSession, d: str) -> DataFrame:
    return interest.last_entity(_turns(spark, d))


@register(f"WITH {_INTEREST} SELECT *, row_number() OVER (PARTITION BY visitor ORDER BY last_at DESC, ask_count DESC, entity) AS pos FROM c")
def entities_by_recency(spark: SparkSession, d: str) -> DataFrame:
    out = interest.by_recency(interest.entity_counts(_turns(spark, d)))
    return out.withColumn("pos", F.col("pos").cast("long"))


_NAMES = """n AS (SELECT user_id AS visitor, bool_or(event_type = 'click' AND event_id % 50 = 0) AS name_asked, min(CASE WHEN event_type = 'click' AND event_id % 50 = 0 THEN epoch_us(ts) / 1e6 END) AS first_asked_at,
  arg_max(CASE WHEN event_type = 'signup' THEN 'n' || event_id END, CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1e6 END) AS person_name, max(epoch_us(ts) / 1e6) AS last_at FROM events GROUP BY user_id)"""


def _names(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    kind = F.when((F.col("event_type") == "click") & (F.col("event_id") % 50 == 0), "ask_name").when(F.col("event_type") == "signup", "set_name").otherwise("other")
    return e.select(F.col("user_id").alias("visitor"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("value"))


@register(f"WITH {_NAMES} SELECT visitor, name_asked, first_asked_at, person_name FROM n")
def name_state(spark: SparkSession, d: str) -> DataFrame:
    return funnel.name_state(_names(spark, d))


@register(f"WITH {_NAMES} SELECT visitor, CASE WHEN first_asked_at IS NULL THEN true ELSE last_at - first_asked_at > 18000 END AS reask FROM n")
def reask_timeout(spark: SparkSession, d: str) -> DataFrame:
    names = _names(spark, d)
    now = names.groupBy("visitor").agg(F.max("ts").alias("now"))
    state = funnel.name_state(names).join(now, "visitor")
    return state.select("visitor", funnel.should_reask(F.lit(True), F.col("first_asked_at"), F.col("now"), 18_000).alias("reask"))


@register("SELECT user_id AS visitor, count(*) AS n_events, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS updated FROM events GROUP BY user_id ORDER BY updated DESC, visitor")
def visitor_list(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").groupBy(F.col("user_id").alias("visitor")).agg(F.count("*").alias("n_events"), F.max("ts").alias("at"))
    return e.select("visitor", "n_events", iso_seconds(F.unix_micros(F.col("at").cast("timestamp")) / 1e6).alias("updated")).orderBy(F.col("updated").desc(), "visitor")


@register(
    "SELECT user_id AS visitor, event_id AS seq, last_value(CASE WHEN event_type = 'purchase' THEN 'p' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS place FROM events"
)
def sticky_location(spark: SparkSession, d: str) -> DataFrame:
    """A place set by some events and carried on by the others."""
    place = F.when(F.col("event_type") == "purchase", F.concat(F.lit("p"), F.col("event_id").cast("string")))
    e = read_table(spark, d, "events").select(F.col("user_id").alias("visitor"), F.col("event_id").alias("seq"), place.alias("place"))
    return dialogue.sticky_value(e, "visitor", "seq", "place")
