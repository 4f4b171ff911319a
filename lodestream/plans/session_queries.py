"""Session, prompt, preview and bookkeeping operators over conversations, events and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import dialogue, funnel, prompt, runtime, session, store
from lodestream.plans.dialogue_queries import _LOG, _log
from lodestream.plans.register import Registry
from lodestream.plans.store_queries import _OLD_NEW, _STORE, _batches, _store
from lodestream.plans.text_queries import _CLASSES, RULES
from lodestream.storage import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register(
    f"""WITH {_OLD_NEW} SELECT source, doc_id FROM o WHERE source NOT IN (SELECT regexp_replace(source, '[1357]$', '0') FROM n)
    UNION ALL SELECT './' || regexp_replace(source, '[1357]$', '0'), doc_id FROM n"""
)
def audit_replace_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Sources that come in as ./x replace the rows of x."""
    old, new = _batches(spark, d)
    return store.replace_audit(old, new.withColumn("source", F.concat(F.lit("./"), "source"))).select("source", "doc_id")


@register(f"WITH s AS ({_STORE}) SELECT regexp_replace(string_split(source, '/')[-1], '\\.[^./]+$', '') || '.json' AS path, count(*) AS records FROM s GROUP BY 1")
def mirror_listing(spark: SparkSession, d: str) -> DataFrame:
    return store.mirror_listing(_store(spark, d), "data")


@register(
    """WITH b AS (SELECT conv_id, turn, '--- part ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' (page=' || role || ') ---' || chr(10) || text AS block FROM conversations),
    p AS (SELECT *, sum(length(block) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 2 AS fin FROM b),
    q AS (SELECT *, 300 - (fin - length(block)) AS lft FROM p)
    SELECT conv_id, string_agg(substr(block, 1, CAST(lft AS BIGINT)), chr(10) || chr(10) ORDER BY turn) FILTER (lft > 0) AS preview, max(fin) > 300 AS truncated FROM q GROUP BY conv_id"""
)
def preview_parts(spark: SparkSession, d: str) -> DataFrame:
    return store.preview_parts(read_table(spark, d, "conversations"), "conv_id", "turn", "role", 300)


def _said(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "conversations").where("role = 'user'")
    return c.select(F.expr("conv_id div 3").alias("visitor"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), (F.col("turn") * 1.0).alias("ts"), "text")


_TURNS = f"t AS (SELECT conv_id // 3 AS visitor, conv_id * 100 + turn AS seq, {_CLASSES} AS c FROM conversations WHERE role = 'user')"


@register(
    f"""WITH {_TURNS}, e AS (SELECT visitor, seq, unnest(c) AS stage FROM t),
    f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY visitor, stage ORDER BY seq) = 1)
    SELECT visitor, seq, list(stage ORDER BY stage) AS stages FROM f GROUP BY visitor, seq"""
)
def newly_marked(spark: SparkSession, d: str) -> DataFrame:
    """What each turn marks that no earlier one of the visitor has."""
    return session.mark_from_texts(_said(spark, d), RULES, RULES, {})["newly_marked"]


@register(
    """WITH c AS (SELECT conv_id // 3 AS visitor, conv_id * 100 + turn AS seq, turn, lower(text) AS low, text FROM conversations WHERE role = 'user'),
    """
    + f"k AS (SELECT visitor, seq, {_CLASSES} AS topics, list_filter(['the'], lambda w: regexp_matches(low, '(?:^|[^a-z0-9])' || w || '(?:$|[^a-z0-9])')) AS named FROM c),"
    + """
    l AS (SELECT *, last_value(CASE WHEN len(named) > 0 THEN named[-1] END IGNORE NULLS) OVER (PARTITION BY visitor ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k),
    a AS (SELECT visitor, topics, unnest(CASE WHEN len(named) = 0 AND len(topics) > 0 AND prev IS NOT NULL THEN [prev] ELSE named END) AS entity FROM l)
    SELECT visitor, entity, topic, count(*) AS n FROM (SELECT visitor, entity, unnest(topics) AS topic FROM a) GROUP BY ALL"""
)
def topics_from_texts(spark: SparkSession, d: str) -> DataFrame:
    """Topics of turns by the entity they are about, named there or last before.

    Turns that share a seq, as those of conversations of over 100 turns may, come in the order of conversations.
    """
    place = F.when(F.col("seq").isNotNull(), F.struct("seq", (-F.col("ts")).alias("back")))
    out = session.mark_from_texts(_said(spark, d).withColumn("seq", place), RULES, RULES, {"the": "the"})
    return out["topics"].select("visitor", "entity", "topic", "n")


@register(
    f"""WITH {_LOG}, z AS (SELECT visitor, arg_max(text, seq) AS last_ask FROM a GROUP BY visitor),
    k AS (SELECT visitor, list(ask) AS asks FROM v WHERE reply IS NOT NULL AND ask IS NOT NULL GROUP BY visitor)
    SELECT visitor, list_sort(list_distinct(list_transform(list_concat([last_ask], coalesce(asks, [])), lambda x: trim(x)))) AS asked FROM z LEFT JOIN k USING (visitor)"""
)
def all_asked(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    last = dialogue.recorded_asks(log).groupBy("visitor").agg(F.max_by("text", "seq").alias("last_ask"))
    answered = dialogue.answered_asks(log).groupBy("visitor").agg(F.collect_list(F.struct("ask", "reply")).alias("answered"))
    none = F.array().cast("array<struct<ask:string,reply:string>>")
    both = last.join(answered, "visitor", "left").withColumn("answered", F.coalesce("answered", none))
    return both.select("visitor", F.array_sort(session.all_asked(F.col("last_ask"), F.col("answered"))).alias("asked"))


_STAGES = "[" + ", ".join(f"'{s}'" for s in funnel.STAGES) + "]"


@register(
    f"""WITH c AS (SELECT c_custkey AS visitor, c_custkey % 10 AS k, c_custkey % 3 = 0 AS interested, CASE WHEN c_custkey % 4 = 1 THEN c_name ELSE '' END AS person_name,
      CASE WHEN c_custkey % 5 = 0 THEN [c_mktsegment] ELSE [] END AS said, {_STAGES} AS s FROM customer)
    SELECT visitor, person_name, array_to_string(s[1:k], ',') AS done, array_to_string(s[k + 1:9], ',') AS pending,
      CASE WHEN k = 9 THEN '' WHEN k >= 2 THEN s[k + 1] WHEN interested THEN s[3] WHEN k = 1 OR person_name <> '' OR len(said) > 0 THEN s[2] ELSE s[1] END AS current_step_id,
      k = 0 AND person_name = '' AND len(said) = 0 AS is_new_visitor, len(said) AS n_said FROM c"""
)
def ask_context(spark: SparkSession, d: str) -> DataFrame:
    c, k, none = read_table(spark, d, "customer"), F.col("c_custkey"), F.array().cast("array<string>")
    stages = F.array(*[F.lit(s) for s in funnel.STAGES])
    states = c.select(
        k.alias("visitor"),
        F.when(k % 4 == 1, F.col("c_name")).alias("person_name"),
        F.slice(stages, F.lit(1), (k % 10).cast("int")).alias("asked"),
        F.when(k % 5 == 0, F.array("c_mktsegment")).otherwise(none).alias("utterances"),
        none.alias("answered"),
        F.lit(None).cast("string").alias("last_ask"),
        none.alias("recent"),
        F.when(k % 3 == 0, "some").otherwise("").alias("interest_summary"),
    )
    view = session.ask_context(states)
    joined = [F.array_join(f"{c}_titles", ",").alias(c) for c in ("done", "pending")]
    return view.select("visitor", "person_name", *joined, "current_step_id", "is_new_visitor", F.size("customer_utterances").cast("long").alias("n_said"))


@register(
    """WITH t AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'error' THEN 2 ELSE 1 END AS visitor,
      CASE event_type WHEN 'signup' THEN 'ask' WHEN 'purchase' THEN 'obtain' ELSE 'chat' END AS kind, event_type = 'purchase' AND event_id % 4 = 0 AS got FROM events),
    s AS (SELECT *, sum(CAST(kind = 'ask' AS INTEGER)) OVER (PARTITION BY session ORDER BY seq) AS stretch FROM t),
    f AS (SELECT *, sum(CAST(kind = 'obtain' AND NOT got AS INTEGER)) OVER w AS failures FROM s WINDOW w AS (PARTITION BY session, stretch ORDER BY seq)),
    e AS (SELECT *, stretch > 0 AND max(CAST(got OR kind = 'chat' AND visitor <> 1 OR failures >= 2 AS INTEGER)) OVER (PARTITION BY session, stretch ORDER BY seq) = 0 AS waiting FROM f)
    SELECT session, seq, waiting, CAST(CASE WHEN waiting THEN failures ELSE 0 END AS BIGINT) AS attempts, CASE WHEN waiting THEN 1 END AS pending FROM e"""
)
def name_attempts(spark: SparkSession, d: str) -> DataFrame:
    e, kind = read_table(spark, d, "events"), F.col("event_type")
    turns = e.select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("seq"),
        F.when(kind == "error", 2).otherwise(1).alias("visitor"),
        F.when(kind == "signup", "ask").when(kind == "purchase", "obtain").otherwise("chat").alias("kind"),
        F.when((kind == "purchase") & (F.col("event_id") % 4 == 0), "张三").otherwise("").alias("name"),
    )
    out = session.name_attempts(turns, 2)
    return out.withColumn("attempts", F.col("attempts").cast("long"))


@register("SELECT c_custkey AS visitor, CASE WHEN c_custkey % 3 = 0 THEN '李四' WHEN c_custkey % 2 = 0 THEN '王五' END AS person_name FROM customer")
def commit_names(spark: SparkSession, d: str) -> DataFrame:
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    states = c.select(k.alias("visitor"), F.when(k % 2 == 0, "王五").alias("person_name"))
    found = c.select(k.alias("visitor"), F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("张三").alias("name")), F.struct(F.lit(2).alias("seq"), F.lit("李四").alias("name")), F.struct(F.lit(3).alias("seq"), F.lit("2024").alias("name")))).alias("x"))
    return session.commit_names(found.where("visitor % 3 = 0").select("visitor", "x.*"), states)


@register(
    """SELECT name, mtime, name IN ('running.log', 'notes.txt') OR name NOT LIKE '%.log' OR row_number() OVER (PARTITION BY name LIKE '%.log' AND name <> 'running.log' ORDER BY mtime DESC, name) <= 50 AS keep
      FROM (SELECT CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN 'running.log' WHEN o_orderpriority = '5-LOW' THEN 'log' || o_orderkey || '.txt' ELSE 'log' || o_orderkey || '.log' END AS name,
            epoch(CAST(o_orderdate AS TIMESTAMP)) AS mtime FROM orders)"""
)
def log_retention(spark: SparkSession, d: str) -> DataFrame:
    """Of a log for each order, at its date, the first of them the running one, those to keep; others are no logs."""
    o = read_table(spark, d, "orders")
    first = o.agg(F.min("o_orderkey")).first()[0]
    key = F.concat(F.lit("log"), F.col("o_orderkey").cast("string"))
    name = F.when(F.col("o_orderkey") == first, "running.log").when(F.col("o_orderpriority") == "5-LOW", F.concat(key, F.lit(".txt"))).otherwise(F.concat(key, F.lit(".log")))
    return runtime.retained(o.select(name.alias("name"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("mtime")), running="running.log")


@register("SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'none': NULL}) AS VARCHAR) AS json FROM nation")
def result_json(spark: SparkSession, d: str) -> DataFrame:
    return runtime.result_json(read_table(spark, d, "nation").select("n_nationkey", "n_name", F.lit(None).cast("string").alias("none")))


@register(
    """WITH c AS (SELECT c_custkey AS k, lower(c_mktsegment) AS seg, c_name, [x FOR x IN ['hall', 'yard'] IF c_custkey % 4 >= CASE x WHEN 'hall' THEN 2 ELSE 3 END] AS places FROM customer),
    l AS (SELECT *, CASE len(places) WHEN 0 THEN 'You are at the entrance.' WHEN 1 THEN 'You are at hall.' ELSE 'You are near hall, yard.' END AS loc FROM c)
    SELECT k AS c_custkey, CASE k % 5 WHEN 0 THEN 'Give the name in: ' || seg
      WHEN 1 THEN 'The visitor''s name is not known.' || chr(10) || CASE k % 3 WHEN 0 THEN 'Nothing has been covered yet.' WHEN 1 THEN 'Everything has been covered.' ELSE 'Done: a. Open: b, c.' END
        || chr(10) || loc || chr(10) || 'Now: ' || seg || CASE WHEN k % 2 = 0 THEN chr(10) || 'Lead over to it from: ' || c_name ELSE '' END
      WHEN 2 THEN 'Ask for the visitor''s name.'
      ELSE CASE WHEN k % 2 = 0 THEN '张三 was here before.' ELSE 'The visitor has just come in.' END || chr(10)
        || CASE len(places) WHEN 0 THEN 'You are at the entrance.' ELSE 'Greet the visitor at ' || array_to_string(places, ', ') || '.' END
        || CASE WHEN k % 3 = 0 THEN chr(10) || CASE len(places) WHEN 0 THEN 'The visitor wants to go somewhere; ask where.' ELSE 'The visitor wants to go to ' || array_to_string(places, ', ') || '.' END ELSE '' END
        || CASE WHEN k % 3 = 1 THEN chr(10) || 'Speak about ' || seg || ' only.' WHEN k % 3 = 2 THEN chr(10) || 'Compare ' || seg || ', ' || c_name || ' fairly.' ELSE '' END
        || chr(10) || 'Leave nothing out that the records say.' || chr(10) || 'Speak as in a talk, without lists.' || chr(10) || 'Refer to what was said before, but do not repeat it.'
      END AS prompt FROM l"""
)
def routed_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's prompt: name extraction, active ask, asking the name, or identity, place, wish and style."""
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    none, seg = F.array().cast("array<string>"), F.lower("c_mktsegment")
    places = F.slice(F.array(F.lit("hall"), F.lit("yard")), F.lit(1), F.greatest(F.lit(0), (k % 4).cast("int") - 1))
    titles = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    n_done = F.when(k % 3 == 0, 0).when(k % 3 == 1, 3).otherwise(1)
    done, open_ = F.slice(titles, F.lit(1), n_done), F.slice(titles, n_done + 1, 3 - n_done)
    no_text = F.lit(None).cast("string")
    active = prompt.active_ask(no_text, no_text, done, open_, places, seg, F.when(k % 2 == 0, F.col("c_name")))
    named = F.when(k % 2 == 0, "张三")
    entities = F.when(k % 3 == 1, F.array(seg)).when(k % 3 == 2, F.array(seg, F.col("c_name"))).otherwise(none)
    usual = prompt.lines(
        prompt.identity_line(named, F.lit(True), F.lit(True)),
        prompt.greeting_place(places),
        prompt.visit_block(k % 3 == 0, places),
        prompt.entity_block(entities),
        prompt.static_blocks(),
    )
    routed = prompt.route(k % 5 == 0, k % 5 == 1, k % 5 == 2, prompt.name_prompt("extract_name", query=seg), active, prompt.name_prompt("ask_name"), usual)
    return c.select("c_custkey", routed.alias("prompt"))
