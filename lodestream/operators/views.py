"""Visitor state: its schema, normalisation of older shapes, and the rows shown of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.text import iso_seconds, strip
from lodestream.operators.dialogue import MAX_ANSWERED, MAX_RECENT, MAX_UTTERANCES
from lodestream.operators.funnel import STAGES

STEP = "struct<id:string,title:string,order:int,asked:boolean,asked_at:double>"
TOPIC = "struct<title:string,count:int,first_asked_at:double,last_asked_at:double>"
STATE = (
    "struct<vision_user_id:string,person_name:string,created_at:double,updated_at:double,asked:boolean,first_asked_at:double,"
    "ask_name:struct<asked:boolean,first_asked_at:double>,"
    f"tour_process:struct<steps:array<{STEP}>>,"
    f"interest_profile:struct<vehicles:map<string,struct<ask_count:string,first_asked_at:double,last_asked_at:double,topics:map<string,{TOPIC}>>>,"
    "last_vehicle_tag:string>,"
    "customer_memory:struct<utterances:array<struct<text:string,recorded_at:double>>,"
    "answered_asks:array<struct<ask:string,reply:string,recorded_at:double>>,recent_asks:array<struct<text:string,asked_at:double>>>,"
    "last_active_ask:struct<text:string,asked_at:double>>"
)


def read_states(files: DataFrame) -> DataFrame:
    """(key, state) of JSON texts (key, json); what is not an object is left out."""
    parsed = files.select("key", F.from_json("json", STATE, {"mode": "PERMISSIVE"}).alias("state"), "json")
    return parsed.where(F.col("json").rlike(r"^\s*\{") & F.col("state").isNotNull()).drop("json")


def migrate_legacy(legacy: DataFrame, existing: DataFrame) -> DataFrame:
    """States of a single-file map (json) whose keys do not exist yet."""
    rows = legacy.select(F.explode(F.from_json("json", "map<string,string>")).alias("key", "json"))
    return read_states(rows.join(existing.select("key"), "key", "left_anti"))


def default_steps(titles: dict[str, str] | None = None) -> Column:
    titles = titles or {}
    rows = [F.struct(F.lit(s).alias("id"), F.lit(titles.get(s, s)).alias("title"), F.lit(i + 1).alias("order"), F.lit(False).alias("asked"), F.lit(None).cast("double").alias("asked_at")) for i, s in enumerate(STAGES)]
    return F.array(*rows).cast(f"array<{STEP}>")


def merged_steps(saved: Column, titles: dict[str, str] | None = None) -> Column:
    """The defined steps, each with what was saved for its id."""

    def one(step: Column) -> Column:
        old = F.get(F.filter(F.coalesce(saved, F.array().cast(f"array<{STEP}>")), lambda x: x["id"] == step["id"]), F.lit(0))
        asked = F.coalesce(old["asked"], F.lit(False))
        return step.withField("asked", asked).withField("asked_at", F.when(asked, old["asked_at"]))

    return F.transform(default_steps(titles), one)


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)


def normalized(states: DataFrame) -> DataFrame:
    """States in one shape: missing parts filled, blank and malformed entries out, lists cut."""
    s, m = F.col("state"), F.col("state.customer_memory")
    text = lambda x: (strip(F.coalesce(x["text"], F.lit(""))) != "")
    memory = F.struct(
        _last(F.coalesce(F.filter(m["utterances"], text), F.array().cast("array<struct<text:string,recorded_at:double>>")), MAX_UTTERANCES).alias("utterances"),
        _last(F.coalesce(F.filter(m["answered_asks"], lambda x: strip(F.coalesce(x["ask"], F.lit(""))) != ""), F.array().cast("array<struct<ask:string,reply:string,recorded_at:double>>")), MAX_ANSWERED).alias("answered_asks"),
        _last(F.coalesce(F.filter(m["recent_asks"], text), F.array().cast("array<struct<text:string,asked_at:double>>")), MAX_RECENT).alias("recent_asks"),
    )
    vehicles = F.coalesce(F.col("state.interest_profile.vehicles"), F.create_map().cast("map<string,struct<ask_count:string,first_asked_at:double,last_asked_at:double,topics:map<string," + TOPIC + ">>>"))
    whole = F.transform_values(
        F.transform_keys(F.map_filter(vehicles, lambda k, v: v.isNotNull() & (strip(k) != "")), lambda k, _: F.lower(strip(k))),
        lambda _, v: F.struct(
            F.greatest(F.coalesce(v["ask_count"].try_cast("int"), F.lit(1)), F.lit(1)).alias("ask_count"),
            v["first_asked_at"].alias("first_asked_at"), v["last_asked_at"].alias("last_asked_at"),
            F.transform_values(F.map_filter(F.coalesce(v["topics"], F.create_map().cast(f"map<string,{TOPIC}>")), lambda _, t: t.isNotNull()),
                lambda k, t: t.withField("title", F.coalesce(t["title"], k)).withField("count", F.greatest(F.coalesce(t["count"], F.lit(1)), F.lit(1)))).alias("topics"),
        ),
    )
    newest = F.array_max(F.transform(F.map_entries(whole), lambda e: F.struct(F.coalesce(e["value"]["last_asked_at"], F.lit(0.0)).alias("at"), e["key"].alias("tag"))))
    return states.select(
        "key",
        s["person_name"].alias("person_name"), s["created_at"].alias("created_at"), s["updated_at"].alias("updated_at"),
        F.struct(
            F.coalesce(s["ask_name"]["asked"], s["asked"], F.lit(False)).alias("asked"),
            F.coalesce(s["ask_name"]["first_asked_at"], s["first_asked_at"]).alias("first_asked_at"),
        ).alias("ask_name"),
        merged_steps(s["tour_process"]["steps"]).alias("steps"),
        whole.alias("vehicles"),
        F.coalesce(F.lower(strip(s["interest_profile"]["last_vehicle_tag"])), newest["tag"]).alias("last_vehicle_tag"),
        memory.alias("memory"),
        F.struct(strip(F.coalesce(s["last_active_ask"]["text"], F.lit(""))).alias("text"), s["last_active_ask"]["asked_at"].alias("asked_at")).alias("last_active_ask"),
    )


def visitor_list(states: DataFrame) -> DataFrame:
    """Summary rows, last updated first."""
    done = F.size(F.filter("steps", lambda x: x["asked"]))
    topics = F.aggregate(F.map_values("vehicles"), F.lit(0), lambda n, v: n + F.size(v["topics"]))
    rows = states.select(
        "key", "person_name", F.col("ask_name.asked").alias("name_asked"), done.alias("n_done"), F.size("steps").alias("n_steps"),
        F.size("vehicles").alias("n_entities"), topics.alias("n_topics"), iso_seconds(F.col("created_at")).alias("created"), iso_seconds(F.col("updated_at")).alias("updated"),
    )
    return rows.orderBy(F.col("updated").desc_nulls_last(), "key")


def visitor_detail(states: DataFrame, key: str) -> DataFrame:
    """One visitor: steps with done, current or pending, and entities by (last asked, count)."""
    first = F.get(F.filter("steps", lambda x: ~x["asked"]), F.lit(0))["id"]
    status = lambda x: F.when(x["asked"], "done").when(x["id"] == first, "current").otherwise("pending")
    steps = F.transform("steps", lambda x: F.struct(x["id"].alias("id"), x["title"].alias("title"), status(x).alias("status")))
    entries = F.transform(F.map_entries("vehicles"), lambda e: F.struct((-e["value"]["last_asked_at"]).alias("at"), (-e["value"]["ask_count"]).alias("n"), e["key"].alias("tag")))
    return states.where(F.col("key") == key).select("key", "person_name", steps.alias("steps"), F.transform(F.array_sort(entries), lambda e: e["tag"]).alias("entities"), "memory")
