"""Text, splitting, tag and rule operators over documents, pages, conversations and part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestream.functions import names, overlap, tags, text
from lodestream.operators import dedup, rules
from lodestream.operators.embedding import hashed_bigrams
from lodestream.operators.splitting import split_records
from lodestream.plans.register import Registry, sql_key, sql_strip
from lodestream.storage import read_table

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: ASCII stand-ins for the rule parameters, as the supplied tables hold no Chinese.
FILLERS = ("the", "of", "and", "a")
ALIASES = {"en": "english", "fr": "french", "de": "german", "es": "spanish"}
KEYWORDS = ("visit", "tion", "the ")
RULES = (
    rules.Rule("ending", ("tion", "ment\\b"), title="Ending"),
    rules.Rule("both", ("th", "ch"), ("er", "en"), title="Both"),
    rules.Rule("mark", ("[|]", "!!", "%%%"), title="Mark"),
    rules.Rule("never", ("zzzz",), title="Never"),
)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents")


@register(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_filter(list_transform(
      string_split(regexp_replace(regexp_replace(text, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', ' ', 'g'), '\r\n?', chr(10), 'g'), chr(10)),
      lambda raw: CASE
        WHEN {sql_strip("raw")} = '' THEN ''
        WHEN starts_with({sql_strip("raw")}, '|') THEN {sql_strip("raw")}
        WHEN length(regexp_replace(raw, '[^一-鿿A-Za-z0-9]', '', 'g')) = 0 AND length(regexp_replace(raw, '\s+', '', 'g')) >= 3 THEN NULL
        WHEN length(regexp_replace(raw, '[^一-鿿A-Za-z0-9]', '', 'g')) > 0
         AND length(regexp_replace(raw, '[^一-鿿A-Za-z0-9]', '', 'g')) / length(regexp_replace(raw, '\s+', '', 'g')) < 0.25 THEN NULL
        WHEN len(regexp_split_to_array({sql_strip("raw")}, '\s+')) >= 4
         AND len(list_filter(regexp_split_to_array({sql_strip("raw")}, '\s+'), lambda w: length(w) = 1)) / len(regexp_split_to_array({sql_strip("raw")}, '\s+')) >= 0.6
        THEN regexp_replace(raw, '\s+', '', 'g')
        ELSE regexp_replace({sql_strip("raw")}, '\s+', ' ', 'g') END), lambda x: x IS NOT NULL), chr(10)),
      '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents"""
)
def doc_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


@register(f"SELECT doc_id, {sql_key('text')} AS dedup_key FROM documents")
def dedup_keys(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.dedup_key(F.col("text")).alias("dedup_key"))


@register(
    rf"""SELECT doc_id, pos, line,
      CASE WHEN length({sql_strip("line")}) NOT BETWEEN 1 AND 40 OR substr({sql_strip("line")}, 1, 1) IN ('#', '|')
             OR regexp_matches({sql_strip("line")}, '^\s*([-*•·]|\d+[.、）)])\s+') OR regexp_matches({sql_strip("line")}, '[。！？，；、!?,;…]$') THEN NULL
           WHEN regexp_matches({sql_strip("line")}, '^\d+\.\d+\.\d+(?:[\s、.．]|$)') THEN 4
           WHEN regexp_matches({sql_strip("line")}, '^\d+\.\d+(?:[\s、.．]|$)') THEN 3
           WHEN boundary AND length({sql_strip("line")}) <= 20 AND len(regexp_split_to_array({sql_strip("line")}, '\s+')) <= 2 AND {sql_strip("coalesce(nxt, '')")} <> ''
             AND NOT regexp_matches({sql_strip("line")}, '[。，；：,;:]') AND NOT regexp_matches({sql_strip("line")}, '^[\d\s.%-]+$') THEN 2 END AS level
      FROM (SELECT doc_id, pos, line, lead(line) OVER w AS nxt, coalesce({sql_strip("lag(line) OVER w")} = '', true) AS boundary
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
            WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
)
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Heading levels of lines, a boundary being the start of the text or a blank line."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumns({"next": F.lead("line").over(w), "boundary": F.coalesce(text.strip(F.lag("line").over(w)) == "", F.lit(True))})
    return lines.select("doc_id", F.col("pos").cast("long").alias("pos"), "line", text.heading_level(F.col("line"), F.col("boundary"), F.col("next")).alias("level"))


#: A line's state follows from the line before unless it is sure: it is on if one since the last break is sure.
_ON = "max(CAST(sure AS INTEGER)) OVER (PARTITION BY doc_id, run ORDER BY i ROWS UNBOUNDED PRECEDING) = 1"
_RUN = "sum(CAST(NOT (sure OR carries) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run"
_LINES = f"l AS (SELECT doc_id, i, line, {sql_strip('line')} AS bare FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, 1 + len(string_split(text, chr(10))))) AS i FROM documents))"


@register(
    rf"""WITH {_LINES},
    n AS (SELECT *, regexp_matches(line, '^\[\[PAGE=\d+\]\]\s*$') AS marker,
      length(bare) BETWEEN 1 AND 40 AND substr(bare, 1, 1) NOT IN ('#', '|') AND NOT regexp_matches(bare, '^\s*([-*•·]|\d+[.、）)])\s+') AND NOT regexp_matches(bare, '[。！？，；、!?,;…]$') AS possible,
      length(bare) <= 20 AND len(regexp_split_to_array(bare, '\s+')) <= 2 AND coalesce(lead(bare) OVER (PARTITION BY doc_id ORDER BY i), '') <> ''
        AND NOT regexp_matches(bare, '[。，；：,;:]') AND NOT regexp_matches(bare, '^[\d\s.%-]+$') AS short,
      CASE WHEN regexp_matches(bare, '^\d+\.\d+\.\d+(?:[\s、.．]|$)') THEN 4 WHEN regexp_matches(bare, '^\d+\.\d+(?:[\s、.．]|$)') THEN 3 END AS numbered FROM l),
    m AS (SELECT *, CASE WHEN NOT marker AND possible THEN numbered END AS lf, CASE WHEN NOT marker AND possible THEN coalesce(numbered, CASE WHEN short THEN 2 END) END AS lt FROM n),
    e AS (SELECT doc_id, i, marker OR bare = '' OR regexp_matches(bare, '[。！？!?…；;：]$') OR regexp_matches(bare, '\d+(?:\.\d+)?\s*[a-zA-Z%‰°℃入万亿元件个条款]{{0,6}}$') OR lf IS NOT NULL AS sure, lt IS NOT NULL AS carries FROM m
      UNION ALL SELECT doc_id, 0, true, false FROM documents),
    r AS (SELECT *, {_RUN} FROM e), b AS (SELECT doc_id, i + 1 AS i, {_ON} AS boundary FROM r),
    o AS (SELECT doc_id, string_agg(CASE WHEN CASE WHEN boundary THEN lt ELSE lf END IS NULL THEN line ELSE repeat('#', CASE WHEN boundary THEN lt ELSE lf END) || ' ' || bare END, chr(10) ORDER BY i) AS t FROM m JOIN b USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text = '' OR len(regexp_extract_all(text, '(?m)^#{{1,6}}\s+\S')) >= 2 THEN text ELSE t END AS promoted FROM documents JOIN o USING (doc_id)"""
)
def promoted_headings(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.promote_headings(F.col("text")).alias("promoted"))


@register(
    rf"""WITH {_LINES},
    n AS (SELECT *, NOT regexp_matches(bare, '[。！？!?…；;：]$') AS runs, regexp_matches(bare, '^\[\[PAGE=\d+\]\]\s*$') AS marker FROM l),
    m AS (SELECT *, runs AND length(bare) >= 30 AND NOT starts_with(bare, '|') AND NOT marker AS opens,
      bare <> '' AND substr(bare, 1, 1) NOT IN ('#', '|') AND NOT marker AND NOT regexp_matches(bare, '^\s*([-*•·]|\d+[.、）)])\s+') AS goes FROM n),
    e AS (SELECT *, coalesce(goes AND lag(opens) OVER w, false) AS sure, coalesce(goes AND lag(runs) OVER w, false) AS carries FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    r AS (SELECT *, {_RUN} FROM e), j AS (SELECT *, {_ON} AS joined FROM r),
    k AS (SELECT *, coalesce(lead(joined) OVER (PARTITION BY doc_id ORDER BY i), false) AS more FROM j)
    SELECT doc_id, substr(string_agg(CASE WHEN joined THEN bare WHEN more THEN chr(10) || regexp_replace(line, '\s+$', '') ELSE chr(10) || line END, '' ORDER BY i), 2) AS unwrapped FROM k GROUP BY doc_id"""
)
def unwrapped_lines(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.unwrap_lines(F.col("text")).alias("unwrapped"))


@register(
    r"""SELECT doc_id, regexp_replace(regexp_replace(text || ' <INTENT>go' || chr(10) || 'on</INTENT> ', '(?s)\s*<INTENT>.*?</INTENT>\s*$', ''), '^\s+|\s+$', '', 'g') AS bare FROM documents"""
)
def intent_strip(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.strip_intent_suffix(F.concat("text", F.lit(" <INTENT>go\non</INTENT> "))).alias("bare"))


@register(
    r"""SELECT p_partkey, '| ' || array_to_string([p_name, p_brand, p_type], ' | ') || ' |' || chr(10) || '|---|---|---|' || chr(10) || '| ' || p_size || ' |  |  |' AS markdown FROM part"""
)
def table_render(spark: SparkSession, d: str) -> DataFrame:
    rows = F.array(F.array("p_name", "p_brand", "p_type"), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.col("p_size").cast("string")))
    return read_table(spark, d, "part").select("p_partkey", text.render_table(rows).alias("markdown"))


@register(
    r"""SELECT page_id, replace(regexp_replace(list_extract(string_split(replace(url, '\', '/'), '/'), -1), '\.[A-Za-z0-9]+$', ''), '_', ' ') AS title,
      regexp_replace(url, '^[./]+', '') AS source_key,
      CASE WHEN len(string_split(regexp_replace(url, '^https?://', ''), '/')) > 1 THEN string_split(regexp_replace(url, '^https?://', ''), '/')[1] ELSE 'general' END AS tag,
      regexp_replace(list_extract(string_split(url, '/'), -1), '\.[^./]+$', '') || '.json' AS mirror,
      regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g') AS safe,
      NOT regexp_matches(url, '^/|(^|/)\.\.(/|$)') AS safe_path,
      regexp_replace(url, '[^A-Za-z0-9_.-]', '_', 'g') || '.json' AS state_file,
      replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages"""
)
def page_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles, source keys, tags, mirror paths and safe names made from URLs."""
    url = F.col("url")
    return read_table(spark, d, "pages").select(
        "page_id",
        text.document_title(url).alias("title"),
        text.source_key(url).alias("source_key"),
        text.first_directory(F.regexp_replace(url, "^https?://", "")).alias("tag"),
        text.mirror_path(url, "data").alias("mirror"),
        text.safe_name(url).alias("safe"),
        text.is_safe_path(url).alias("safe_path"),
        text.state_file_name(url).alias("state_file"),
        text.html_escape(url).alias("escaped"),
    )


@register(
    r"""SELECT conv_id, turn, substr(regexp_replace(regexp_replace('<INTENT>x</INTENT> ' || text, '(?is)<INTENT>.*?</INTENT>', '', 'g'), '^\s+|\s+$', '', 'g').regexp_replace('\s+', ' ', 'g'), 1, 120) AS ask FROM conversations"""
)
def ask_texts(spark: SparkSession, d: str) -> DataFrame:
    asks = text.ask_text(F.concat(F.lit("<INTENT>x</INTENT> "), F.col("text")))
    return read_table(spark, d, "conversations").select("conv_id", "turn", asks.alias("ask"))


@register("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select("event_id", text.iso_seconds(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("iso"))


@register(
    r"""SELECT conv_id, turn, CASE WHEN rest = '' THEN bare ELSE rest END AS stripped FROM (
      SELECT conv_id, turn, bare, regexp_replace(bare, '^(?:(?:the|of|and|a)[，。、！？,.!?;；…·—\-~～ \t\r\n　]*)+', '') AS rest
      FROM (SELECT conv_id, turn, regexp_replace(lower(text), '^\s+|\s+$', '', 'g') AS bare FROM conversations))"""
)
def filler_strip(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", tags.strip_fillers(F.lower("text"), FILLERS).alias("stripped"))


_TAGS = "list_filter(['en', 'fr', 'de', 'es'], lambda t: regexp_matches(lower(url), '(?:^|[^a-z0-9])' || t || '(?:$|[^a-z0-9])'))"


@register(f"SELECT page_id, list_sort({_TAGS}) AS tags FROM pages")
def tag_detect(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", F.array_sort(tags.detect_tags(F.col("url"), list(ALIASES))).alias("tags"))


@register(
    f"""SELECT page_id, list_sort(list_transform({_TAGS}, lambda t: CASE t WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' ELSE 'spanish' END)) AS entities FROM pages"""
)
def entity_extract(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "pages").select("page_id", F.array_sort(tags.detect_entities(F.col("url"), ALIASES)).alias("entities"))


@register(
    """SELECT doc_id, CASE WHEN lang = source THEN [lang] ELSE [lang, source] END AS merged, [source] AS places, source AS single FROM documents"""
)
def tag_merge(spark: SparkSession, d: str) -> DataFrame:
    merged = tags.merge_tags(F.array(F.upper("lang"), F.lit(" ")), F.array("source", "lang"))
    some = F.array(F.lit("general"), F.lit("active_ask_x"), F.lit("home"), F.upper("source"))
    return _docs(spark, d).select(
        "doc_id",
        merged.alias("merged"),
        tags.place_tags(some, "home").alias("places"),
        tags.single_place(some, F.array("source"), "home").alias("single"),
    )


@register(
    """SELECT doc_id, CASE WHEN trim(lang) IN ('en', 'de') THEN CASE lang WHEN 'en' THEN 'English' ELSE 'German' END || '，' || source ELSE source END AS prefixed,
       CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE upper(lang) END AS display FROM documents"""
)
def entity_prefix(spark: SparkSession, d: str) -> DataFrame:
    shown = F.create_map(*[F.lit(x) for x in ("en", "English", "de", "German")])
    prefixed = tags.prefix_names(F.col("source"), F.array(F.lit("general"), "lang", "lang"), shown)
    return _docs(spark, d).select("doc_id", prefixed.alias("prefixed"), text.display_name(F.col("lang"), shown).alias("display"))


@register(
    r"""SELECT conv_id, turn, regexp_matches(text, 'visit|tion|the ') AS intent,
      CASE WHEN regexp_matches(text, 'visit|tion|the ') THEN CASE WHEN len(list_filter(['Ing', 'Th', 'zzz'], lambda x: contains(text, x))) > 0
        THEN list_transform(list_filter(['Ing', 'Th', 'zzz'], lambda x: contains(text, x)), lambda x: lower(x)) ELSE ['home'] END END AS nav FROM conversations"""
)
def visit_intent(spark: SparkSession, d: str) -> DataFrame:
    places = F.array(F.lit("Ing"), F.lit("Th"), F.lit("zzz"))
    return read_table(spark, d, "conversations").select(
        "conv_id", "turn", tags.has_visit_intent(F.col("text"), KEYWORDS).alias("intent"), tags.navigation_tags(F.col("text"), KEYWORDS, places, "home").alias("nav")
    )


@register("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lower(c_mktsegment) END AS pose, c_name AS query, c_mktsegment AS usr FROM customer")
def command_parse(spark: SparkSession, d: str) -> DataFrame:
    """A near-pose command and a query that names its user."""
    c = read_table(spark, d, "customer")
    command = F.concat(F.lit("ask now nearby_pose="), F.when(F.col("c_custkey") % 3 == 0, "active_ask_x").otherwise(F.col("c_mktsegment")))
    query, user = tags.split_user(F.concat("c_name", F.lit(" --"), "c_mktsegment"))
    return c.select("c_custkey", tags.pose(command).alias("pose"), query.alias("query"), user.alias("usr"))


@register(
    rf"""SELECT doc_id, pos, sentence FROM (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (
      SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip("x")}), lambda x: x <> ''), lambda l:
        CASE WHEN regexp_matches(l, '^\s*([-*•·]|\d+[.、）)]|[（(]?[一二三四五六七八九十]+[）)、.])\s+') OR starts_with(l, '|') THEN [l]
        ELSE list_filter(list_transform(regexp_extract_all(l, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+'), lambda p: {sql_strip("p")}), lambda p: p <> '') END)) AS s FROM documents))"""
)
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@register("SELECT doc_id, length(text) AS n FROM documents WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 300")
def min_length_filter(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where(F.length(text.strip(F.col("text"))) >= 300).select("doc_id", F.length("text").cast("long").alias("n"))


@register(f"SELECT min(doc_id) AS doc_id, {sql_key('text')} AS dedup_key FROM documents WHERE {sql_key('text')} <> '' GROUP BY 2")
def doc_dedup_exact(spark: SparkSession, d: str) -> DataFrame:
    kept = dedup.dedup_documents(_docs(spark, d).select("doc_id", "text"))
    return kept.select("doc_id", text.dedup_key(F.col("text")).alias("dedup_key"))


@register(
    rf"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS chunk_id, text FROM (
      SELECT doc_id, pos, text, row_number() OVER (PARTITION BY {sql_key("text")} ORDER BY doc_id, pos) AS n FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
      WHERE length({sql_strip("text")}) >= 15) WHERE n = 1"""
)
def chunk_dedup_global(spark: SparkSession, d: str) -> DataFrame:
    """Lines as candidate chunks: short ones out, first of equal ones across the batch, numbered densely."""
    lines = _docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("body", F.col("text"))
    return dedup.number_chunks(lines).select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), "text")


@register()
def split_documents_rows(spark: SparkSession, d: str) -> DataFrame:
    """Structure-aware chunks of all documents, over-long sections cut at semantic breaks."""
    return split_records(_docs(spark, d).select("doc_id", "source", "text"), embed=hashed_bigrams)


_CLASSES = """list_filter([CASE WHEN regexp_matches(text, '(?i)tion|ment\\b') THEN 'ending' END,
      CASE WHEN regexp_matches(text, '(?i)th|ch') AND regexp_matches(text, '(?i)er') AND regexp_matches(text, '(?i)en') THEN 'both' END,
      CASE WHEN regexp_matches(text, '[|]|!!|%%%') THEN 'mark' END], lambda x: x IS NOT NULL)"""


@register(
    f"""SELECT conv_id, turn, c AS classes, CASE WHEN len(c) = 0 THEN '无' ELSE array_to_string(list_transform(c, lambda x: upper(x[1]) || x[2:]), '、') END AS summary
      FROM (SELECT conv_id, turn, {_CLASSES} AS c FROM conversations)"""
)
def rule_classify(spark: SparkSession, d: str) -> DataFrame:
    c = rules.classify(F.col("text"), RULES)
    return read_table(spark, d, "conversations").select("conv_id", "turn", c.alias("classes"), rules.titles(c, RULES).alias("summary"))


@register(
    f"""SELECT page_id, CASE WHEN len(e) = 0 AND len(c) > 0 THEN ['all'] ELSE e END AS entities, c AS topics FROM (
      SELECT page_id, {_CLASSES.replace("text", "url")} AS c, list_filter(['english'], lambda t: regexp_matches(lower(url), '(?:^|[^a-z0-9])en(?:$|[^a-z0-9])')) AS e FROM pages)"""
)
def preference_detect(spark: SparkSession, d: str) -> DataFrame:
    entities, topics = rules.preferences(F.col("url"), RULES, {"en": "english"}, F.array(F.lit("all")))
    return read_table(spark, d, "pages").select("page_id", entities.alias("entities"), topics.alias("topics"))


@register(
    r"""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '张三' WHEN 1 THEN '刘先生' WHEN 2 THEN '欧阳先生' ELSE '' END AS introduced,
      c_custkey % 4 = 0 AS is_name FROM customer"""
)
def name_rules(spark: SparkSession, d: str) -> DataFrame:
    said = F.get(F.array(F.lit("你好我叫张三吧"), F.lit("免贵姓刘"), F.lit("我姓欧阳"), F.lit("我叫不出来")), (F.col("c_custkey") % 4).cast("int"))
    shown = F.when(F.col("c_custkey") % 4 == 0, "张三").otherwise("2024_1_2_3_4")
    return read_table(spark, d, "customer").select("c_custkey", names.introduced_name(said).alias("introduced"), names.is_person_name(shown).alias("is_name"))


def _sql_bigrams(x: str) -> str:
    return rf"list_distinct(list_transform(range(1, length(regexp_replace({x}, '\s+', '', 'g'))), lambda i: substr(regexp_replace({x}, '\s+', '', 'g'), i, 2)))"


@register(
    f"""WITH s AS (SELECT a.item_id AS item, b.item_id AS other, {_sql_bigrams("a.text")} AS x, {_sql_bigrams("b.text")} AS y
      FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)
    SELECT item, other, round(len(list_intersect(x, y)) / least(len(x), len(y)), 6) AS coverage,
      round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS jaccard FROM s"""
)
def bigram_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and Jaccard similarity of neighbouring benchmark items."""
    b = read_table(spark, d, "benchmark")
    one = b.select(F.col("item_id").alias("item"), overlap.bigrams(F.col("text")).alias("x"))
    two = b.select(F.col("item_id").alias("other"), overlap.bigrams(F.col("text")).alias("y"))
    pairs = one.join(two, F.col("other") == F.col("item") + 1)
    x, y = F.col("x"), F.col("y")
    return pairs.select("item", "other", F.round(overlap.coverage(x, y), 6).alias("coverage"), F.round(overlap.jaccard(x, y), 6).alias("jaccard"))


@register(
    r"""SELECT conv_id, turn, NOT starts_with(trim(text), 'Th') AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 2 AND NOT regexp_matches(lower(text), '^(of|in)$') AS recordable,
      starts_with(text, 'Th') AS command FROM conversations"""
)
def recordable(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read_table(spark, d, "conversations").select(
        "conv_id", "turn", overlap.is_recordable(t, "Th", "(?i)^(of|in)$").alias("recordable"), overlap.is_command(t, "Th").alias("command")
    )


@register(
    r"""SELECT doc_id, list_concat([t], list_filter(list_transform(regexp_split_to_array(t, '[。！？!?；;]+'), lambda c: trim(c, ' ，,')),
      lambda c: length(c) >= 4 AND regexp_matches(c, 'th|qu'))) AS cores FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents)"""
)
def clause_cores(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", overlap.clause_cores(F.col("text"), ("th", "qu")).alias("cores"))


@register(
    """SELECT c_custkey, 'we like ' || CASE lower(c_mktsegment) WHEN 'building' THEN 'Houses' ELSE c_mktsegment END || ' and xbuilding' AS rewritten,
      ['./' || c_name, c_name, '/srv/x/' || c_name] AS variants, c_custkey % 2 = 0 AS moves, c_custkey % 3 <> 0 AS plain_key,
      CASE WHEN c_custkey % 2 = 0 THEN [c_name] ELSE [CAST(NULL AS VARCHAR)][1:0] END AS asked FROM customer"""
)
def customer_texts(spark: SparkSession, d: str) -> DataFrame:
    """Tags rewritten, source-key variants, the move predicate, safe keys, and asked texts."""
    name, n = F.col("c_name"), F.col("c_custkey")
    reply = F.when(n % 2 == 0, " <intent> go </INTENT> on").otherwise("on <INTENT>go</INTENT>")
    pairs = F.array(F.struct(F.when(n % 2 == 0, name).alias("ask")), F.struct(F.lit(" ").alias("ask")))
    return read_table(spark, d, "customer").select(
        "c_custkey",
        text.rewrite_tags(F.concat(F.lit("we like "), "c_mktsegment", F.lit(" and xbuilding")), {"building": "Houses"}).alias("rewritten"),
        text.source_key_variants(F.concat(F.lit("./"), name), "/srv/x").alias("variants"),
        overlap.starts_with_intent(reply, "go").alias("moves"),
        text.is_plain_key(F.when(n % 3 == 0, F.concat(name, F.lit("/.."))).otherwise(name)).alias("plain_key"),
        overlap.asked_texts(pairs).alias("asked"),
    )
