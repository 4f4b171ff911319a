"""Person names in utterances, by rule, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.text import blank, strip

#: Fixed values.
PARTICLES = "吧呢啊呀哦哈嘛"
STOP_CHARACTERS = "的了吗呢吧啊呀哦哈嘛不没啥谁这那它他她你我您和跟与什么怎么去来到看走"
HONORIFICS = ("先生", "女士", "小姐")
DEFAULT_HONORIFIC = "先生"
COMPOUND_SURNAMES = (
    "欧阳", "司马", "上官", "诸葛", "东方", "皇甫", "尉迟", "公孙", "令狐", "慕容", "长孙", "宇文",
    "司徒", "司空", "夏侯", "独孤", "南宫", "西门", "东郭", "百里", "呼延", "澹台", "端木", "申屠",
)
FULL_NAME_INTRO = r"(?:我叫|叫我|我名叫|名字(?:叫|是))\s*([一-鿿]{1,4})"
SURNAME_INTRO = r"(?:我姓|免贵姓|敝姓|本人姓|鄙人姓)\s*([一-鿿]{1,2})"
INTRO_PREFIX = r"^(?:大家都?(?:都)?叫我|叫我|我?(?:叫|是|姓)|名字(?:叫|是)?|称呼(?:是|叫)?)\s*"
SENTENCE_MARK = r"[，。！？；：,.!?;:]"
TIMESTAMP_ID = r"^\d{4}_\d{1,2}_\d{1,2}_\d{1,2}_\d{1,2}$"


def is_timestamp_id(c: Column) -> Column:
    return strip(blank(c)).rlike(TIMESTAMP_ID)


def is_person_name(c: Column) -> Column:
    bare = strip(blank(c))
    return (bare != "") & ~is_timestamp_id(c) & bare.rlike("[一-鿿]")


def plausible(c: Column) -> Column:
    return c.rlike(rf"^[^{STOP_CHARACTERS}]+\z")


def _no_particles(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{PARTICLES}]+\z", "")


def introduced_name(text: Column) -> Column:
    """A name the speaker gives, or a surname with the default honorific; empty if none."""
    said = strip(blank(text))
    full = _no_particles(F.regexp_extract(said, FULL_NAME_INTRO, 1))
    surname = _no_particles(F.regexp_extract(said, SURNAME_INTRO, 1))
    first = F.substring(surname, 1, 1)
    return (
        F.when(plausible(full) & (F.length(full) == 1), F.concat(full, F.lit(DEFAULT_HONORIFIC)))
        .when(plausible(full), full)
        .when(surname.isin(*COMPOUND_SURNAMES), F.concat(surname, F.lit(DEFAULT_HONORIFIC)))
        .when(plausible(first), F.concat(first, F.lit(DEFAULT_HONORIFIC)))
        .otherwise("")
    )


def sanitized_name(raw: Column, surnames: str, empty_tokens: tuple[str, ...], refusals: tuple[str, ...]) -> Column:
    """A name as a model put it, made clean: two to four Chinese characters, or a name with an honorific.

    ``surnames`` holds the single-character surnames that stand for a person, ``empty_tokens`` answers that
    mean no name and ``refusals`` words of sentences that decline.
    """
    text = strip(F.regexp_replace(F.regexp_replace(blank(raw), r"(?is)<INTENT>.*?</INTENT>", ""), r"(?is)<LOCATION>.*?</LOCATION>", ""))
    refused = text.rlike(SENTENCE_MARK) | (F.regexp_count(text, F.lit("[一-鿿]")) > 6)
    for word in refusals:
        refused = refused | text.contains(word)
    name = F.regexp_replace(text, r"""^[「」『』"' \t\n\r]+|[「」『』"' \t\n\r]+\z""", "")
    for _ in range(3):
        name = strip(F.regexp_replace(name, INTRO_PREFIX, ""))
    name = strip(_no_particles(name))
    empty = name.isin("", *empty_tokens) | F.lower(name).isin(*empty_tokens)
    out = F.when((text == "") | F.lower(text).isin(*empty_tokens) | refused | empty, "")
    for h in HONORIFICS:
        body = F.regexp_replace(name, rf"{h}\z", "")
        out = out.when(name.endswith(h), F.when(body.rlike(r"^[一-鿿]{1,4}\z") & plausible(body), name).otherwise(""))
    one = F.when(F.contains(F.lit(surnames), name), F.concat(name, F.lit(DEFAULT_HONORIFIC))).otherwise("")
    return out.when(F.length(name) == 1, one).when(name.rlike(r"^[一-鿿]{2,4}\z"), name).otherwise("")
