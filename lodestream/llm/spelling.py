"""Spelling variants: words one edit apart, found by hashes of what is left when one code point is deleted.

Words are counted in a DataFrame plan and numbered in code-point order. Two words of one length that differ in one
place leave the same rest when that place is deleted; a word that is another one with a code point more leaves
that other one. So each word posts the hash of each of its rests, and of itself. Rests are not made for that: with
polynomial hashes of all prefixes and suffixes, taken for all words of a length at once, the hash of the rest
without place i is two products and a sum. Keys are dealt by their leading bits into radix buckets of bounded size
and sorted there; keys that meet are held against the rests themselves, so a collision costs time and no more.

Of the words with one rest, those that lost the same place are each other's neighbours, at most one for each letter
of the alphabet, so neither a rest nor a word has many, and no key is hot. For each word and bucket its neighbours'
number and best are added up before they are shuffled. Roots are found by following forms, twice as far each time.

Defined results: null texts have no words; a null doc_id counts as empty text before the colon; repeated rows count
each time; words of more than ``LONG`` code points post a second hash of 62 bits in place of their text, their forms
are compared in full at the end; an empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.buffers import giving_back
from lodestream.llm.order import sorted_runs
from lodestream.storage import bound_batches, materialize, scratch

LETTERS = r"A-Za-zÀ-ÿ"
MIN_CHARS, MIN_COUNT = 5, 3
#: One run of so many loses a code point.
DAMAGED = 97
#: A form has so many times the word's occurrences.
RATIO = 2
#: Words up to so many code points are posted as text.
LONG = 64
#: Keys of a radix bucket, about.
BUCKET_KEYS = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHECKS = ((2_147_483_647, 911_382_323), (2_147_483_629, 972_663_749))  # primes below 2^31, bases
_KEYS = "key long, check long, place int, word_no long, n long, word string"
_NEAR = "word_no long, n_near long, best_n long, best_no long"


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): damaged runs and others, of at least ``MIN_CHARS`` code points and ``MIN_COUNT`` occurrences."""
    # A run that is too short as it stands is too short damaged.
    found = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(f"[{LETTERS}]{{{MIN_CHARS},}}+"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))
    runs = runs.select("id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % DAMAGED == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= MIN_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _rest_hashes(codes: np.ndarray, base: np.ndarray, prime: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes, for words of one length (a row of code points each), of the rests without each place, and
    of the whole words; modulo 2^64 or ``prime``."""
    cut = (lambda x: x) if prime is None else (lambda x: x % prime)
    m, length = codes.shape
    before, after = np.zeros((m, length + 1), np.uint64), np.zeros((m, length + 1), np.uint64)
    power = np.ones(length + 1, np.uint64)
    for i in range(length):
        before[:, i + 1] = cut(before[:, i] * base + codes[:, i])
        power[i + 1] = cut(power[i : i + 1] * base)[0]
    for i in range(length - 1, -1, -1):
        after[:, i] = cut(codes[:, i] * power[length - 1 - i] + after[:, i + 1])
    return cut(before[:, :-1] * power[length - 1 :: -1][:length] + after[:, 1:]), before[:, -1]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads what tells hashes apart over all bits, the leading ones too."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length: keys and checks of their rests, place by place, and in the last column of themselves."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1).astype(np.uint64)
    rests, whole = _rest_hashes(codes, _BASE, None)
    keys = _mixed(np.column_stack([rests, whole]))
    check = np.zeros(keys.shape, np.uint64)
    if codes.shape[1] > LONG - 1:  # a word of LONG may be the rest of a longer one
        for prime, base in _CHECKS:
            rests, whole = _rest_hashes(codes, np.uint64(base), np.uint64(prime))
            check = (check << np.uint64(31)) | np.column_stack([rests, whole])
    return keys.view(np.int64), check.view(np.int64)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("place", pa.int32()), ("word_no", pa.int64()), ("n", pa.int64()), ("word", pa.string())])
    for batch in batches:
        df = batch.to_pandas()
        for length, own in df.groupby(df["word"].str.len()):
            step = max(1, (1 << 16) // (length + 1))
            for i in range(0, len(own), step):
                part = own.iloc[i : i + step]
                keys, check = deletion_keys(part["word"].tolist())
                each = lambda c: np.repeat(part[c].to_numpy(), length + 1)  # noqa: E731, B023
                text = pa.array(each("word"), pa.string()) if length <= LONG else pa.nulls(keys.size, pa.string())
                place = np.tile(np.append(np.arange(length, dtype=np.int32), np.int32(-1)), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(check.ravel()), pa.array(place), pa.array(each("word_no")), pa.array(each("n")), text], schema=schema)


def _rests(rows: pd.DataFrame, long_rest: np.ndarray) -> list:
    """What each row's key stands for: the rest itself, or for long ones both hashes."""
    each = zip(*(rows[c].tolist() for c in ("word", "place", "key", "check")), long_rest.tolist(), strict=True)
    return [(k, c) if big else (w if p < 0 else w[:p] + w[p + 1 :]) for w, p, k, c, big in each]


def near_in_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """For each word of a radix bucket the number of its neighbours met there, and the best of them."""
    empty = pd.DataFrame({"word_no": [], "n_near": [], "best_n": [], "best_no": []}, dtype=np.int64)
    key = rows["key"].to_numpy()
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    meets = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    rows = rows.take(order[meets])
    if rows.empty:
        return empty
    place, n, no = rows["place"].to_numpy(), rows["n"].to_numpy(), rows["word_no"].to_numpy()
    # A rest is long if the words it comes from may be posted without their text.
    size = rows["word"].str.len().fillna(LONG + 1).to_numpy() - (place >= 0)
    rest = pd.factorize(pd.Series(_rests(rows, size >= LONG), dtype=object))[0]

    # Words that lost the same place: each has all others as neighbours, the best of them but for the best itself,
    # which has the second.
    found: list[np.ndarray] = []
    order = np.lexsort((no, -n, place, rest))
    r, p, k, m = rest[order], place[order], no[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])]))
    members = np.diff(np.append(first, len(r)))
    of = np.repeat(np.arange(len(first)), members)
    lost = (p >= 0) & (members[of] > 1)
    best = np.where(np.arange(len(r)) == first[of], np.minimum(first[of] + 1, len(r) - 1), first[of])
    found.append(np.stack([k, members[of] - 1, m[best], k[best]])[:, lost])

    # A word that is a rest, and the words it is left of; one that repeats a letter loses either, and counts once.
    order = np.lexsort((no, -n, rest))
    order = order[place[order] >= 0]
    pairs = pd.DataFrame({"rest": rest[order], "no": no[order], "n": n[order]}).drop_duplicates(["rest", "no"])
    whole = pd.DataFrame({"rest": rest[place < 0], "own": no[place < 0], "own_n": n[place < 0]})
    met = pairs.merge(whole, on="rest")
    if len(met):
        found.append(np.stack([met["no"], np.ones(len(met), np.int64), met["own_n"], met["own"]]))
        found.append(np.stack([met["own"], np.ones(len(met), np.int64), met["n"], met["no"]]))
    word_no, count, best_n, best_no = np.concatenate(found, axis=1)
    order = np.lexsort((best_no, -best_n, word_no))
    word_no, count, best_n, best_no = word_no[order], count[order], best_n[order], best_no[order]
    if not len(word_no):
        return empty
    first = np.flatnonzero(np.concatenate([[True], word_no[1:] != word_no[:-1]]))
    return pd.DataFrame({"word_no": word_no[first], "n_near": np.add.reduceat(count, first), "best_n": best_n[first], "best_no": best_no[first]})


def neighbours(words: DataFrame) -> DataFrame:
    """(word_no, n_near, best_n, best_no) of the words that have neighbours, of ``words`` (word_no, word, n)."""
    bound_batches(words.sparkSession)
    n_keys = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    bits = max(0, (n_keys // BUCKET_KEYS).bit_length())
    keys = words.select("word_no", "word", "n").mapInArrow(giving_back(_post), _KEYS)
    bucket = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    near = keys.groupBy(bucket.alias("bucket")).applyInPandas(near_in_bucket, _NEAR)
    best = F.struct(-F.col("best_n"), F.col("best_no"))
    return near.groupBy("word_no").agg(F.sum("n_near").alias("n_near"), F.min(best).alias("b")).select("word_no", "n_near", (-F.col("b.col1")).alias("best_n"), F.col("b.best_no").alias("best_no"))


def roots(links: DataFrame) -> DataFrame:
    """(word_no, root_no) for ``links`` (word_no, form_no), written: the end of the chain of forms.

    Each round follows what the round before has found, so rounds grow as the logarithm of a chain's length.
    """
    ways = links.select("word_no", F.col("form_no").alias("root_no"))
    while True:
        on = ways.select(F.col("word_no").alias("root_no"), F.col("root_no").alias("further"))
        ways = materialize(ways.join(on, "root_no", "left").select("word_no", F.coalesce("further", "root_no").alias("root_no"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        if ways.where("moved").isEmpty():
            return ways.drop("moved")
        ways = ways.drop("moved")


def variants(counts: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of ``counts`` (word, n)."""
    counts = materialize(counts, "spelling-counts")
    words = sorted_runs(counts, "word", label="spelling-words").withColumnRenamed("at", "word_no")
    near = materialize(neighbours(words), "spelling-near")
    linked = words.select("word_no", "n").join(near, "word_no").where(F.col("best_n") >= RATIO * F.col("n")).select("word_no", F.col("best_no").alias("form_no"), F.col("best_n").alias("form_n"))
    linked = materialize(linked, "spelling-links")
    ends = roots(linked)
    named = lambda c: words.select(F.col("word_no").alias(f"{c}_no"), F.col("word").alias(c))
    out = linked.join(ends, "word_no").join(named("form"), "form_no").join(named("root"), "root_no")
    out = words.join(near.select("word_no", "n_near"), "word_no", "left").join(out, "word_no", "left")
    edit = F.levenshtein("word", "form", 1) == 1
    form = F.when(F.length("word") <= LONG - 1, F.col("form")).when(F.col("form").isNotNull() & ~edit, F.raise_error(F.lit("two rests with equal hashes"))).otherwise(F.col("form"))
    return out.select("word", form.alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def variant_report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of ``docs``."""
    with scratch(docs.sparkSession):
        return materialize(variants(count_words(docs)), "spelling-variants", keep=True)
