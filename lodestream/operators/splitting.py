"""Structure-aware splitting of records into chunks.

Splitting one record is a chain of folds in which each step depends on what the last one put out, so
it runs in an Arrow batch function, record by record; what concerns the batch (duplicates, numbering)
is done by the engine. Records with fewer than ``min_sentences`` sentences in an over-long section are
cut at separators, others at semantic breaks if an embedder is given.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.functions.text import SPLIT_ITEM, context_header, document_title, strip
from lodestream.operators.dedup import dedup_documents, number_chunks
from lodestream.operators.vectors import unit_rows
from lodestream.storage import materialize

Embedder = Callable[[list[str]], np.ndarray]

#: Separators of the recursive split, best first, and records that stay whole.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", ". ", "! ", "? ", "，", ",", " ", "")
WHOLE_RECORDS = ("qa_pair", "json_item", "json_document")
CLOSED = "。！？!?；;：:…」》】’”"
_HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*$")
_PAGE = re.compile(r"^\[\[PAGE=(\d+)\]\]\s*$")
_ITEM = re.compile(SPLIT_ITEM)
_SENTENCE = re.compile(r"(?<=[。！？!?；;])\s*")
MARK = "◆ "


@dataclass(frozen=True)
class SplitConfig:
    chunk_size: int = 500
    overlap: int = 80
    max_chunk_size: int = 700
    min_chunk_chars: int = 15
    add_header: bool = True
    min_sentences: int = 6
    percentile: float = 88.0

    def __post_init__(self) -> None:
        if self.chunk_size <= self.overlap:
            raise ValueError("chunk_size must exceed overlap")


@dataclass
class Section:
    path: list[str] = field(default_factory=list)
    content: str = ""
    page: int | None = None
    is_group: bool = False

    @property
    def parent(self) -> list[str]:
        return self.path if self.is_group else self.path[:-1]

    def titled(self) -> str:
        """The content under its own title."""
        return "\n".join(x for x in (MARK + self.path[-1] if self.path else "", self.content) if x)


def parse_sections(text: str) -> list[Section]:
    """Sections by Markdown headings; a sentence cut by a page marker is joined again."""
    here, out, titles, page, cut = Section(), [], {}, None, False
    out.append(here)
    for line in text.split("\n"):
        if m := _PAGE.match(line):
            page, so_far = int(m[1]), here.content.rstrip()
            cut = so_far != "" and so_far[-1] not in CLOSED
        elif m := _HEADING.match(line):
            level = len(m[1])
            titles = {k: v for k, v in titles.items() if k < level} | {level: m[2].strip()}
            here = Section([titles[k] for k in sorted(titles) if titles[k]], page=page)
            out.append(here)
            cut = False
        else:
            if here.page is None:
                here.page = page
            bare = line.strip()
            if not bare:
                if here.content and not here.content.endswith("\n\n"):
                    here.content += "\n"
            elif cut and here.content.strip() and not _ITEM.match(line) and not bare.startswith("|"):
                here.content = here.content.rstrip("\n") + bare + "\n"
            else:
                here.content += line.rstrip() + "\n"
            cut = False
    for s in out:
        s.content = s.content.strip()
    return [s for s in out if s.content or s.path]


def merge_sections(sections: Sequence[Section], chunk_size: int) -> list[Section]:
    """Neighbours under one parent are put together while they fit; titles go on in the text."""
    out: list[Section] = []
    for s in sections:
        last, more = out[-1] if out else None, s.titled()
        fits = last is not None and len(last.content) < chunk_size and len(last.content) + len(more) + 1 <= chunk_size
        if last is None or not fits or last.parent != s.path[:-1]:
            out.append(Section(list(s.path), s.content, s.page))
            continue
        if not last.is_group:
            last.content, last.path, last.is_group = last.titled().strip(), s.path[:-1], True
        last.content = f"{last.content}\n{more}".strip()
        last.page = s.page if last.page is None else last.page
    return out


def split_sentences(text: str) -> list[str]:
    out: list[str] = []
    for line in filter(None, map(str.strip, text.split("\n"))):
        whole = _ITEM.match(line) or line.startswith(("|", MARK[0]))
        out += [line] if whole else [p for p in map(str.strip, _SENTENCE.split(line)) if p] or [line]
    return out


def breakpoints(vectors: np.ndarray, percentile: float) -> set[int]:
    """Places after which neighbours are at least as far apart as the percentile of such distances."""
    rows = unit_rows(np.asarray(vectors, dtype=np.float64))
    gaps = 1.0 - np.einsum("ij,ij->i", rows[1:], rows[:-1])
    limit = np.quantile(gaps, percentile / 100) if gaps.size else 0.0
    return {i for i, gap in enumerate(gaps) if gap >= limit}


def group_sentences(sentences: Sequence[str], breaks: set[int], chunk_size: int, max_chunk_size: int) -> list[str]:
    groups: list[list[str]] = [[]]
    for i, s in enumerate(sentences):
        if groups[-1] and len("\n".join(groups[-1])) + 1 + len(s) > max_chunk_size:
            groups.append([])
        groups[-1].append(s)
        if i in breaks and len("\n".join(groups[-1])) >= chunk_size // 2:
            groups.append([])
    out: list[str] = []
    for text in ("\n".join(g) for g in groups if g):
        if out and len(out[-1]) + len(text) + 1 <= chunk_size:
            out[-1] += "\n" + text
        else:
            out.append(text)
    return out


def recursive_split(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` where separators allow; a separator opens the piece after it, and
    neighbours share up to ``overlap`` characters of whole pieces."""
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[at], separators[at + 1 :]
    pieces = list(text) if sep == "" else [p for p in re.split(f"(?={re.escape(sep)})", text) if p]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in pieces:
        if len(p) > size and finer:
            flush()
            held = []
            out += recursive_split(p, size, overlap, finer)
            continue
        if held and sum(map(len, held)) + len(p) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held = held[1:]
        held.append(p)
    flush()
    return out


def split_record(text: str, record_type: str | None, config: SplitConfig, embed: Embedder | None = None) -> list[tuple[str, list[str], int | None, str, bool]]:
    """(body, section path, page, method, stays whole) of a record's candidate chunks."""
    if record_type in WHOLE_RECORDS:
        body = text.strip()
        if len(body) <= config.max_chunk_size:
            return [(body, [], None, "atomic", True)]
        return [(p, [], None, "recursive", False) for p in recursive_split(body, config.chunk_size, config.overlap)]
    out: list[tuple[str, list[str], int | None, str, bool]] = []
    for s in merge_sections(parse_sections(text), config.chunk_size):
        if not s.content:
            continue
        parts, method = [s.content], "structure"
        if len(s.content) > config.max_chunk_size:
            sentences = split_sentences(s.content)
            if embed is not None and len(sentences) >= config.min_sentences:
                breaks = breakpoints(embed(sentences), config.percentile)
                parts, method = group_sentences(sentences, breaks, config.chunk_size, config.max_chunk_size), "semantic"
            else:
                parts, method = recursive_split(s.content, config.chunk_size, config.overlap), "recursive"
        out += [(p.strip(), s.path, s.page, method, False) for p in parts if p.strip()]
    return out


def candidates(records: DataFrame, config: SplitConfig, embed: Embedder | None = None) -> DataFrame:
    """``records`` (text, record_type, ...), a row for each candidate chunk in place of the text: pos, body, path, own_page,
    split_method, atomic. The other columns go along, so nothing is joined back."""
    carried = [c for c in records.columns if c != "text"]
    names = ["pos", "body", "path", "own_page", "split_method", "atomic"]
    types = [pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, rows = [], []
            for i, (t, k) in enumerate(zip(batch.column("text").to_pylist(), batch.column("record_type").to_pylist(), strict=True)):
                parts = split_record(t, k, config, embed)
                row += [i] * len(parts)
                rows += [(pos, *c) for pos, c in enumerate(parts)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            kept = batch.select(carried).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*carried, *names])

    added = StructType.fromDDL("pos int, body string, path array<string>, own_page int, split_method string, atomic boolean")
    schema = StructType([*(records.schema[c] for c in carried), *added.fields])
    return records.withColumn("text", F.coalesce("text", F.lit(""))).select(*carried, "text").mapInArrow(run, schema)


def split_records(records: DataFrame, config: SplitConfig | None = None, embed: Embedder | None = None) -> DataFrame:
    """Chunks of a batch of records (doc_id, source, text, and record_type, tag, page, doc_hash if there).

    Records with the text of an earlier one are left out, as are chunks; see ``number_chunks``. Each record is a
    document of its own, whatever its doc_id: null, or that of another record.
    """
    config = config or SplitConfig()
    for c, t in (("record_type", "string"), ("tag", "string"), ("page", "int"), ("doc_hash", "string")):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast(t))
    columns = ["doc_id", "source", "text", "record_type", "tag", "page", "doc_hash"]
    # Written once: numbers of rows in files stay what they are, whoever reads them again.
    kept = materialize(dedup_documents(records.select(*columns)), "split-records").withColumn("record", F.monotonically_increasing_id())
    head = context_header(document_title(F.col("source")), F.col("path")) if config.add_header else F.lit("")
    parts = candidates(kept, config, embed)
    header = F.when(F.coalesce(F.col("record_type").isin(*WHOLE_RECORDS), F.lit(False)), "").otherwise(head)
    texts = parts.withColumn("text", F.when(header == "", F.col("body")).otherwise(F.concat_ws("\n", header, F.col("body"))))
    chunks = number_chunks(texts.where(strip(F.col("text")) != ""), config.min_chunk_chars, "record")
    return chunks.select(
        "source", "tag", "doc_id", "chunk_id", F.coalesce("own_page", "page").alias("page"), "doc_hash", "record_type", "split_method",
        F.when(F.size("path") > 0, F.array_join("path", " > ")).alias("section_path"), "text",
    )
