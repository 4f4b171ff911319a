"""Mixed-format files to records, a failing file kept apart from the others.

Files are read by Spark, so any file system it knows will do; parsing works on their bytes.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.functions.text import clean_text, first_directory, is_markdown, promote_headings, strip, strip_intent_suffix, unwrap_lines
from lodestream.operators.pages import joined_pages, strip_page_lines
from lodestream.operators.store import changed_files

SUFFIXES = ("txt", "md", "pdf", "docx", "csv", "json")
#: Labels of a question-and-answer record's lines.
QA_LABELS = (("system", "系统："), ("instruction", "问题："), ("input", "补充信息："), ("output", "答案："))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(source, relpath, suffix, tag, size, mtime, doc_hash, content) of the supported files below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = re.sub(r"^[a-z]+:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.sub(r"([.+*?^$(){}|\[\]\\])", r"\\\1", base) + "/", "")
    files = raw.withColumn("relpath", rel).withColumn("suffix", F.lower(F.regexp_extract("relpath", r"\.([^./]+)$", 1)))
    return files.where(F.col("suffix").isin(*SUFFIXES)).select(
        F.col("relpath").alias("source"), "relpath", "suffix", first_directory(F.col("relpath")).alias("tag"),
        F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("doc_hash"), "content",
    )


def decode(data: bytes) -> str:
    """UTF-8 if it is that, else by its byte-order mark, else the usual Chinese and Western encodings."""
    for encoding in ("utf-8-sig", "utf-16" if data[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8", "gb18030", "latin-1"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", errors="replace")


def json_items(data: bytes) -> Iterator[dict]:
    """Records of a JSON file: one for each item of an array, else one for the whole."""
    payload = json.loads(data.decode("utf-8"))
    if not isinstance(payload, list):
        yield {"record_type": "json_document", "page": 0, "text": json.dumps(payload, ensure_ascii=False, indent=2)}
        return
    for i, item in enumerate(payload):
        fields = {k: str(item.get(k, "")) for k, _ in QA_LABELS} if isinstance(item, dict) else {}
        yield {"record_type": "json_item", "page": i, "text": json.dumps(item, ensure_ascii=False), **fields}


def csv_rows(data: bytes) -> Iterator[dict]:
    for row in csv.DictReader(io.StringIO(decode(data), newline="")):
        yield {"record_type": "csv_row", "text": "\n".join(f"{k}: {v or ''}" for k, v in row.items() if k is not None)}


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> Iterator[tuple[str, object]]:
    """Paragraphs ("text", string) with heading marks, and tables ("table", rows), in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    said = lambda e: "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" for t in e.iter() if t.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            text, style = said(child).strip(), child.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            level = re.search(r"(?i)(?:heading|标题)\s*(\d)", names.get(key, key))
            yield "text", f"{'#' * min(int(level[1]), 6)} {text}\n" if level and text else text
        elif child.tag == f"{_W}tbl":
            yield "table", [["\n".join(said(p) for p in c.iter(f"{_W}p")) for c in r.findall(f"{_W}tc")] for r in child.findall(f"{_W}tr")]


def table_markdown(rows: list[list[str]]) -> str:
    clean = [[" ".join((c or "").split()) for c in r] for r in rows]
    clean = [r for r in clean if any(r)]
    width = max(map(len, clean), default=0)
    padded = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in clean]
    return "\n".join([padded[0], "|" + "---|" * width, *padded[1:]]) if padded else ""


def docx_text(data: bytes) -> str:
    return "\n".join(x if kind == "text" else f"\n{table_markdown(x)}\n" for kind, x in docx_blocks(data))


def pdf_pages(data: bytes) -> list[str]:
    """Texts of the pages, tables as Markdown where the richer parser is installed."""
    try:
        import pdfplumber
    except ImportError:
        from pypdf import PdfReader

        return [p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages]
    out = []
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for page in pdf.pages:
            tables = page.find_tables()
            body = page
            for t in tables:
                body = body.outside_bbox(t.bbox)
            out.append("\n".join([body.extract_text() or "", *(table_markdown(t.extract()) for t in tables)]).strip())
    return out


RAW = "source string, tag string, doc_hash string, suffix string, record_type string, page int, total_pages int, text string, system string, instruction string, input string, output string, error string"
_NAMES = [f.split()[0] for f in RAW.split(", ")]


def parse_file(suffix: str, data: bytes) -> Iterator[dict]:
    """Records of one file, as parsed; cleaning is done by the engine."""
    if suffix == "json":
        yield from json_items(data)
    elif suffix == "csv":
        yield from csv_rows(data)
    elif suffix == "docx":
        yield {"record_type": "docx_document", "page": 0, "text": docx_text(data)}
    elif suffix == "pdf":
        pages = pdf_pages(data)
        for i, text in enumerate(pages, 1):
            yield {"record_type": "pdf_page", "page": i, "total_pages": len(pages), "text": text}
    else:
        yield {"text": decode(data)}


def parse_files(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for f in batch.to_pylist():
                own = {k: f[k] for k in ("source", "tag", "doc_hash", "suffix")}
                try:
                    rows += [own | r for r in parse_file(f["suffix"], f["content"])]
                except Exception as e:  # one file's failure is its own
                    rows.append(own | {"error": f"{type(e).__name__}: {e}"})
            types = [pa.int32() if n in ("page", "total_pages") else pa.string() for n in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, types, strict=True)], _NAMES)

    return files.select("source", "tag", "doc_hash", "suffix", "content").mapInArrow(run, RAW)


def qa_text(df: DataFrame) -> DataFrame:
    """Question-and-answer lines for items with an instruction or an output."""
    part = {k: clean_text(strip(F.coalesce(F.col(k), F.lit("")))) for k, _ in QA_LABELS}
    part["output"] = strip_intent_suffix(part["output"])
    lines = F.concat_ws("\n", *[F.when(part[k] != "", F.concat(F.lit(label), part[k])) for k, label in QA_LABELS])
    is_qa = (F.col("suffix") == "json") & ((part["instruction"] != "") | (part["output"] != ""))
    return df.withColumn("record_type", F.when(is_qa, "qa_pair").otherwise(F.col("record_type"))).withColumn("text", F.when(is_qa, strip(lines)).otherwise(clean_text(F.col("text"))))


def load_records(spark: SparkSession, root: str, registry: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of the files below ``root`` that the registry does not hold unchanged."""
    files = scan_files(spark, root)
    if registry is not None:
        files = changed_files(files, registry)
    parsed = parse_files(files)
    good = parsed.where("error is null")
    pages = good.where(F.col("suffix") == "pdf")
    books = joined_pages(strip_page_lines(pages.select(F.col("source").alias("doc_id"), "page", "text")))
    pdf = books.select(F.col("doc_id").alias("source"), promote_headings(unwrap_lines(clean_text(F.col("text")))).alias("text")).join(
        pages.groupBy("source").agg(F.first("tag").alias("tag"), F.first("doc_hash").alias("doc_hash"), F.max("total_pages").alias("total_pages")), "source"
    )
    pdf = pdf.withColumns({"record_type": F.lit("pdf_document"), "page": F.lit(1), "qa_index": F.lit(None).cast("int")})
    rest = qa_text(good.where(F.col("suffix") != "pdf")).where("text <> ''")
    prose = F.col("suffix").isin("txt", "md", "docx") & ~is_markdown(F.col("text"))
    rest = rest.withColumn("text", F.when(prose, promote_headings(F.col("text"))).otherwise(F.col("text")))
    rest = rest.withColumn("qa_index", F.when(F.col("record_type") == "qa_pair", F.col("page")))
    columns = ["source", "tag", "doc_hash", "record_type", "page", "total_pages", "qa_index", "text"]
    return rest.select(columns).unionByName(pdf.where("text <> ''").select(columns)), parsed.where("error is not null").select("source", "error")


def load_stats(files: DataFrame, registry: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: files seen, skipped as unchanged, failed."""
    counts = files.agg(F.count("*").alias("seen")).crossJoin(changed_files(files, registry).agg(F.count("*").alias("changed")))  # one row each
    return counts.crossJoin(failures.agg(F.countDistinct("source").alias("failed"))).select("seen", (F.col("seen") - F.col("changed")).alias("skipped"), "failed")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(source, doc_hash) of a JSON object; blank entries and unreadable files count as nothing."""
    from lodestream.functions.text import source_key

    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("source", "doc_hash"))
    return rows.where("source <> '' and doc_hash <> ''").select(source_key(F.col("source")).alias("source"), "doc_hash")


def latest_file(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", "mtime").alias("path"))

