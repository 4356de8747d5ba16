"""Documents from files, tables or DataFrames; questions from YAML.

load_documents reads a file or a folder, all below it included: .txt and .md natively from bytes, .docx with the standard
library's ZIP and XML, .pdf where pymupdf4llm is installed. Result: doc_ord, doc_id, source_path, text, metadata, elements.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from io import BytesIO
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.shipping import ship
from ..operators.chunking import ELEMENTS, markdown_elements

SUFFIXES = (".docx", ".md", ".pdf", ".txt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(content: bytes) -> tuple[str, str]:
    """Text and the encoding that it was read with."""
    if content.startswith(b"\xef\xbb\xbf"):
        try:
            return content[3:].decode("utf-8"), "utf-8-bom"
        except UnicodeDecodeError:
            pass
    for encoding in ("utf-8", "cp1252"):
        try:
            return content.decode(encoding), encoding
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "replace"), "utf-8/replace"


def heading_level(text: str, bold: bool, style: str) -> tuple[int | None, bool]:
    """Level of a heading style, or one guessed from a short, wholly bold line that ends like no sentence; and if guessed."""
    if m := re.match(r"Heading\s*(\d)", style or "", re.IGNORECASE):
        return min(6, int(m[1])), False
    if bold and text.strip() and len(text.split()) <= 12 and text.rstrip()[-1] not in ".,;?!":
        return (2 if text.isupper() else 3), True
    return None, False


def read_docx(content: bytes) -> tuple[str, list[dict], int]:
    """Markdown text with headings and tables, its elements, and how many headings were guessed."""
    body = ElementTree.fromstring(zipfile.ZipFile(BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    out, elements, guessed, at = [], [], 0, 0
    for block in body:
        level, kind = None, "paragraph"
        if block.tag == f"{_W}p":
            runs = [("".join(t.text or "" for t in r.iter(f"{_W}t")), r.find(f"{_W}rPr/{_W}b") is not None) for r in block.iter(f"{_W}r")]
            text = "".join(t for t, _ in runs)
            if not text.strip():
                continue
            style = block.find(f"{_W}pPr/{_W}pStyle")
            level, guess = heading_level(text, all(b for t, b in runs if t.strip()), "" if style is None else style.get(f"{_W}val", ""))
            guessed += guess
            plain = text.strip()
            text = "#" * level + " " + plain if level else text
        elif block.tag == f"{_W}tbl":
            rows = [[" ".join("".join(t.text or "" for t in p.iter(f"{_W}t")) for p in cell.iter(f"{_W}p")).replace("\n", " ") for cell in row.iter(f"{_W}tc")] for row in block.iter(f"{_W}tr")]
            text, kind = "\n".join("| " + " | ".join(r) + " |" for r in rows), "table"
        else:
            continue
        elements.append({"type": "heading" if level else kind, "text": plain if level else text, "start": at, "end": at + len(text), "level": level})
        out.append(text + "\n\n")
        at += len(out[-1])
    return "".join(out), elements, guessed


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.path, batch.content):
            suffix, elements, meta = Path(path).suffix.lower(), None, {}
            try:
                if suffix == ".docx":
                    text, elements, guessed = read_docx(content)
                    meta["headings_inferred"] = str(guessed)
                elif suffix == ".pdf":
                    import pymupdf4llm  # optional

                    import pymupdf

                    text = pymupdf4llm.to_markdown(pymupdf.open(stream=content, filetype="pdf"))
                else:
                    text, meta["encoding"] = decode(content)
            except Exception as error:
                raise ValueError(f"{path} can't be read: {error}") from error
            rows.append((path, text, meta, elements))
        yield pd.DataFrame(rows, columns=["source_path", "text", "metadata", "found"])


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """Fails on a missing path, on none of the suffixes, on a file that can't be read, and on two files with one stem."""
    local = "://" not in path
    if local and not Path(path).exists():
        raise FileNotFoundError(path)
    if local and Path(path).is_file() and Path(path).suffix.lower() not in SUFFIXES:
        raise ValueError(f"{Path(path).suffix} isn't among {', '.join(SUFFIXES)}")
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    files = files.where(F.lower("path").rlike(r"\.(docx|md|pdf|txt)$"))
    names = files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"))
    twice = names.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several files are named {twice[0].doc_id}")
    if not names.limit(1).collect():
        raise ValueError(f"no documents in {path}; read are {', '.join(SUFFIXES)}")
    rows = files.mapInPandas(_parse, f"source_path string, text string, metadata map<string,string>, found {ELEMENTS}")
    marked = F.lower("source_path").rlike(r"\.(md|pdf)$")
    elements = F.when(marked, markdown_elements(F.col("text"))).otherwise(F.coalesce("found", F.array().cast(ELEMENTS)))
    # ordinals follow the order of paths: a window over names alone, then an equi-join
    order = names.select(F.col("path").alias("source_path"), (F.row_number().over(W.partitionBy().orderBy("path")) - 1).cast("long").alias("doc_ord"))
    return rows.join(order, "source_path").select("doc_ord", "source_path", "text", "metadata", elements.alias("elements"), F.regexp_extract("source_path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"))


def from_table(spark: SparkSession, path: str, fmt: str = "parquet", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents from any source that Spark reads."""
    return spark.read.format(fmt).load(path).select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


QUESTION = "q_ord long, question_id string, query string, gold_snippets array<string>, gold_answer string, tags array<string>, reviewed boolean"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    found = data.get("questions") if isinstance(data, dict) else None
    if not isinstance(found, list) or not found:
        raise ValueError(f"{path} needs a list of questions under `questions`")
    return questions_from(spark, found)


def questions_from(spark: SparkSession, found: list[dict]) -> DataFrame:
    rows = [(i, str(q["id"]), q["query"], q.get("gold_snippets") or [], q.get("gold_answer"), q.get("tags") or [], q.get("reviewed", True)) for i, q in enumerate(found)]
    return spark.createDataFrame(rows, QUESTION)
