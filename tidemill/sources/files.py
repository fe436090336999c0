"""Uploads: collect files, admit by type and size, parse to text, keep what was rejected and why."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from urllib.parse import urlparse
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Limits
from ..errors import ValidationError
from ..functions.identity import document_id, document_sha256
from .pdf import pages_of

# The media types that are parsed.
PDF, PLAIN, MARKDOWN = "application/pdf", "text/plain", "text/markdown"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PARSED = "doc_id string, uri string, mime_type string, text string, title string, page_offsets array<struct<start: int, end: int>>, error string"


def collect(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Files under a path: uri, length, content, doc_id and sha256 of the raw bytes, sorted by uri."""
    scheme = urlparse(path).scheme
    if scheme not in ("", "file", "hdfs", "s3a", "abfss", "gs", "viewfs"):
        raise ValidationError(f"cannot read {scheme} addresses")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.col("path").alias("uri"), "length", "content", document_id(F.col("content")).alias("doc_id"), document_sha256(F.col("content")).alias("sha256")).orderBy("uri")


def sniffed(files: DataFrame) -> DataFrame:
    """The media type by content; only text is told apart by its name."""
    head = F.hex(F.substring("content", 1, 4))
    text = F.is_valid_utf8(F.col("content").cast("string"))
    mime = F.when(head == "25504446", PDF).when((head == "504B0304") & F.contains(F.col("content").cast("string"), F.lit("word/")), DOCX)
    return files.withColumn("mime_type", mime.when(text & F.lower("uri").rlike(r"\.(md|markdown)$"), MARKDOWN).when(text, PLAIN).otherwise("application/octet-stream"))


def admitted(files: DataFrame, limits: Limits | None = None) -> tuple[DataFrame, DataFrame]:
    """(files of allowed type and size, the others with a reason)."""
    limits = limits or Limits()
    typed = sniffed(files)
    reason = F.when(~F.col("mime_type").isin(*limits.allowed_mime), "UNSUPPORTED_TYPE").when(F.col("length") > limits.max_upload_mb * 1024 * 1024, "TOO_LARGE")
    typed = typed.withColumn("reason", reason)
    return typed.filter("reason is null").drop("reason"), typed.filter("reason is not null").drop("content")


def docx_text(content: bytes) -> tuple[str, str | None]:
    """Paragraphs of a Word file, blank lines between, and its title."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        title = None
        if "docProps/core.xml" in z.namelist():
            title = ElementTree.fromstring(z.read("docProps/core.xml")).findtext("{http://purl.org/dc/elements/1.1/}title")
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in body.iter(f"{space}p"))
    return "\n\n".join(p for p in paragraphs if p), title or None


def joined_pages(pages: list[str]) -> tuple[str, list[dict]]:
    """Pages with blank lines between, and where each lies."""
    at, offsets = 0, []
    for page in pages:
        offsets.append({"start": at, "end": at + len(page)})
        at += len(page) + 2
    return "\n\n".join(pages), offsets


def _parse_one(content: bytes, mime: str) -> dict:
    out = {"text": None, "title": None, "page_offsets": [], "error": None}
    try:
        if mime == PDF:
            pages, out["title"] = pages_of(content)
            out["text"], out["page_offsets"] = joined_pages(pages)
        elif mime == DOCX:
            out["text"], out["title"] = docx_text(content)
        elif mime in (PLAIN, MARKDOWN):
            out["text"] = content.decode("utf-8")
        else:
            out["error"] = "UNSUPPORTED_TYPE"
        if out["text"] is not None and not out["text"].strip():
            out |= {"text": None, "error": "EMPTY_TEXT"}
    except Exception as e:  # a file that cannot be parsed is a row of the error table
        out |= {"text": None, "error": f"PARSE_ERROR: {type(e).__name__}"}
    return out


def parse(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(parsed documents, errors).  Texts never pass through Python; only binary formats do."""
    plain = F.col("mime_type").isin(PLAIN, MARKDOWN)
    none = F.lit(None).cast("string")
    pages = F.array().cast("array<struct<start: int, end: int>>")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.col("content").cast("string"))
    error = F.when(~valid, "PARSE_ERROR: UnicodeDecodeError").when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", "EMPTY_TEXT")
    native = files.filter(plain).select("doc_id", "uri", "mime_type", F.when(error.isNull(), text).alias("text"), none.alias("title"), pages.alias("page_offsets"), error.alias("error"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = pd.DataFrame([_parse_one(c, m) for c, m in zip(part["content"], part["mime_type"], strict=True)], columns=["text", "title", "page_offsets", "error"])
            yield pd.concat([part[["doc_id", "uri", "mime_type"]].reset_index(drop=True), got], axis=1)

    other = files.filter(~plain).select("doc_id", "uri", "mime_type", "content").mapInPandas(run, PARSED)
    both = native.unionByName(other)
    return both.filter("error is null").drop("error"), both.filter("error is not null").select("doc_id", "uri", "mime_type", "error")


def persist_upload(content: bytes, doc_id: str, folder: str) -> str:
    """Keep an upload's bytes under its id; the same id always holds the same bytes."""
    from pathlib import Path

    path = Path(folder) / doc_id
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path.as_uri()
