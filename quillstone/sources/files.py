"""Documents and question sets from files, and the table of chunks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import chunking as K
from quillstone.sources import pdf

#: What can be uploaded, and the largest file.
SUFFIXES = (".pdf", ".docx", ".txt", ".md", ".text")
MOST_BYTES = 50 << 20
_PAGES = pa.schema([("path", pa.string()), ("pages", pa.list_(pa.struct([("number", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])
PAGES_SCHEMA = "path string, pages array<struct<number:int,text:string>>, error string"
_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def acceptable(path: Column, length: Column, most_bytes: int = MOST_BYTES) -> Column:
    """Whether an upload has a known suffix and a size that is allowed; an empty one hasn't."""
    return F.rlike(F.lower(path), F.lit("(" + "|".join(re.escape(s) for s in SUFFIXES) + ")$")) & (length > 0) & (length <= most_bytes)


def _docx(data: bytes) -> list[tuple[int, str]]:
    """Paragraphs of the body as one page; tables aren't read."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_PARAGRAPH}body")
    paragraphs = ["".join(x.text or "" if x.tag == f"{_PARAGRAPH}t" else "\t" if x.tag == f"{_PARAGRAPH}tab" else "\n" if x.tag == f"{_PARAGRAPH}br" else "" for x in p.iter()) for p in (body if body is not None else []) if p.tag == f"{_PARAGRAPH}p"]
    return [(1, "\n".join(paragraphs))]


def _pdf(data: bytes) -> list[tuple[int, str]]:
    """Pages by PyMuPDF where it is installed, else by the reader of plain files."""
    try:
        import fitz
    except ImportError:
        return pdf.pages_of(data)
    with fitz.open(stream=data, filetype="pdf") as doc:
        return [(n, page.get_text("text")) for n, page in enumerate(doc, 1)]


def pages_of(path: str, data: bytes) -> list[tuple[int, str]]:
    """Pages of a file by its suffix; text is UTF-8, and bytes that aren't are dropped."""
    suffix = "." + path.lower().rpartition(".")[2]
    if suffix == ".pdf":
        return _pdf(data)
    if suffix == ".docx":
        return _docx(data)
    if suffix in (".txt", ".md", ".text"):
        return [(1, data.decode("utf-8", "ignore"))]
    raise ValueError(f"unsupported file type: {suffix}")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for data in batches:
        paths, pages, errors = data.column("path").to_pylist(), [], []
        for path, content in zip(paths, data.column("content").to_pylist(), strict=True):
            try:
                pages.append([{"number": n, "text": t} for n, t in pages_of(path, content)])
                errors.append(None)
            except Exception as e:  # a broken file is a row with an error, not a failed job
                pages.append(None)
                errors.append(str(e)[:300])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((paths, pages, errors), _PAGES, strict=True)], schema=_PAGES)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, pages, error of all files below a path: repaired text, blank pages dropped; a file without text has an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    found = files.where(acceptable(F.col("path"), F.col("length"))).select("path", "content").mapInArrow(_extract, PAGES_SCHEMA)
    repaired = F.filter(F.transform("pages", lambda p: F.struct(p["number"].alias("number"), T.repair(p["text"]).alias("text"))), lambda p: ~T.is_blank(p["text"]))
    empty = F.col("pages").isNotNull() & (F.size(repaired) == 0)
    return found.select("path", repaired.alias("pages"), F.when(empty, "no extractable text").otherwise(F.col("error")).alias("error"))


def ingest(spark: SparkSession, path: str, strategy: str = "fixed", target: int = K.TARGET, overlap: int = K.OVERLAP, least: int = K.LEAST) -> tuple[DataFrame, DataFrame]:
    """The chunks of all files below a path (doc_id is a hash of its path), and (path, error) of those that give none."""
    pages = read_documents(spark, path)
    own = pages.where("error IS NULL").select(F.xxhash64("path").alias("doc_id"), "pages")
    return K.chunk(own, strategy, target, overlap, least), pages.where("error IS NOT NULL").select("path", "error")


def questions_from_lines(lines: DataFrame) -> DataFrame:
    """question, expected_answer, relevant_sections of a text file's lines (value); blank ones are dropped."""
    return lines.where(~T.is_blank(F.col("value"))).select(T.strip(F.col("value")).alias("question"), F.lit(None).cast("string").alias("expected_answer"), F.lit(None).cast("array<string>").alias("relevant_sections"))


def questions_from_csv(rows: DataFrame) -> DataFrame:
    """The same of a table with a header: sections are parted by |; a set without any is null."""
    column = lambda c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    sections = F.filter(F.transform(F.split(column("relevant_sections"), r"\|"), T.strip), lambda s: s != "")
    out = rows.select(T.strip(column("question")).alias("question"), F.nullif(T.strip(column("expected_answer")), F.lit("")).alias("expected_answer"), F.when(F.size(sections) > 0, sections).alias("relevant_sections"))
    return out.where(~T.is_blank(F.col("question")))


def questions_from_json(texts: DataFrame) -> DataFrame:
    """The same of JSON lists (value) of strings or objects; what has no question is dropped."""
    items = texts.select(F.explode(F.from_json("value", "array<string>")).alias("item"))
    fields = F.from_json("item", "question string, expected_answer string, relevant_sections array<string>")
    is_object = F.startswith(F.ltrim(F.col("item")), F.lit("{"))
    rows = items.select(F.when(is_object, fields["question"]).otherwise(F.col("item")).alias("question"), F.when(is_object, fields["expected_answer"]).alias("expected_answer"), F.when(is_object, fields["relevant_sections"]).alias("relevant_sections"))
    return rows.where(~T.is_blank(F.col("question")))


def sniff_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a .json file, of a table whose first line has a comma and "question", or of plain lines."""
    if path.lower().endswith(".json"):
        return questions_from_json(spark.read.text(path, wholetext=True))
    head = spark.read.text(path).first()
    first = (head["value"] if head else "").lower()
    if "," in first and "question" in first:
        return questions_from_csv(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    return questions_from_lines(spark.read.text(path))
