"""Files as documents.

Bytes are read by Spark's binaryFile source. Kinds are decided by Column
expressions; only decoding and containers go through Python, in Arrow batches,
where an error becomes a warning of its row. Archives are opened twice, so that
nested ones are read to the depth that is wanted, without a loop over data.
Files are numbered by ranges of their paths; contents are not shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..session import cut_lineage, ship
from . import containers, kinds

FILE = "source_id string, name string, mime_type string, content binary, given string"
PAGE = "array<struct<index:int,text:string,method:string>>"
#: Fixed values.
UPLOAD_BYTES, LEAST_PAGE, EMPTY_CONFIDENCE, UNKNOWN_CONFIDENCE = 40 << 20, 40, 0.15, 0.1


#: Files whose numbers are sent to all tasks; beyond, contents are joined with their numbers.
SENT_FILES = 100_000


def numbered(paths: DataFrame) -> DataFrame:
    """path, n: from 1, by path. Ranges are sorted where they lie; one row for each range is summed."""
    # Written, so that the numbers within a range stay as they are.
    ranged = cut_lineage(paths.repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id()))
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("held"))
    starts = sizes.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ranged.withColumn("part", part).join(F.broadcast(starts), "part").select("path", (F.col("start") + within + 1).alias("n"))


def read_input_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files, or the files of directories, one level deep; numbered by path. Spark's file sources leave out files of no bytes."""
    raw = spark.read.format("binaryFile").load(paths)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    numbers = cut_lineage(numbered(raw.select("path")))
    numbers = F.broadcast(numbers) if numbers.limit(SENT_FILES + 1).count() <= SENT_FILES else numbers
    return raw.join(numbers, "path").select(F.concat(F.lit("src"), F.col("n").cast("string")).alias("source_id"), F.url_decode(F.regexp_replace(name, r"\+", "%2B")).alias("name"), F.lit(None).cast("string").alias("mime_type"), "content", F.lit(None).cast("string").alias("given"))


def within_upload_cap(files: DataFrame, order: str = "source_id", cap: int = UPLOAD_BYTES) -> DataFrame:
    """The files of an upload up to its cumulative size; ``files`` has upload_id."""
    used = F.sum(F.coalesce(F.length("content"), F.length("given"), F.lit(0))).over(Window.partitionBy("upload_id").orderBy(order))
    return files.withColumn("_used", used).where(F.col("_used") <= cap).drop("_used")


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source_id", "name", "mime_type", "content", "given", "warning"]
    for batch in batches:
        for r in batch.itertuples():  # an archive at a time
            plain = (r.source_id, r.name, r.mime_type, r.content, r.given)
            try:
                inner = [(f"{r.source_id}#{n}", f"{r.name}/{name}", None, data, None, None) for n, name, data in containers.inner_files(r.content)]
                if inner and containers.more_files(r.content):
                    inner[0] = (*inner[0][:5], f"only the first {containers.ENTRIES} entries of the archive were read")
                rows = inner or [(*plain, "nothing readable in the archive")]
            except Exception as e:  # a broken archive is a row with a warning
                rows = [(*plain, f"the archive can't be opened: {e}")]
            yield pd.DataFrame(rows, columns=columns)


def _zip_listing(contents: pd.Series) -> pd.Series:
    def names(content: bytes | None) -> list[str] | None:
        if content is None or bytes(content[:4]) != b"PK\x03\x04":
            return None
        try:
            return containers.zip_names(content)
        except Exception:
            return None

    return pd.Series([names(c) for c in contents], dtype="object")


def with_kind(files: DataFrame) -> DataFrame:
    """``files`` with kind, containers looked into."""
    listing = F.pandas_udf(_zip_listing, "array<string>")
    first = kinds.detect_kind(F.col("name"), F.col("mime_type"), F.col("content"))
    told = files.withColumn("_first", first).withColumn("_names", listing(F.when(F.col("_first") == "archive", F.col("content"))))
    kind = F.when(F.col("content").isNull() & F.col("given").isNotNull(), "text").when((F.col("_first") == "archive") & F.col("_names").isNotNull(), kinds.refine_zip(F.col("_names"))).otherwise(F.col("_first"))
    return told.withColumn("kind", kind).drop("_first", "_names")


def expand_archives(files: DataFrame, depth: int = containers.DEPTH) -> DataFrame:
    """``files`` (FILE) with archives replaced by their files, down to ``depth``; adds warning."""
    out = files.withColumn("warning", F.lit(None).cast("string"))
    for _ in range(depth):
        known = with_kind(out)
        is_archive = (F.col("kind") == "archive") & F.col("warning").isNull()
        # Only archives go through Python.
        opened = known.where(is_archive).select("source_id", "name", "mime_type", "content", "given").mapInPandas(_opened, FILE + ", warning string")
        out = known.where(~F.coalesce(is_archive, F.lit(False))).drop("kind").unionByName(opened)
    return out


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["source_id", "name", "mime_type", "kind", "bytes_length", "body", "parts", "notes", "encoding", "problem", "taken", "pixels"]
    for batch in batches:
        rows = []
        for r in batch.itertuples():
            body, parts, notes, encoding, problem = None, [], [], None, r.warning
            size = len(r.content) if r.content is not None else len(r.given or "")
            try:
                if r.content is None:
                    body = r.given
                elif r.kind in ("text", "code", "html", "email") or r.as_text:
                    body, encoding = containers.decode_text(r.content)
                    if r.kind == "html":
                        parts = [containers.html_document(body)]
                elif r.kind == "docx":
                    parts = containers.docx_parts(r.content)
                elif r.kind == "pptx":
                    parts, notes = map(list, zip(*containers.pptx_parts(r.content))) if containers.pptx_parts(r.content) else ([], [])
                elif r.kind == "xlsx":
                    parts = [containers.sheet_text(n, x) for n, x in containers.xlsx_sheets(r.content)]
                elif r.kind == "hwp":
                    parts = containers.hwpx_parts(r.content) if bytes(r.content[:1]) == b"P" else []
                elif r.kind == "pdf":
                    parts = containers.pdf_pages(r.content)
            except Exception as e:  # a broken file is a row with a warning
                problem = f"can't be read: {e}"
            rows.append((r.source_id, r.name, r.mime_type, r.kind, size, body, parts, notes, encoding, problem, r.taken, r.pixels))
        yield pd.DataFrame(rows, columns=columns)


PARTS = "source_id string, name string, mime_type string, kind string, bytes_length long, body string, parts array<string>, notes array<string>, encoding string, problem string, taken string, pixels string"


def ingest(files: DataFrame) -> DataFrame:
    """One document for each file: source_id, name, kind, mime_type, bytes_length, text, pages, metadata, warnings, confidence.

    A file that can't be read, an empty file, or one of a kind whose text takes
    a model or recogniser is a document with a warning and low confidence.
    """
    ship(files.sparkSession)
    known = with_kind(expand_archives(files)).withColumn("as_text", kinds.looks_like_text(F.col("content")) & (F.col("kind") == "unknown"))
    picture, size = F.col("kind") == "image", kinds.image_size(F.col("content"))
    seen = known.withColumns({"taken": F.when(picture, kinds.exif_date(F.col("content"))), "pixels": F.when(picture & size["width"].isNotNull(), F.concat_ws("x", size["width"], size["height"]))})
    raw = seen.select("source_id", "name", "mime_type", "content", "given", "kind", "as_text", "warning", "taken", "pixels").mapInPandas(_parts, PARTS)
    ext, body = kinds.extension(F.col("name")), F.col("body")
    mail = formats.email_parts(body)
    head = F.when(F.instr(body, "\n\n") > 0, F.substring_index(body, "\n\n", 1)).otherwise(F.lit(""))
    text = (
        F.when(F.col("kind") == "html", F.coalesce(F.get("parts", F.lit(0)), formats.html_to_text(body)))
        .when(F.col("kind") == "email", F.concat(head, F.lit("\n\n"), mail["body"]))
        .when(ext.isin("csv", "tsv"), formats.delimited_to_text(body, F.col("name")))
        .when(ext == "ipynb", formats.notebook_to_text(body))
        .when(ext.isin("srt", "vtt"), formats.subtitles_to_text(body))
        .when(ext == "rtf", formats.rtf_to_text(body))
        .otherwise(body)
    )
    slide = lambda x, i: F.concat(F.lit("[슬라이드 "), (i + 1).cast("string"), F.lit("]\n"), formats.ooxml_to_text(x), F.when(F.coalesce(F.get("notes", i), F.lit("")) != "", F.concat(F.lit("\n[발표자 노트]\n"), formats.ooxml_to_text(F.get("notes", i)))).otherwise(F.lit("")))
    texts = (
        F.when(body.isNotNull(), F.array(text))
        .when(F.col("kind") == "docx", F.transform("parts", lambda x: formats.ooxml_to_text(x)))
        .when(F.col("kind") == "pptx", F.transform("parts", slide))
        .when(F.col("kind") == "hwp", F.transform("parts", lambda x: formats.hwpx_to_text(x)))
        .otherwise(F.col("parts"))
    )
    unreadable = F.concat(F.lit("[읽을 수 없는 파일] "), F.col("name"), F.lit(" ("), F.format_number("bytes_length", 0), F.lit(" bytes)"))
    lost = (F.col("kind") == "unknown") & body.isNull()
    paged = raw.withColumn("_texts", F.when(lost, F.array(unreadable)).otherwise(texts)).withColumn("text", formats.join_pages(F.col("_texts")))
    needs_model = F.col("kind").isin("image", "audio", "video") | ((F.col("kind") == "pdf") & F.exists("_texts", lambda t: F.length(F.regexp_replace(t, r"\s", "")) < LEAST_PAGE))
    empty = F.length("text") == 0
    warnings = F.filter(F.array(F.col("problem"), F.when(F.col("bytes_length") == 0, F.lit("empty file")), F.when(needs_model, F.lit("needs a recogniser")), F.when(lost, F.lit("unknown format")), F.when(empty, F.lit("no text found"))), lambda w: w.isNotNull())
    confidence = F.when(F.col("bytes_length") == 0, 0.0).when(lost, UNKNOWN_CONFIDENCE).when(empty, EMPTY_CONFIDENCE).otherwise(1.0)
    pairs = F.filter(F.array(F.struct(F.lit("fileName").alias("k"), F.col("name").alias("v")), F.struct(F.lit("encoding").alias("k"), F.col("encoding").alias("v")), F.struct(F.lit("taken").alias("k"), F.col("taken").alias("v")), F.struct(F.lit("size").alias("k"), F.col("pixels").alias("v")), *[F.struct(F.lit(k).alias("k"), F.when(F.col("kind") == "email", mail[f]).alias("v")) for k, f in (("subject", "subject"), ("from", "sender"), ("to", "recipient"), ("date", "date"))]), lambda p: p["v"].isNotNull())
    return paged.select(
        "source_id", "name",
        F.when(lost & body.isNotNull(), "text").otherwise(F.col("kind")).alias("kind"),
        F.coalesce("mime_type", kinds.guess_mime(F.col("kind"), F.col("name"))).alias("mime_type"),
        "bytes_length", "text",
        F.transform("_texts", lambda t, i: F.struct((i + 1).cast("int").alias("index"), t.alias("text"), F.when(lost, "metadata").otherwise("native").alias("method"))).alias("pages"),
        F.map_from_entries(pairs).alias("metadata"),
        warnings.alias("warnings"),
        confidence.alias("confidence"),
    )


def totals(docs: DataFrame) -> DataFrame:
    """Documents, characters and mean confidence by kind."""
    return docs.groupBy("kind").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"), F.round(F.avg("confidence"), 6).alias("confidence"))
