"""Files as tables: format detection, plain text, markup, and members of archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Formats by the end of a file name, and those that can be read.
SUFFIXES = {".txt": "txt", ".md": "markdown", ".markdown": "markdown", ".html": "html", ".htm": "html", ".docx": "docx", ".pdf": "pdf", ".epub": "epub", ".mobi": "mobi"}
SUPPORTED = ("txt", "markdown", "html", "docx", "pdf", "epub", "mobi")


def format_of(name: Column, head: Column, members: Column | None = None) -> Column:
    """Format by magic, then archive members, then name, then the first 16 characters."""
    out = F.when(F.startswith(head, F.lit("%PDF-")), "pdf").when(F.contains(F.substring(head, 1, 128), F.lit("BOOKMOBI")), "mobi")
    if members is not None:
        out = out.when(F.array_contains(members, "mimetype=application/epub+zip"), "epub").when(F.array_contains(members, "word/document.xml"), "docx")
    suffix = F.lower(F.regexp_extract(name, "[.][^./]*$", 0))
    for end, kind in SUFFIXES.items():
        out = out.when(suffix == end, kind)
    sniff = F.ltrim(F.lower(F.substring(head, 1, 16)))
    return out.when(sniff.startswith("<!doctype html") | sniff.startswith("<html"), "html").otherwise("unsupported")


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, format, adapter, size, supported, content of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    head = F.decode(F.substring("content", 1, 128), "ISO-8859-1")
    kind = format_of(F.col("path"), head, archive_members(F.col("content")))
    found = files.select("path", kind.alias("format"), F.col("length").alias("size"), "content")
    return found.select("path", "format", F.concat("format", F.lit("-adapter")).alias("adapter"), "size", F.col("format").isin(*SUPPORTED).alias("supported"), "content")


def archive_members(content: Column) -> Column:
    """Member names of ZIP archives, the mimetype with its payload; null for other contents."""

    @F.udf("array<string>")
    def names(data: bytes | None) -> list[str] | None:
        if data is None or bytes(data[:2]) != b"PK":
            return None
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                found = archive.namelist()
                return [f"mimetype={archive.read(n).decode('latin-1')}" if n == "mimetype" else n for n in found]
        except zipfile.BadZipFile:
            return None

    return F.when(F.substring(content, 1, 2) == F.lit(b"PK"), names(content))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text of plain-text files, line ends as line feeds."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.withColumn("text", F.replace("text", F.lit("\r\n"), F.lit("\n")))


class ArchiveReader(DataSourceReader):
    """One task for each archive of a folder."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def partitions(self) -> list[InputPartition]:
        from pathlib import Path

        root = Path(self.path)
        return [InputPartition(str(p)) for p in ([root] if root.is_file() else sorted(root.rglob("*.epub")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.value) as archive:
            for ord_, info in enumerate(archive.infolist()):
                yield (partition.value, ord_, info.filename, info.file_size, info.compress_type, archive.read(info))


class ArchiveSource(DataSource):
    """``spark.read.format("archive").load(path)``: members of EPUB files.  Paths are local to the executors."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return "package string, ord int, name string, size long, compress_type int, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)
