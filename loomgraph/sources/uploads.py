"""LaTeX sources: zip archives and folders of .tex files.

A file is known by its upload and its place there, as paths repeat: file_seq counts all files, by upload and
place. Texts that are not of the named encoding are read with U+FFFD for what can't be decoded, and a warning.
"""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import IMAGE_EXTENSIONS
from ..storage import numbered, stored

ENTRIES = "archive string, entry_seq long, path string, text string, bytes binary, problem string"
LISTED = "archive string, entry_seq long, path string, size long, problem string"

_ENTRIES = pa.schema([("archive", pa.string()), ("entry_seq", pa.int64()), ("path", pa.string()), ("text", pa.string()), ("bytes", pa.binary()), ("problem", pa.string())])
_LISTED = pa.schema([("archive", pa.string()), ("entry_seq", pa.int64()), ("path", pa.string()), ("size", pa.int64()), ("problem", pa.string())])

#: Unpacked bytes that one task reads of an archive.
TASK_BYTES = 64 << 20


def extension(path: Column) -> Column:
    """What follows the last point of the lower-case path; empty without one."""
    lower = F.lower(path)
    return F.when(lower.contains("."), F.element_at(F.split(lower, r"\."), -1)).otherwise("")


def kind_of(path: Column) -> Column:
    """``tex``, ``image`` or null for what is not used."""
    e = extension(path)
    return F.when(e == "tex", "tex").when(e.isin(*IMAGE_EXTENSIONS), "image")


def listed(z: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    """An archive's files in its order, folders left out. Of entries of one name the last counts, in the place of the first."""
    return [i for i in {i.filename: i for i in z.infolist()}.values() if not i.is_dir()]


def unpacked(archive: str, seq: int, name: str, data: bytes, encoding: str) -> dict:
    """A row of ENTRIES: .tex files as text, other files as bytes."""
    row = {"archive": archive, "entry_seq": seq, "path": name, "text": None, "bytes": None, "problem": None}
    if not name.lower().endswith(".tex"):
        return {**row, "bytes": data}
    try:
        return {**row, "text": data.decode(encoding)}
    except UnicodeDecodeError:
        return {**row, "text": data.decode(encoding, "replace"), "problem": f"read with replacements, not {encoding}: {name} of {archive}"}


def wanted(name: str) -> bool:
    return "." in name and name.lower().rsplit(".", 1)[1] in ("tex", *IMAGE_EXTENSIONS)


def unreadable(archive: str) -> dict:
    return {"archive": archive, "entry_seq": -1, "path": None, "problem": f"not a readable zip archive: {archive}"}


def zip_entries(archives: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """ENTRIES of archives (path, content binary): .tex files and images. An archive that can't be read gives a row with a problem alone."""

    def rows(path: str, content: bytes) -> Iterator[dict]:
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                for i, info in enumerate(listed(z)):
                    if wanted(info.filename):
                        yield unpacked(path, i, info.filename, z.read(info), encoding)
        except zipfile.BadZipFile:
            yield unreadable(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                for row in rows(path.as_py(), content.as_py()):
                    yield pa.RecordBatch.from_pylist([row], _ENTRIES)

    return archives.select("path", "content").mapInArrow(run, ENTRIES)


def archive_entries(archives: DataFrame, encoding: str = "utf-8", task_bytes: int = TASK_BYTES) -> DataFrame:
    """As zip_entries(), of archives (path) in a store that pyarrow opens, of any size: tasks share an archive's entries.

    A first pass reads the archives' tables of contents; entries are dealt over tasks by runs of about
    ``task_bytes`` unpacked bytes, and each task opens the archives again and reads its runs alone.
    """
    spark = archives.sparkSession

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                try:
                    with opened(path) as f, zipfile.ZipFile(f) as z:
                        rows = [{"archive": path, "entry_seq": i, "path": e.filename, "size": e.file_size, "problem": None} for i, e in enumerate(listed(z)) if wanted(e.filename)]
                except (zipfile.BadZipFile, pa.ArrowInvalid):
                    rows = [{**unreadable(path), "size": 0}]
                yield pa.RecordBatch.from_pylist(rows, _LISTED)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, own in groupby(b.to_pylist(), lambda r: r["archive"]):
                with opened(archive) as f, zipfile.ZipFile(f) as z:
                    for r in own:
                        yield pa.RecordBatch.from_pylist([unpacked(archive, r["entry_seq"], r["path"], z.read(r["path"]), encoding)], _ENTRIES)

    found = stored(archives.select("path").repartition(spark.sparkContext.defaultParallelism).mapInArrow(contents, LISTED), "archive-contents")
    good = found.filter("problem is null")
    total = good.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-total // task_bytes), 100_000))
    texts = good.repartitionByRange(parts, "archive", "entry_seq").sortWithinPartitions("archive", "entry_seq").mapInArrow(read, ENTRIES)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    return texts.unionByName(found.filter("problem is not null").select("archive", "entry_seq", "path", none("text", "string"), none("bytes", "binary"), "problem"))


def opened(path: str):
    """A file for random access, in any store that pyarrow knows."""
    import pyarrow.fs as pf

    fs, at = pf.FileSystem.from_uri(path if "://" in path else "file://" + os.path.abspath(path.removeprefix("file:")))
    return fs.open_input_file(at)


def split_uploads(uploads: DataFrame, encoding: str = "utf-8") -> dict[str, DataFrame]:
    """files (path, content, file_seq), assets (path, ext, bytes) and warnings (warning) of uploads (path, content binary, and upload_seq if there is one).

    file_seq counts all files by upload (upload_seq, then the upload's path) and place; files of one path stay
    apart by it. Of assets of one path the last counts. Uploads other than .zip are left out with a warning, and so is
    an archive that can't be read; texts in another encoding and uploads without any .tex file give a warning.
    """
    is_zip = extension(F.col("path")) == "zip"
    entries = stored(zip_entries(uploads.filter(is_zip), encoding), "entries")
    upload_seq = F.col("upload_seq").cast("long") if "upload_seq" in uploads.columns else F.lit(0).cast("long")
    return sorted_out(entries, uploads.select("path", upload_seq.alias("upload_seq"), is_zip.alias("is_zip")))


def sorted_out(entries: DataFrame, uploads: DataFrame) -> dict[str, DataFrame]:
    """split_uploads() of ENTRIES and the uploads (path, upload_seq, is_zip)."""
    order = uploads.filter("is_zip").groupBy(F.col("path").alias("archive")).agg(F.min("upload_seq").alias("upload_seq"))
    placed = entries.filter("path is not null").withColumn("kind", kind_of(F.col("path"))).join(order, "archive")
    tex = placed.filter("kind = 'tex'").select("upload_seq", "archive", "entry_seq", "path", F.col("text").alias("content"))
    files = numbered(tex, ["upload_seq", "archive", "entry_seq"], "file_seq").select("path", "content", "file_seq")
    last = placed.filter("kind = 'image'").groupBy("path").agg(F.max_by("bytes", F.struct("upload_seq", "archive", "entry_seq")).alias("bytes"))
    assets = last.select("path", extension(F.col("path")).alias("ext"), "bytes")
    ignored = uploads.filter("not is_zip").select(F.concat(F.lit("ignored, not a zip archive: "), "path").alias("warning"))
    problems = entries.filter("problem is not null").select(F.col("problem").alias("warning"))
    none = tex.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit("no .tex file found").alias("warning"))
    return {"files": files, "assets": assets, "warnings": ignored.unionByName(problems).unionByName(none)}


def read_uploads(spark: SparkSession, path: str, encoding: str = "utf-8") -> dict[str, DataFrame]:
    """The uploads under ``path``, archives of any size; in the order of their paths."""
    found = spark.read.format("binaryFile").load(path).select("path", F.lit(0).cast("long").alias("upload_seq"), (extension(F.col("path")) == "zip").alias("is_zip"))
    return sorted_out(stored(archive_entries(found.filter("is_zip"), encoding), "entries"), found)


def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """files (path, content, file_seq) of a folder of .tex files."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.tex", recursiveFileLookup=True)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"), F.lit(0).cast("long").alias("file_seq"))


def image_of(nodes: DataFrame, assets: DataFrame) -> DataFrame:
    """(id, path, bytes) of the image that a node's meta names."""
    return nodes.select("id", F.col("meta")["image"].alias("path")).join(assets.select("path", "bytes"), "path").select("id", "path", "bytes")
