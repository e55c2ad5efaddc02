"""Uploads: files of one path stay apart, other encodings are read, archives are shared by tasks."""

import io
import zipfile

from loomgraph.operators.segment import chunk_files
from loomgraph.sources import uploads


def archive(*entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in entries:
            z.writestr(name, content)
    return data.getvalue()


def table(df):
    return sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect())


TWO = [
    ("b.zip", archive(("main.tex", "\\section{B}\nbeta1\nbeta2"), ("fig.png", b"of b"), ("x/", ""), ("notes.md", "no"))),
    ("a.zip", archive(("z.tex", "last"), ("main.tex", "\\section{A}\nalpha1\nalpha2"), ("fig.png", b"of a"))),
    ("broken.zip", b"not a zip"),
    ("paper.pdf", b"%PDF"),
]


def test_paths_repeat(spark):
    got = uploads.split_uploads(spark.createDataFrame(TWO, "path string, content binary"))
    assert table(got["files"].select("file_seq", "path", "content")) == [(0, "z.tex", "last"), (1, "main.tex", "\\section{A}\nalpha1\nalpha2"), (2, "main.tex", "\\section{B}\nbeta1\nbeta2")]
    assert table(got["assets"]) == [("fig.png", "png", b"of b")]  # the last upload's
    assert table(got["warnings"]) == [("ignored, not a zip archive: paper.pdf",), ("not a readable zip archive: broken.zip",)]
    chunks = {r["title"]: r["text"] for r in chunk_files(got["files"]).collect()}
    assert chunks == {"A": "\\section{A}\nalpha1\nalpha2", "B": "\\section{B}\nbeta1\nbeta2", "z.tex": "last"}


def test_order_of_uploads(spark):
    rows = [(p, c, i) for i, (p, c) in enumerate(TWO)]
    got = uploads.split_uploads(spark.createDataFrame(rows, "path string, content binary, upload_seq long"))
    assert [r["content"][9:10] for r in got["files"].orderBy("file_seq").collect()] == ["B", "", "A"]
    assert table(got["assets"]) == [("fig.png", "png", b"of a")]


def test_encodings(spark):
    rows = [("l.zip", archive(("a.tex", "caf\u00e9".encode("latin-1")), ("b.tex", "caf\u00e9 ok")))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = uploads.split_uploads(df)
    assert table(got["files"].select("path", "content")) == [("a.tex", "caf\ufffd"), ("b.tex", "caf\u00e9 ok")]
    assert table(got["warnings"]) == [("read with replacements, not utf-8: a.tex of l.zip",)]
    assert ("a.tex", "caf\u00e9") in table(uploads.split_uploads(df, "latin-1")["files"].select("path", "content"))


def test_one_archive_over_many_tasks(spark, tmp_path):
    """Entries of one archive are read by several tasks, and give what one task gives."""
    entries = [(f"d/f{i:03d}.tex", f"\\section{{S{i}}}\n" + "word " * 200) for i in range(60)] + [("d/f003.tex", "again"), ("pic.GIF", b"\x00")]
    (tmp_path / "big.zip").write_bytes(archive(*entries))
    (tmp_path / "bad.zip").write_bytes(b"no")
    (tmp_path / "readme.txt").write_bytes(b"no")
    paths = spark.createDataFrame([(str(tmp_path / "big.zip"),)], "path string")
    read = uploads.archive_entries(paths, task_bytes=4000)
    assert read.rdd.getNumPartitions() > 8
    one = uploads.zip_entries(spark.createDataFrame([(str(tmp_path / "big.zip"), (tmp_path / "big.zip").read_bytes())], "path string, content binary"))
    assert sorted(map(str, read.collect())) == sorted(map(str, one.collect())) and read.count() == 61
    whole = uploads.read_uploads(spark, str(tmp_path))
    files = {r["path"]: (r["content"], r["file_seq"]) for r in whole["files"].collect()}
    assert len(files) == 60 and files["d/f003.tex"] == ("again", 3) and whole["assets"].count() == 1 and whole["warnings"].count() == 2


def test_nothing_uploaded(spark):
    got = uploads.split_uploads(spark.createDataFrame([], "path string, content binary"))
    assert got["files"].count() == 0 and table(got["warnings"]) == [("no .tex file found",)]
