"""Segmentation of LaTeX files into chunks by headings, and of long chunks into windows of tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import WS, squeeze, trim
from ..model import GRANULARITIES, HEADINGS
from ..storage import broadcast_if_small, dealt, numbered, starts, stored

# Heading commands and tokens.
HEADING = rf"^\\(chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\{{(.+?)\}}[{WS}]*\z"
#: A token with the white space before it, so that tokens in a row are the text itself: a word, a command or any other character. Nothing is given back once taken.
TOKEN = rf"[{WS}]*+(?:[a-zA-Z0-9_]++|\\[a-zA-Z]++|[^{WS}])"
LEVELS = range(1, 6)


def strip_comment(line: Column) -> Column:
    """A line up to its first % that no backslash takes; a backslash takes the next character along."""
    return F.regexp_replace(line, r"(?s)\A((?:[^\\%]|\\.)*+)%.*\z", "$1")


def strip_comments(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n", -1), strip_comment), "\n")


def order_files(files: DataFrame) -> DataFrame:
    """``files`` with rank: their places by path as a reader orders them (case and digits as ICU has them); ties keep file_seq."""
    return numbered(files, [F.expr("path COLLATE UNICODE"), F.col("file_seq")], "rank").withColumn("rank", F.col("rank").cast("int"))


def summed_before(files: DataFrame, name: str, to: str) -> DataFrame:
    """Adds the sum of a column over all files before in their order. Ranges of files are summed in parallel; only the ranges' sums meet."""
    order = [F.expr("path COLLATE UNICODE"), F.col("file_seq")]
    ranges = stored(files.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "file-ranges")
    own = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranges.withColumn(to, F.coalesce(F.sum(name).over(own), F.lit(0)))
    return placed.join(starts(ranges, F.col(name)), "_part").withColumn(to, (F.col("_start") + F.col(to)).cast("long")).drop("_part", "_start")


def lines_of(files: DataFrame) -> DataFrame:
    """(path, file_seq, pos, line) with comments gone."""
    return files.select("path", "file_seq", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line")).withColumn("line", strip_comment(F.col("line")))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_seq, pos, line, block) of the .tex files under ``path``, of any size, with comments gone.

    Files are read in splits; block is where a line's split starts, and pos, block plus the line's number in
    it, is in the order of lines, as no split has more lines than bytes. The lines are written, so no later step depends on how files are split.
    """
    raw = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.tex").option("recursiveFileLookup", True).text(path)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"), F.col("value").alias("line"))
    placed = stored(placed, "file-lines")
    first = broadcast_if_small(stored(placed.groupBy("path", "block").agg(F.min("nth").alias("first")), "file-splits"))
    return placed.join(first, ["path", "block"]).select("path", F.lit(0).cast("long").alias("file_seq"), (F.col("block") + F.col("nth") - F.col("first")).alias("pos"), strip_comment(F.col("line")).alias("line"), "block")


def with_heading(lines: DataFrame) -> DataFrame:
    """Adds level and title of the heading on each line; null on others."""
    command = F.regexp_extract("line", HEADING, 1)
    level = F.lit(None).cast("int")
    for name, n in HEADINGS.items():
        level = F.when(command == name, F.lit(n)).otherwise(level)
    lines = lines.withColumn("level", level)
    return lines.withColumn("heading", F.when(F.col("level").isNotNull(), squeeze(F.regexp_extract("line", HEADING, 2))))


def with_stack(lines: DataFrame) -> DataFrame:
    """Adds h1..h5: titles of the headings open at each line.

    A heading of a level is open if none of a higher rank came after it: its last place is compared
    to the last place of any heading of a smaller level. Lines with a ``block`` are gone through block by block: what
    the blocks before leave, the last heading of each level, is all that a block needs of them.
    """
    mark = {n: F.when(F.col("level") == n, F.struct("pos", "heading")) for n in LEVELS}
    upto = Window.partitionBy(*parts_of(lines)).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lines
    for n in LEVELS:
        last = last.withColumn(f"_l{n}", F.last(mark[n], ignorenulls=True).over(upto))
    if "block" in lines.columns:
        left = lines.filter("level is not null").groupBy(*parts_of(lines)).agg(*[F.max(mark[n]).alias(f"_b{n}") for n in LEVELS])
        every = lines.select(*parts_of(lines)).distinct().join(left, parts_of(lines), "left")
        before = Window.partitionBy("path", "file_seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        carried = every.select(*parts_of(lines), *[F.last(f"_b{n}", ignorenulls=True).over(before).alias(f"_b{n}") for n in LEVELS])  # a row a block
        last = last.join(carried, parts_of(lines))
        last = last.withColumns({f"_l{n}": F.coalesce(f"_l{n}", f"_b{n}") for n in LEVELS}).drop(*[f"_b{n}" for n in LEVELS])
    for n in LEVELS:
        above = F.greatest(F.lit(-1), F.lit(-1), *[F.coalesce(F.col(f"_l{k}.pos"), F.lit(-1)) for k in range(1, n)])
        last = last.withColumn(f"h{n}", F.when(F.col(f"_l{n}.pos") > above, F.col(f"_l{n}.heading")))
    return last.drop(*[f"_l{n}" for n in LEVELS])


def parts_of(lines: DataFrame) -> list[str]:
    """By what lines are gone through in order: their file, and where they have one their block of it."""
    return ["path", "file_seq", *(["block"] if "block" in lines.columns else [])]


def with_run(lines: DataFrame) -> DataFrame:
    """Adds run: the number from 1, within the file, of the lines that stand together under one key (bucket_level, section_path)."""
    key = F.struct("bucket_level", "section_path")
    own = Window.partitionBy(*parts_of(lines)).orderBy("pos")
    starts = lines.withColumn("_starts", (~key.eqNullSafe(F.lag(key).over(own))).cast("int"))
    runs = starts.withColumn("run", F.sum("_starts").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    if "block" not in lines.columns:
        return runs.drop("_starts")
    # A block whose first line goes on with the last key of the block before starts one run less.
    blocks = runs.groupBy(*parts_of(lines)).agg(F.min_by(key, "pos").alias("first"), F.max_by(key, "pos").alias("last"), F.max("run").alias("n"))
    order = Window.partitionBy("path", "file_seq").orderBy("block")
    goes_on = blocks.withColumn("_goes_on", F.coalesce(F.col("first") == F.lag("last").over(order), F.lit(False)).cast("int"))
    before = F.coalesce(F.sum(F.col("n") - F.col("_goes_on")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = goes_on.select(*parts_of(lines), (before - F.col("_goes_on")).alias("_shift"))  # a row a block
    return runs.join(shift, parts_of(lines)).withColumn("run", F.col("run") + F.col("_shift")).drop("_starts", "_shift")


def with_bucket(lines: DataFrame, granularity: str) -> DataFrame:
    """Adds bucket_level, bucket_title and section_path: the open heading of the wanted level, else the nearest above it, else the file."""
    wanted = GRANULARITIES[granularity]
    level, title = F.lit(0), F.col("path")
    for n in range(1, wanted + 1):
        level = F.when(F.col(f"h{n}").isNotNull(), F.lit(n)).otherwise(level)
        title = F.coalesce(F.col(f"h{n}"), title)
    lines = lines.withColumns({"bucket_level": level, "bucket_title": title})
    parts = [F.when(F.col("bucket_level") >= n, F.col(f"h{n}")) for n in LEVELS]
    return lines.withColumn("section_path", F.array_compact(F.array(F.col("path"), *parts)))


def chunk_files(files: DataFrame, granularity: str = "section", max_tokens: int | None = None) -> DataFrame:
    """Chunks of all files (path, content, and file_seq if there is one); a file's content is a cell, so one task goes through its lines."""
    files = files if "file_seq" in files.columns else files.withColumn("file_seq", F.lit(0).cast("long"))
    return chunk_lines(lines_of(files), granularity, max_tokens)


def chunk_lines(lines: DataFrame, granularity: str = "section", max_tokens: int | None = None) -> DataFrame:
    """Chunks of lines (path, file_seq, pos, line, and block if there is one): runs of lines under one heading of the wanted level.

    Blank runs leave no chunk and take no number. The number in an id runs over all files in their
    order; ranges of chunks are numbered in parallel, so no task sees all chunks, and with blocks none a whole file, only
    the lines of a chunk.
    """
    marked = with_bucket(with_stack(with_heading(lines)), granularity)
    marked = stored(marked, "marked-lines") if "block" in lines.columns else marked
    joined = with_run(marked).groupBy("path", "file_seq", "run").agg(
        F.min_by("bucket_title", "pos").alias("title"),
        F.min_by("section_path", "pos").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    texts = stored(joined.withColumn("text", trim(F.col("text"))).filter("text <> ''"), "chunk-texts")
    chunks = numbered(texts, [F.expr("path COLLATE UNICODE"), F.col("file_seq"), F.col("run")], "_n").select(
        F.concat(F.lit("chunk:"), "path", F.lit(":"), F.col("_n").cast("string")).alias("id"),
        F.col("path").alias("file"), "title", "section_path", "text", (F.col("_n") * (1 << 16)).cast("long").alias("chunk_seq"),
    )
    return split_windows(chunks, max_tokens)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def split_windows(chunks: DataFrame, max_tokens: int | None) -> DataFrame:
    """Chunks over ``max_tokens`` become windows of so many tokens, each half a window on; others stay."""
    if not max_tokens or max_tokens <= 0:
        return chunks
    size = int(max_tokens)
    stride = max(1, size // 2)
    step = math.gcd(size, stride)  # windows start and end between runs of so many tokens, which are taken whole
    parts = dealt(chunks).withColumn("_t", F.regexp_extract_all("text", F.lit(rf"(?:{TOKEN}){{1,{step}}}+"), F.lit(0))).withColumn("_n", F.size("_t") * step)
    last = F.ceil((F.col("_n") - size) / F.lit(stride)).cast("int")
    begun = lambda text: F.regexp_extract(text, rf"(?s)\A[{WS}]*+(.*)", 1)  # noqa: E731  a token ends with no white space
    cut = lambda w: F.struct(w.alias("w"), begun(F.array_join(F.slice("_t", w * (stride // step) + 1, size // step), "")).alias("text"))
    whole = F.array(F.struct(F.lit(-1).alias("w"), F.col("text").alias("text")))
    windows = F.when(F.col("_n") > size, F.transform(F.sequence(F.lit(0), last), cut)).otherwise(whole)
    others = [c for c in chunks.columns if c not in ("text", "id", "chunk_seq")]
    each = parts.select(*others, "id", "chunk_seq", F.explode(windows).alias("_w"))  # the tokens stay behind
    name = F.when(F.col("_w.w") < 0, F.col("id")).otherwise(F.concat("id", F.lit(":w"), F.col("_w.w").cast("string")))
    seq = F.col("chunk_seq") + F.greatest(F.col("_w.w"), F.lit(0))
    return each.withColumns({"text": F.col("_w.text"), "id": name, "chunk_seq": seq.cast("long")}).select(*chunks.columns)


def preview_titles(chunks: DataFrame, most: int = 10) -> DataFrame:
    """(total, place, title): the number of chunks and the first distinct titles."""
    title = F.array_join(F.slice("section_path", 2, F.greatest(F.size("section_path") - 1, F.lit(0))), " / ")
    titled = chunks.select(F.when(title == "", F.col("title")).otherwise(title).alias("title"), "chunk_seq")
    total = titled.count()
    first = titled.groupBy("title").agg(F.min("chunk_seq").alias("at")).orderBy("at").limit(most)
    return first.select(F.lit(total).cast("long").alias("total"), (F.row_number().over(Window.orderBy("at")) - 1).alias("place"), "title")
