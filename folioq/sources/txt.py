"""Plain-text books from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioq.operators import books
from folioq.sources.charset import with_text

MOST_BYTES = 50 << 20


def read(spark: SparkSession, path: str, namespace: str = "default") -> DataFrame:
    """(bookUrl, name, text, problem) of every .txt file below path that isn't empty (Spark lists no empty files)."""
    return imported(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[tT][xX][tT]").load(path), namespace)


def imported(files: DataFrame, namespace: str = "default") -> DataFrame:
    """The same of files (path, length, content), wherever they come from."""
    problem = F.when(F.col("length") > MOST_BYTES, "too large")
    rows = with_text(files.select("path", "length", F.when(problem.isNull(), F.col("content")).alias("content")), "content", plain=True)
    name = F.regexp_replace(F.regexp_extract(F.url_decode("path"), r"([^/]+?)(?:\.[^.]*)?$", 1), r'[\\/:*?"<>|\x00-\x1F]', "_")
    url = F.concat(F.lit("local-txt:"), F.md5(F.concat_ws(":", F.lit(namespace), F.lit("file"), F.md5("text"))))
    return rows.select(url.alias("bookUrl"), name.alias("name"), "text", problem.alias("problem"))


def chapters(books_: DataFrame, heading: str = books.HEADING, keep: tuple[str, ...] = ()) -> DataFrame:
    """(bookUrl, keep, index, title, url, start, stop, content, chars) of the books that have no problem; keep are columns of theirs."""
    rows = books.chapters(books_.where("problem IS NULL"), heading, "bookUrl", "text", keep=keep)
    return rows.select("*", F.concat_ws("#", "bookUrl", "index").alias("url"), F.length("content").alias("chars"))
