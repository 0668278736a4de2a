"""File sources: Markdown, repository checkouts, PDF through a pluggable parser, web pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.schema import MAX_REPO_BYTES

_TITLE = r"(?md)^#{1,6}\s+(.+)$"


def file_hash(content: str = "content"):
    return F.sha2(F.col(content), 256)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, title, text, file_hash): the title is the first heading, bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(F.col("path").alias("file_path"), F.nullif(F.trim(F.regexp_extract(text, _TITLE, 1)), F.lit("")).alias("title"), X.clean_markdown(text).alias("text"), file_hash().alias("file_hash"))


def wanted_documents(files: DataFrame) -> DataFrame:
    """Documents of a checkout: .md and .rst of at most 200,000 bytes outside skipped folders; (path, length)."""
    skipped = r"(?:^|/)(?:\.git|node_modules|\.venv|venv)/"
    return files.where(F.lower("path").rlike(r"\.(?:md|rst)$") & (F.col("length") <= MAX_REPO_BYTES) & ~F.col("path").rlike(skipped))


def read_repository(spark: SparkSession, path: str, name: str, url: str, commit: str | None = None) -> DataFrame:
    """(repo_name, url, commit_sha, path, text), cleaned and without blank documents; cloning stays outside."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,rst}").load(path)
    d = wanted_documents(raw).select("path", X.clean_markdown(F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))
    return d.where(F.trim("text") != "").select(F.lit(name).alias("repo_name"), F.lit(url).alias("url"), F.lit(commit).alias("commit_sha"), "path", "text")


def page_text(pages) -> object:
    """Text of an array of pages: each page that isn't blank after its marker; blank pages keep their number."""
    numbered = F.transform(pages, lambda p, i: F.when(F.trim(F.coalesce(p, F.lit(""))) != "", F.concat(F.lit("--- Page "), (i + 1).cast("string"), F.lit(" ---\n"), p)))
    return F.array_join(F.array_compact(numbered), "\n")


def read_pdf(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[list[str], str | None, str | None]]) -> tuple[DataFrame, DataFrame]:
    """(papers, errors) of PDF files; ``parse`` gives (pages, title, author) of a file's bytes.

    No parser is bundled. Files that can't be parsed or hold no text are errors with a reason; files of no bytes are
    not listed by the binary file source at all.
    """

    @F.udf("struct<pages:array<string>,title:string,author:string,error:string>")
    def run(content: bytes):
        if not content:
            return None, None, None, "empty file"
        try:
            pages, title, author = parse(bytes(content))
        except Exception as e:  # noqa: BLE001
            return None, None, None, f"{type(e).__name__}: {e}"[:200]
        return pages, title, author, None if any(p and p.strip() for p in pages) else "no text"

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = raw.where(F.lower("path").endswith(".pdf")).withColumn("p", run("content"))
    bad = raw.where(~F.lower("path").endswith(".pdf")).select(F.col("path").alias("file_path"), F.lit("not a .pdf file").alias("reason"))
    good = named.where("p.error IS NULL").select(
        F.col("path").alias("file_path"), "p.title", F.when(F.col("p.author").isNotNull(), F.array("p.author")).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.size("p.pages").alias("page_count"), page_text(F.col("p.pages")).alias("text"), file_hash().alias("file_hash"), F.lit("en").alias("language"),
    )
    return good, bad.unionByName(named.where("p.error IS NOT NULL").select(F.col("path").alias("file_path"), F.col("p.error").alias("reason")))


def read_web(pages: DataFrame) -> DataFrame:
    """(url, domain, title, text) of (url, html)."""
    title = F.nullif(F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|title)\b.*?</\1>", " "), "<[^>]+>", " ")
    return pages.select("url", F.parse_url("url", F.lit("HOST")).alias("domain"), title.alias("title"), X.collapse(body).alias("text"))
