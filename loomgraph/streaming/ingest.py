"""Incremental ingestion: new files of documents as a stream, each batch chunked and merged into the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators.chunking import passages
from loomgraph.sources.sinks import commit, upsert


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Documents as parquet files arrive; (id, text, file_hash, ingested_at) and more."""
    return spark.readStream.schema(schema).parquet(path)


def _timed(docs: DataFrame) -> DataFrame:
    """Event times without a zone are taken in the session's zone, as watermarks need instants."""
    return docs.withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))


def new_texts(docs: DataFrame, delay: str = "7 days") -> DataFrame:
    """Drop texts whose file_hash came before, remembering hashes for ``delay`` of event time."""
    return _timed(docs).withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["file_hash"])


def arrival_counts(docs: DataFrame, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(day, source, n): documents per window and source, late ones within ``delay`` included."""
    g = _timed(docs).withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", width), "extraction_source").agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("day"), "extraction_source", "n")


def merge_chunks(docs: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Chunk every new document and replace its chunks in the table at ``table_path``; runs what is there, then ends.

    A batch that is run again after a failure gives the same table: rows are replaced by document and index.
    """

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        new = passages(df.select("id", "text")).select("id", "chunk_index", "content", "char_start", "char_end")
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table_path)
        exists = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        if exists:
            old = spark.read.parquet(table_path).join(df.select("id").distinct(), "id", "left_anti")
            new = upsert(old, new, ["id", "chunk_index"])
        commit(new, table_path)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
