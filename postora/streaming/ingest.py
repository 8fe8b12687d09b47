"""Continuous ingest: batches of documents are appended to a journal, from which the index of any moment is read.

A batch has a folder of its own in the journal, overwritten if it is run again, so replays change nothing. Documents
are numbered by batch and, in it, by the order column. Order of arrival counts, event time doesn't.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from postora.operators.search import ResultCode
from postora.sources.ingest import Index, from_documents
from postora.sources.tables import numbered

#: Documents a batch can number.
PER_BATCH = 1 << 40
#: Files that a batch of a stream takes in.
MOST_FILES = 1000


def validated(documents: DataFrame) -> ResultCode:
    """Whether a batch can be taken: every document has a key, and stored fields are those of that key."""
    bad = documents.where(F.col("object_id").isNull() | (F.col("doc").isNotNull() & ~F.col("doc.uid").eqNullSafe(F.col("object_id").cast("long"))))
    n = bad.limit(1).count()
    return ResultCode(1, "a document lacks its key, or stores fields under another") if n else ResultCode(0)


def append(journal: str, documents: DataFrame, batch: int, order: Sequence[str] = ("object_id",)) -> ResultCode:
    """Writes a batch to the journal, whole or not at all."""
    code = validated(documents)
    if code.code == 0:
        placed = numbered(documents.drop("doc_id"), list(order), "doc_id", batch * PER_BATCH + 1)
        placed.write.mode("overwrite").parquet(f"{journal}/batch={batch}")
    return code


def update(journal: str, documents: DataFrame, order: Sequence[str] = ("object_id",)) -> ResultCode:
    """Appends a batch after the last one, at once. Its number is claimed first, by a file that only one writer can
    create, so that writers at the same time have batches of their own."""
    return append(journal, documents, claimed(documents.sparkSession, journal), order)


def claimed(spark: SparkSession, journal: str) -> int:
    """A batch number above all in the journal that nobody else has or gets."""
    at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{journal}{name}")
    system = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for folder in ("", "/_claims") if system.exists(at(folder)) for s in system.listStatus(at(folder))]
    number = max((int(n[6:]) for n in names if n.startswith("batch=")), default=-1) + 1
    while not system.createNewFile(at(f"/_claims/batch={number}")):
        number += 1
    return number


def files(spark: SparkSession, schema: StructType, path: str, most_files: int = MOST_FILES, **options: str) -> DataFrame:
    """A stream of the documents in Parquet files, at most `most_files` of them a batch: what arrives faster waits in the
    folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).options(**options).parquet(path)


def start(source: DataFrame, journal: str, checkpoint: str, order: Sequence[str] = ("object_id",), trigger: dict | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Streams documents into the journal; Spark's checkpoint makes each batch once. Bad batches stop the stream."""

    def taken(batch: DataFrame, number: int) -> None:
        code = append(journal, batch, number, order)
        if code.code:
            raise ValueError(code.msg)
        if after:
            after(batch, number)

    return source.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def journaled(spark: SparkSession, journal: str) -> DataFrame:
    """All documents of the journal, with their numbers."""
    return spark.read.option("basePath", journal).parquet(f"{journal}/batch=*").drop("batch")


def latest(documents: DataFrame) -> DataFrame:
    """The newest document of each key."""
    every = F.struct(*documents.columns)
    return documents.groupBy("object_id").agg(F.max_by(every, "doc_id").alias("d")).select("d.*")


def recover(spark: SparkSession, journal: str, newest_only: bool = True, fields: Sequence[str] | None = None) -> Index:
    """The index that the journal holds, with doc_ids in order of arrival. With newest_only, superseded versions are
    left out, as compaction would."""
    documents = journaled(spark, journal)
    return from_documents(latest(documents) if newest_only else documents, fields=fields)


def compact_journal(spark: SparkSession, journal: str, to: str) -> None:
    """Writes a journal with the newest document of each key as its only batch; searches find the same."""
    latest(journaled(spark, journal)).write.mode("overwrite").parquet(f"{to}/batch=0")
