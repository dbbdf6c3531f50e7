"""Token-id files: documents' ids in ascending key order, Re-Pair compressed by segment, written and read through Spark."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeframe.llm.bytebpe import encoder
from lodeframe.llm.columns import column, raw_texts, rows
from lodeframe.llm.repair import Segment
from lodeframe.llm.scratch import partitions, shared_folder

SEGMENT = 1 << 19  # ids after which a segment is closed
FILE = "shard int, segment int, documents long, ids long, payload binary"


def write(docs: DataFrame, path: str, folder: str, end_id: int = 0, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> None:
    """Write the ids of all documents, each followed by end_id, in ascending key order below folder.

    Documents are dealt by ranges of the key (equal keys by the text's hash as well, so that no key fills one
    task); a range is a shard, and a shard's segments hold about `segment` ids each, or one longer document.
    """

    def encoded(batches):
        enc, end, shard = encoder(path), np.array([end_id], np.uint32), TaskContext.get().partitionId()
        number, keys, held, size = 0, [], [], 0

        def closed():
            blob = Segment.written(keys, np.array([len(x) for x in held], np.uint32), np.concatenate(held))
            return rows(shard=pa.array([shard], pa.int32()), segment=pa.array([number], pa.int32()), documents=[len(keys)], ids=[size], payload=pa.array([blob], pa.binary()))

        for batch in batches:
            texts, names = raw_texts(column(batch, "t")), column(batch, "d").to_pylist()
            for a in range(0, len(texts), 256):
                for k, ids in zip(names[a : a + 256], enc.encode(texts[a : a + 256]), strict=True):
                    keys.append(k)
                    held.append(np.append(ids, end))
                    size += len(ids) + 1
                    if size >= segment:
                        yield closed()
                        number, keys, held, size = number + 1, [], [], 0
        if keys:
            yield closed()

    spark = docs.sparkSession
    plain = docs.select(F.col(key).cast("long").alias("d"), F.col(text).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = plain.repartitionByRange(partitions(spark), "d", "h").sortWithinPartitions("d", "h").drop("h")
    ordered.mapInArrow(encoded, FILE).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (little-endian 32-bit ids)."""
    files = spark.read.schema(FILE).parquet(folder)
    sizes = files.select("shard", "segment", "ids")
    shards = sizes.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    inside = sizes.select("shard", "segment", (F.sum("ids").over(Window.partitionBy("shard").orderBy("segment")) - F.col("ids")).alias("segment_start"))
    starts = inside.join(before, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("first"))

    def decoded(batches):
        for batch in batches:
            for blob, first in zip(column(batch, "payload").to_pylist(), column(batch, "first").to_pylist(), strict=True):
                s = Segment(blob)
                raw, ends = s.all().astype("<u4").tobytes(), np.cumsum(s.counts)
                begins = ends - s.counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield rows(doc_id=pa.array(s.keys, mask=s.has_key == 0), start=begins + first, n_tokens=s.counts, ids_crc32=np.array(crc, np.int64))

    return files.join(starts, ["shard", "segment"]).select("payload", "first").mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str, **how) -> DataFrame:
    """Write the files into the shared folder and read them back.

    Null and empty texts are the end id alone; null keys come first and stay null; equal keys keep one place
    each, ordered by the text's hash; an empty table gives no files' rows and an empty result.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/token-files/{uuid.uuid4().hex}"
    write(docs, path, folder, **how)
    return read(spark, folder)
