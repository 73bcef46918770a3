"""Token-id files in ascending id order, in the format of ``pfor``.

Texts are range-partitioned by document id and sorted within each partition;
each task encodes its range and writes one file to the shared folder under a
name of its own attempt, then renames it, so a task that runs twice leaves one
whole file. One small row for each file comes back and gives every file's first
position; a second pass reads the files.

Null and empty texts hold only the end id. Repeated rows are written each on
their own, ties in the order of the texts; null document ids come first.
Columns besides id and text play no part.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pfor, rapid
from .common import bounded_batches, shared_dir

END_ID = 2


def _write(batches, folder: str, path: str, end_id: int):
    encoder = rapid.encoder(path)
    context = TaskContext.get()
    part = context.partitionId()
    fs, at = pafs.FileSystem.from_uri(folder)
    whole, own = f"{at}/part-{part:06d}.pfor", f"{at}/_part-{part:06d}-{context.taskAttemptId()}"
    writer = None
    with fs.open_output_stream(own) as stream:
        writer = pfor.Writer(stream)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encoder.encode_batch([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                writer.add(key, np.append(ids, ids.dtype.type(end_id)))
        writer.close()
    if fs.get_file_info(whole).type == pafs.FileType.NotFound:
        fs.move(own, whole)
    else:  # another attempt at this task has left the same file
        fs.delete_file(own)
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([writer.documents], pa.int64()), pa.array([writer.tokens], pa.int64())], names=["part", "documents", "tokens"])


def _read(batches, folder: str, kind: str):
    fs, at = pafs.FileSystem.from_uri(folder)
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    for batch in batches:
        for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with fs.open_input_file(f"{at}/part-{part:06d}.pfor") as stream:
                for keys, sizes, ids in pfor.read_sections(stream):
                    ends = np.cumsum(sizes)
                    wide = ids.astype("<u4")
                    crcs = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, key_type), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])
                    start += int(ends[-1])


def write_ids(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID):
    """Write the files to ``folder``; (part, documents, tokens) of each file, in order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    fs, at = pafs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    ordered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ordered = ordered.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id", "text")
    # One row for each file, so its size is bounded by the number of partitions.
    return sorted(ordered.mapInArrow(partial(_write, folder=folder, path=path, end_id=end_id), "part int, documents long, tokens long").collect())


def read_ids(spark, folder: str, files, id_type: str = "bigint", id_col: str = "doc_id") -> DataFrame:
    """Each document's position, size and checksum, read from the files."""
    rows, before = [], 0
    for part, _, tokens in files:
        rows.append((part, before))
        before += tokens
    # A file is a task's work.
    manifest = spark.createDataFrame(rows, "part int, start long").repartition(max(1, len(rows)))
    out = manifest.mapInArrow(partial(_read, folder=folder, kind=id_type), f"id {id_type}, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("id", id_col)


def token_output(docs: DataFrame, path: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Write ``docs`` as token-id files and return what reading them back gives."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/pfor-{uuid.uuid4().hex}"
    folder = folder if "://" in folder or not folder.startswith("file:") else "file://" + folder.removeprefix("file:")
    files = write_ids(docs, path, folder, id_col, text_col, end_id)
    return read_ids(spark, folder, files, docs.schema[id_col].dataType.simpleString(), id_col)
