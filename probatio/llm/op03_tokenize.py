"""Byte-pair encoding and decoding of whole texts (see ``bpe``).

Nulls and empty texts have no tokens and decode to the empty string. Repeated
rows are encoded each on its own. Columns besides id and text play no part.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bounded_batches


def _encode(batches, path: str, keep_ids: bool):
    encoder, decoder = bpe.cached_encoder(path), bpe.decoder(path)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        rows: tuple = ([], [], [], [], [])
        for ids in encoder.encode_batch(texts):
            wide = ids.astype("<u4")
            text = decoder.decode(ids).decode("utf-8", "replace")
            rows[0].append(len(ids))
            rows[1].append(hashlib.sha256(wide.tobytes()).hexdigest())
            rows[2].append(hashlib.sha256(text.encode()).hexdigest())
            if keep_ids:
                rows[3].append(wide.astype("i4"))
                rows[4].append(text)
        out = [batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string())]
        names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if keep_ids:
            out += [pa.array(rows[3], pa.list_(pa.int32())), pa.array(rows[4], pa.string())]
            names += ["ids", "decoded"]
        yield pa.RecordBatch.from_arrays(out, names=names)


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Token count and digests for each document, with ``ids`` and ``decoded`` if ``keep_ids``.

    ``path`` is a tokenizer file that every executor can read. Narrow: no shuffle.
    """
    bounded_batches(docs.sparkSession)
    extra = ", ids array<int>, decoded string" if keep_ids else ""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(partial(_encode, path=path, keep_ids=keep_ids), schema)
    return out.withColumnRenamed("id", id_col)
