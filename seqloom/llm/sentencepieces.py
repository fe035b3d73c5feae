"""SentencePiece encoding and decoding of a column of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import pieces
from seqloom.llm.columns import blocks, texts

SCHEMA = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids array<int>, round_trip boolean"


def encode_texts(docs: DataFrame, model: bytes) -> DataFrame:
    """The piece ids of every whole text of ``docs`` (doc_id, text), as the library gives them.

    ``round_trip`` says whether the ids decode to the text itself (they do but for
    what a model can't hold, such as the space mark itself).  A null text encodes
    as an empty one: no ids.  Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.load(model)
        is_byte = np.array([t == pieces.BYTE for t in own.types])
        for b in blocks(batches):
            data, offsets = texts(b.column("text"))
            ids, at = own.encode_block(data, offsets)
            bytes_before = np.concatenate([[0], np.cumsum(is_byte[ids])])
            raw = data.tobytes()
            back = own.decode_block(ids, at)
            same = [t.encode() == raw[i:j] for t, i, j in zip(back, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(np.diff(at)), pa.array(np.diff(bytes_before[at])), lists, pa.array(same, pa.bool_())],
                ["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids", "round_trip"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def decode_ids(rows: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """``rows`` with a ``decoded`` text of each array of ids; a null array gives null, as does an id out of range."""

    @F.pandas_udf("string")
    def decoded(ids):
        own = pieces.load(model)
        n = len(own.strings)
        return ids.map(lambda x: None if x is None or any(i is None or not 0 <= i < n for i in x) else own.decode([list(x)])[0])

    return rows.withColumn("decoded", decoded(F.col(column)))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces.model_bytes())
