"""Token counts: the exact number of tokens of every prefix of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import pieces
from seqloom.llm.columns import blocks, texts

LIMIT = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"


class Counts:
    """Token counts at every prefix of one text; questions need no further encoding."""

    def __init__(self, model: pieces.Pieces, text: str):
        self.text, self.at = text, model.prefix_counts(text)

    def total(self) -> int:
        return int(self.at[-1])

    def prefix(self, chars: int) -> int:
        """Tokens of the first ``chars`` code points."""
        return int(self.at[chars])

    def fit(self, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens."""
        return self.text[: int(np.flatnonzero(self.at <= budget)[-1])]


def count_block(model: pieces.Pieces, data: np.ndarray, offsets: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and the code points of its longest prefix of at most ``limit``."""
    codes, dictionary, doc = model.chunks(data, offsets)
    found = model.solved(dictionary)
    chars = np.array([len(f[1]) // 4 for f in found], np.int64)
    last = np.array([np.frombuffer(f[1], np.int32)[-1] for f in found], np.int64)
    tokens = np.concatenate([[0], np.cumsum(last[codes])])
    points = np.concatenate([[0], np.cumsum(chars[codes])])
    total = tokens[doc[1:]] - tokens[doc[:-1]]
    added = int(model.dummy_prefix)
    fit = np.maximum(points[doc[1:]] - points[doc[:-1]] - added, 0)
    for d in np.flatnonzero(total > limit).tolist():
        # counts at the ends of chunks rise; inside one they may fall, so its last fit counts
        first = doc[d]
        k = int(np.searchsorted(tokens[first : doc[d + 1] + 1], tokens[first] + limit, "right")) - 1 + first
        inside = np.frombuffer(found[codes[k]][1], np.int32) + (tokens[k] - tokens[first])
        fits = np.flatnonzero(inside <= limit)
        fit[d] = max(0, points[k] - points[first] + (int(fits[-1]) + 1 if len(fits) else 0) - added)
    return total, fit


def count_tokens(docs: DataFrame, model: bytes, limit: int = LIMIT) -> DataFrame:
    """Exact token counts of every whole text of ``docs`` (doc_id, text).

    ``fit_chars`` is the number of code points of the longest prefix that has at
    most ``limit`` tokens (the whole text if it isn't over the limit).  A null text
    counts as empty: no tokens.  Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces.load(model)
        for b in blocks(batches):
            data, offsets = texts(b.column("text"))
            total, fit = count_block(own, data, offsets, limit)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(total), pa.array(total > limit), pa.array(fit)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), pieces.model_bytes())
