"""Dictionary substitution: words by frequency get codes of one to three bytes.

The dictionary comes from the corpus itself.  It has the 44,880 most frequent words
(80 codes of one byte, 3,840 of two, 40,960 of three), so it is a small table that
joins by broadcast.  Case is a mark before the word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, table, views

TIERS = (80, 3840, 40960)
SIZE = sum(TIERS)

COUNTS = """SELECT lower(tok) AS word, count(*) AS n FROM cased WHERE {m}(tok, '^[A-Za-z]+$') GROUP BY lower(tok)"""
TOP = f"SELECT word, n FROM ({COUNTS}) AS c ORDER BY n DESC, word LIMIT {SIZE}"
DICT = f"""dict AS (SELECT word, n, cast(row_number() OVER (ORDER BY n DESC, word) - 1 AS bigint) AS rank FROM ({TOP}) AS top),
  coded AS (SELECT word, n, rank, CASE WHEN rank < 80 THEN 1 WHEN rank < 3920 THEN 2 ELSE 3 END AS size,
    CASE WHEN rank < 80 THEN 128 + rank WHEN rank < 3920 THEN 208 + cast(floor((rank - 80) / 80) AS bigint) ELSE 240 + cast(floor((rank - 3920) / 3840) AS bigint) % 16 END AS b0,
    CASE WHEN rank < 80 THEN -1 WHEN rank < 3920 THEN 128 + (rank - 80) % 80 ELSE 208 + cast(floor((rank - 3920) / 80) AS bigint) % 48 END AS b1,
    CASE WHEN rank < 3920 THEN -1 ELSE 128 + (rank - 3920) % 80 END AS b2 FROM dict)"""


def both(name: str, covers: str, text: str) -> None:
    sql(name, covers, text.replace("{m}", "regexp_matches").replace("{broadcast}", ""), spark_text=text.replace("{m}", "regexp_like").replace("{broadcast}", "/*+ BROADCAST(coded) */"))


def encode_sizes(cased: DataFrame, coded: DataFrame) -> DataFrame:
    """Bytes that each token of (doc_id, pos, tok) takes when words are replaced by their codes."""
    joined = cased.withColumn("word", F.lower("tok")).join(F.broadcast(coded.select("word", "size")), "word", "left")
    marks = F.when(F.col("tok").rlike("^[A-Z]"), 1).otherwise(0)
    return joined.withColumn("bytes", F.coalesce(F.col("size") + marks, F.octet_length("tok")))


both("dict_build", "D1 D8 D10 D11 IO20 M14", f"WITH {DICT} SELECT word, n, rank, size, b0, b1, b2, CASE WHEN size = 1 THEN b0 - 128 WHEN size = 2 THEN 80 + (b0 - 208) * 80 + (b1 - 128) ELSE 3920 + (b0 - 240) * 3840 + (b1 - 208) * 80 + (b2 - 128) END AS decoded_rank, cast(length(word) AS bigint) AS chars, cast(max(length(word)) OVER () AS bigint) AS longest FROM coded")
both("case_tokens", "D2 D3", "SELECT doc_id, count(*) AS tokens, cast(sum(length(tok)) AS bigint) AS chars, count(CASE WHEN {m}(tok, '^[A-Z]{2,}$') THEN 1 END) AS all_caps, count(CASE WHEN {m}(tok, '^[A-Z][a-z]*$') THEN 1 END) AS capitalised, count(CASE WHEN {m}(tok, '^[A-Za-z]') THEN 1 END) AS words FROM cased GROUP BY doc_id")
both("case_marks", "D3", "WITH t AS (SELECT doc_id, pos, tok, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM cased) SELECT doc_id, count(CASE WHEN {m}(tok, '^[A-Z]{2,}$') THEN 1 END) AS caps_marks, count(CASE WHEN {m}(tok, '^[A-Z][a-z]*$') THEN 1 END) AS capital_marks, count(CASE WHEN {m}(tok, '^[A-Z]{2,}$') AND {m}(coalesce(after, ''), '^[a-z]') THEN 1 END) AS end_marks FROM t GROUP BY doc_id")
both("dict_lookup", "D4 J7", f"WITH {DICT}, w AS (SELECT doc_id, pos, tok, lower(tok) AS word FROM cased WHERE {{m}}(tok, '^[A-Za-z]+$')) SELECT {{broadcast}} doc_id, count(*) AS words, count(coded.word) AS found, cast(sum(coalesce(size, 0)) AS bigint) AS code_bytes FROM w LEFT JOIN coded ON w.word = coded.word GROUP BY doc_id")
sql(
    "dict_affix_fallback",
    "D5 J7",
    f"""WITH c AS ({COUNTS.format(m="regexp_matches")}), known AS (SELECT word FROM c WHERE n >= 3), unknown AS (SELECT word FROM c WHERE n < 3 AND length(word) > 7),
    cand AS (SELECT word, 0 AS kind, k, substr(word, length(word) - k + 1, k) AS part FROM (SELECT word, unnest(range(7, length(word))) AS k FROM unknown) UNION ALL SELECT word, 1 AS kind, k, substr(word, 1, k) AS part FROM (SELECT word, unnest(range(7, length(word))) AS k FROM unknown)),
    hit AS (SELECT cand.word, kind, k, part, row_number() OVER (PARTITION BY cand.word ORDER BY kind, k DESC) AS r FROM cand JOIN known ON cand.part = known.word)
    SELECT word, kind, cast(k AS bigint) AS k, part FROM hit WHERE r = 1""",
    spark_text=f"""WITH c AS ({COUNTS.format(m="regexp_like")}), known AS (SELECT word FROM c WHERE n >= 3), unknown AS (SELECT word FROM c WHERE n < 3 AND length(word) > 7),
    cand AS (SELECT word, kind, k, CASE WHEN kind = 0 THEN substr(word, length(word) - k + 1, k) ELSE substr(word, 1, k) END AS part FROM unknown LATERAL VIEW explode(sequence(7, length(word) - 1)) AS k LATERAL VIEW explode(array(0, 1)) AS kind),
    hit AS (SELECT cand.word, min(struct(kind, -k AS minus_k, part)) AS best FROM cand JOIN known ON cand.part = known.word GROUP BY cand.word)
    SELECT word, best.kind AS kind, cast(-best.minus_k AS bigint) AS k, best.part AS part FROM hit""",
)
sql("quote_fold", "D6", "SELECT page_id, md5(replace(html, '&quot;', '&' || chr(8))) AS folded, cast(length(html) - length(replace(html, '&quot;', '&' || chr(8))) AS bigint) AS saved, replace(replace(html, '&quot;', '&' || chr(8)), '&' || chr(8), '&quot;') = html AS round_trip FROM pages")
ESCAPED = "cp IN (6, 7, 8, 12, 64) OR cp >= 128"
sql("escape_sizes", "D7 F13", f"SELECT doc_id, count(*) AS symbols, count(CASE WHEN {ESCAPED} THEN 1 END) AS escaped, cast(sum(CASE WHEN cp < 128 THEN 1 WHEN cp < 2048 THEN 2 WHEN cp < 65536 THEN 3 ELSE 4 END + CASE WHEN cp IN (6, 7, 8, 12, 64) THEN 1 WHEN cp >= 65536 THEN 4 WHEN cp >= 2048 THEN 3 WHEN cp >= 128 THEN 2 ELSE 0 END) AS bigint) AS escaped_bytes FROM symbols GROUP BY doc_id")
TOKENS = f"WITH {DICT}, t AS (SELECT {{broadcast}} doc_id, pos, tok, size, b0, b1, b2, rank FROM cased LEFT JOIN coded ON lower(tok) = coded.word)"
sql(
    "dict_encode_stats",
    "BT7 D8 IO5",
    (TOKENS + " SELECT doc_id, cast(sum(octet_length(encode(tok))) AS bigint) AS raw_bytes, cast(sum(coalesce(size + CASE WHEN {m}(tok, '^[A-Z]') THEN 1 ELSE 0 END, octet_length(encode(tok)))) AS bigint) AS coded_bytes, sum(coalesce(size + CASE WHEN {m}(tok, '^[A-Z]') THEN 1 ELSE 0 END, octet_length(encode(tok)))) <= sum(octet_length(encode(tok))) - 50 AS keep FROM t GROUP BY doc_id").replace("{m}", "regexp_matches").replace("{broadcast}", ""),
    spark_text=(TOKENS + " SELECT doc_id, cast(sum(octet_length(tok)) AS bigint) AS raw_bytes, cast(sum(coalesce(size + CASE WHEN {m}(tok, '^[A-Z]') THEN 1 ELSE 0 END, octet_length(tok))) AS bigint) AS coded_bytes, sum(coalesce(size + CASE WHEN {m}(tok, '^[A-Z]') THEN 1 ELSE 0 END, octet_length(tok))) <= sum(octet_length(tok)) - 50 AS keep FROM t GROUP BY doc_id").replace("{m}", "regexp_like").replace("{broadcast}", "/*+ BROADCAST(coded) */"),
)
REPLAY = """CASE WHEN word IS NULL THEN tok WHEN tok = upper(tok) AND length(tok) > 1 THEN upper(word) WHEN substr(tok, 1, 1) = upper(substr(tok, 1, 1)) THEN upper(substr(word, 1, 1)) || substr(word, 2) ELSE word END"""


def word_of(tok: str, word: str) -> str:
    """What ``REPLAY`` says: a dictionary word in its token's case."""
    if len(tok) > 1 and tok == tok.upper():
        return word.upper()
    return word[0].upper() + word[1:] if tok[0] == tok[0].upper() else word


@lru_cache(1)
def coder(words: tuple[str, ...]) -> Callable[[str], str]:
    """Encodes the words of a text as their ranks in the dictionary, decodes these, and gives the text back as decoded."""
    rank = {w: k for k, w in enumerate(words)}

    def there_and_back(m: re.Match) -> str:
        tok = m[0]
        code = rank.get(tok.lower())
        return tok if code is None else word_of(tok, words[code])

    return lambda text: _CASED_WORD.sub(there_and_back, text)


_CASED_WORD = re.compile("[A-Z]{2,}|[A-Z]?[a-z]+|[A-Z]")  # what is no letter is a piece by itself, and stays


@query(
    "dict_roundtrip",
    "D9 BT8 IO3 IO4",
    f"WITH {DICT.replace('{m}', 'regexp_matches')}, t AS (SELECT doc_id, pos, tok, word FROM cased LEFT JOIN coded ON lower(tok) = coded.word), d AS (SELECT doc_id, string_agg({REPLAY}, '' ORDER BY pos) AS text FROM t GROUP BY doc_id) SELECT d.doc_id, md5(d.text) AS decoded, d.text = documents.text AS same FROM d JOIN documents ON d.doc_id = documents.doc_id",
)
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text through the dictionary and back, whole, where it is read; only the dictionary (44,880 words at most) is sent to the tasks."""
    views(spark, sf_dir, "FROM cased")
    words = tuple(r.word for r in spark.sql(TOP.replace("{m}", "regexp_like")).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = coder(words)
        for b in batches:
            digest, same = [], []
            for text in b.column("text"):
                back = replay(text.as_py())
                digest.append(hashlib.md5(back.encode()).hexdigest())
                same.append(back == text.as_py())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digest, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "decoded", "same"])

    docs = table(spark, sf_dir, "documents").where("doc_id is not null and text <> ''")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, decoded string, same boolean")


@query(
    "codeword_context",
    "D12 M7",
    """WITH s AS (SELECT doc_id, pos, k, b, CASE WHEN b >= 128 THEN 0 ELSE 1 END AS breaks FROM bytes), i AS (SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY pos, k) AS island FROM s),
    r AS (SELECT doc_id, island, count(*) AS n, max(b) AS most FROM i WHERE breaks = 0 GROUP BY doc_id, island) SELECT doc_id, least(n, 3) AS key_bytes, count(*) AS runs, max(most) AS most FROM r GROUP BY doc_id, least(n, 3)""",
)
def codeword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of high bytes by length, found in a block's array."""

    def work(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        of, high, begins = arrays.owner(first), data >= 128, arrays.places(first) == 0
        begins[1:] |= ~high[:-1]
        at = np.flatnonzero(high)
        run = np.cumsum(begins[at]) - 1
        starts = at[begins[at]]
        size, most = np.bincount(run, minlength=len(starts)), np.maximum.reduceat(data[at], np.flatnonzero(begins[at])) if len(at) else np.zeros(0, np.uint8)
        kinds, which = np.unique(of[starts] * 4 + np.minimum(size, 3), return_inverse=True)
        greatest = np.zeros(len(kinds), np.int64)
        np.maximum.at(greatest, which, most)
        return {"doc_id": rows.column("doc_id").take(pa.array(kinds // 4)), "key_bytes": kinds % 4, "runs": np.bincount(which, minlength=len(kinds)), "most": greatest}

    each = arrays.map_bytes(arrays.documents(spark, sf_dir), work, "doc_id bigint, key_bytes bigint, runs bigint, most bigint", "doc_id")
    return each.groupBy("doc_id", "key_bytes").agg(F.sum("runs").alias("runs"), F.max("most").alias("most"))


