"""Text operators: tokens, sentences, languages, stems, word shapes and types."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.stemming import STEMMERS
from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, views

sql("token_kinds", "T1 T10", "SELECT doc_id, kind, count(*) AS n, cast(sum(length(tok)) AS bigint) AS chars FROM tokens GROUP BY doc_id, kind")
sql("word_counts", "T1 A21 M17", "SELECT lw, count(*) AS n, count(DISTINCT doc_id) AS docs FROM words GROUP BY lw")
ABBREVIATIONS = "('mr', 'mrs', 'dr', 'st', 'jr', 'prof', 'mme', 'm', 'bzw', 'usw', 'z', 'th', 'er')"
SENTENCES = f"""WITH t AS (SELECT doc_id, pos, tok, kind, lag(lower(tok)) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM tokens), e AS (SELECT doc_id, pos, tok, kind, CASE WHEN tok IN ('!', '?') OR (tok = '.' AND coalesce(before, '') NOT IN {ABBREVIATIONS}) THEN 1 ELSE 0 END AS ends FROM t),
  s AS (SELECT doc_id, pos, tok, kind, ends, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM e)"""
# The same from each text's array of tokens: nothing is taken apart into rows.
_TOKENS = r"""regexp_extract_all(text, "[A-Za-z'\\u0080-\\uffff-]+|[0-9]+|[ \\t\\r\\n]+|[^A-Za-z'\\u0080-\\uffff0-9 \\t\\r\\n-]", 0)"""
_SPLIT = f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents), e AS (SELECT doc_id, t, zip_with(t, concat(array(''), slice(t, 1, size(t) - 1)), (x, b) -> x IN ('!', '?') OR (x = '.' AND lower(b) NOT IN {ABBREVIATIONS})) AS e FROM t WHERE size(t) > 0)
  SELECT doc_id, cast(size(filter(e, x -> x)) + CASE WHEN element_at(e, -1) THEN 0 ELSE 1 END AS bigint) AS sentences, cast(size(filter(t, x -> x RLIKE "^[A-Za-z'\\\\u0080-\\\\uffff-]")) AS bigint) AS words,
    cast(size(filter(t, x -> x IN (',', ';', ':'))) AS bigint) AS segments, cast(size(filter(t, x -> x RLIKE '^[ \\\\t\\\\r\\\\n]' AND contains(x, chr(10)))) AS bigint) AS paragraphs FROM e"""
sql(
    "sentence_split",
    "T2 T4 M17",
    SENTENCES + " SELECT doc_id, count(DISTINCT sent) AS sentences, count(CASE WHEN kind = 'word' THEN 1 END) AS words, count(CASE WHEN tok IN (',', ';', ':') THEN 1 END) AS segments, count(CASE WHEN kind = 'space' AND tok LIKE '%' || chr(10) || '%' THEN 1 END) AS paragraphs FROM s GROUP BY doc_id",
    spark_text=_SPLIT,
)
sql("sentence_types", "T3 A23", SENTENCES + ", k AS (SELECT doc_id, sent, max(CASE WHEN ends = 1 THEN tok END) AS mark, count(CASE WHEN kind = 'word' THEN 1 END) AS words FROM s GROUP BY doc_id, sent) SELECT doc_id, CASE WHEN mark = '?' THEN 'interrogative' WHEN mark = '!' THEN 'exclamative' WHEN mark = '.' THEN 'declarative' ELSE 'open' END AS type, count(*) AS n, cast(sum(words) AS bigint) AS words FROM k GROUP BY 1, 2")
sql(
    "lang_id_vs_label",
    "T9 A22",
    """WITH c AS (SELECT words.doc_id, count(CASE WHEN lw IN ('the', 'of', 'and', 'to', 'in', 'is', 'it', 'that') THEN 1 END) AS en, count(CASE WHEN lw IN ('le', 'la', 'de', 'et', 'les', 'des', 'que', 'un') THEN 1 END) AS fr, count(CASE WHEN lw IN ('der', 'die', 'und', 'das', 'den', 'mit', 'von', 'zu') THEN 1 END) AS de, count(CASE WHEN lw IN ('el', 'los', 'las', 'no', 'es', 'se', 'y', 'para') THEN 1 END) AS es FROM words GROUP BY words.doc_id)
    SELECT lang, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en = greatest(en, fr, de, es) THEN 'en' WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS found, count(*) AS docs FROM c JOIN documents ON c.doc_id = documents.doc_id GROUP BY 1, 2""",
)
sql("hyphenation_join", "T12", "SELECT doc_id, cast(length(text) - length(replace(replace(text, '-' || chr(10), ''), '+' || chr(10), '')) AS bigint) AS joined, md5(replace(replace(text, '-' || chr(10), ''), '+' || chr(10), '')) AS digest FROM documents")
sql(
    "word_shape_counts",
    "T18 F13",
    "SELECT regexp_replace(regexp_replace(lw, '[aeiouy]', 'V', 'g'), '[b-df-hj-np-tv-xz]', 'C', 'g') AS shape, count(*) AS n FROM words GROUP BY 1",
    spark_text="SELECT regexp_replace(regexp_replace(lw, '[aeiouy]', 'V'), '[b-df-hj-np-tv-xz]', 'C') AS shape, count(*) AS n FROM words GROUP BY 1",
)
TYPES = "CASE WHEN lw IN ('the', 'a', 'an', 'le', 'la', 'les', 'un', 'une', 'der', 'die', 'das', 'el', 'los', 'las') THEN 'article' WHEN lw IN ('and', 'or', 'but', 'et', 'ou', 'und', 'oder', 'y', 'o') THEN 'conjunction' WHEN lw IN ('of', 'in', 'on', 'to', 'by', 'from', 'with', 'for', 'at', 'de', 'du', 'pour', 'par', 'von', 'mit', 'zu', 'para') THEN 'adposition' WHEN lw IN ('is', 'are', 'was', 'be', 'est', 'sont', 'ist', 'sind', 'es') THEN 'verb' ELSE 'other' END"
sql(
    "noun_after_article",
    "T16 T8b T15 X26",
    f"""WITH t AS (SELECT doc_id, pos, lw, {TYPES} AS type FROM words), l AS (SELECT doc_id, pos, lw, type, lag(type) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t)
    SELECT doc_id, count(CASE WHEN before = 'article' AND type = 'other' THEN 1 END) AS nouns, count(CASE WHEN type = 'article' THEN 1 END) AS articles, count(CASE WHEN type = 'adposition' THEN 1 END) AS adpositions, count(CASE WHEN type = 'conjunction' THEN 1 END) AS conjunctions, count(CASE WHEN type = 'verb' THEN 1 END) AS verbs FROM l GROUP BY doc_id""",
)


@query("number_merge", "T17", "WITH t AS (SELECT doc_id, pos, kind, tok, lag(kind, 1) OVER w AS b1, lag(kind, 2) OVER w AS b2 FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT doc_id, count(CASE WHEN kind = 'number' THEN 1 END) AS numbers, count(CASE WHEN kind = 'number' AND b1 = 'space' AND b2 = 'number' THEN 1 END) AS merged, count(CASE WHEN kind = 'word' AND lower(tok) LIKE '%ly' THEN 1 END) AS adverbs FROM t GROUP BY doc_id")
def number_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, those with only space between them and the number before, and words in -ly: runs of classes in a block's array."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        of, n, begins = arrays.owner(first), np.diff(first), arrays.places(first) == 0
        digit, space = (cp >= 48) & (cp <= 57), np.isin(cp, np.frombuffer(b" \t\r\n", np.uint8))
        low = cp | 32
        word = ((low >= 97) & (low <= 122)) | (cp == 39) | (cp == 45) | ((cp >= 0x80) & (cp <= 0xFFFF))
        kind = np.select([digit, space, word], [1, 2, 3], 0)
        fresh = begins.copy()
        fresh[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 0)  # any other symbol is a token by itself
        starts = np.flatnonzero(fresh)
        k, t = kind[starts], of[starts]
        merged = np.flatnonzero((k[2:] == 1) & (k[1:-1] == 2) & (k[:-2] == 1) & (t[2:] == t[:-2])) + 2
        ends = np.append(starts[1:], len(cp)) - 1 if len(cp) else starts
        inside = np.flatnonzero((k == 3) & (ends > starts))  # of two symbols at least
        ly = inside[((cp[ends[inside]] | 32) == ord("y")) & ((cp[ends[inside] - 1] | 32) == ord("l"))]
        count = lambda at: np.bincount(t[at], minlength=len(n))
        return arrays.per_text(rows, n > 0, numbers=count(k == 1), merged=count(merged), adverbs=count(ly))

    each = arrays.map_symbols(arrays.documents(spark, sf_dir), work, "doc_id bigint, numbers bigint, merged bigint, adverbs bigint", "doc_id")
    return each.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("numbers", "merged", "adverbs")])


sql("text_contexts", "T14 T15", f"WITH t AS (SELECT doc_id, pos, lw, {TYPES} AS type FROM words), l AS (SELECT doc_id, type, lag(type, 1) OVER w AS t1, lag(type, 2) OVER w AS t2 FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) SELECT t2, t1, type, count(*) AS n FROM l WHERE t2 IS NOT NULL GROUP BY t2, t1, type")
sql("turn_sentences", "T2 T3", "SELECT role, count(*) AS turns, cast(sum(length(text) - length(replace(text, '.', ''))) AS bigint) AS stops, cast(sum(length(text) - length(replace(text, '?', ''))) AS bigint) AS questions, round(avg(length(text) * 1.0e0), 6) AS mean_chars FROM conversations GROUP BY role")


def step_1a(word: Column) -> Column:
    """Porter2 step 1a, plurals, as an ordered case."""
    cut = lambda n: F.expr(f"substr(w, 1, length(w) - {n})")
    return (
        F.when(word.endswith("sses"), cut(2))
        .when(word.endswith("ied") | word.endswith("ies"), F.when(F.length(word) > 4, cut(2)).otherwise(cut(1)))
        .when(word.endswith("us") | word.endswith("ss"), word)
        .when(word.rlike("[aeiouy].+s$"), cut(1))
        .otherwise(word)
    )


STEM_1A = "CASE WHEN w LIKE '%sses' THEN substr(w, 1, length(w) - 2) WHEN w LIKE '%ied' OR w LIKE '%ies' THEN CASE WHEN length(w) > 4 THEN substr(w, 1, length(w) - 2) ELSE substr(w, 1, length(w) - 1) END WHEN w LIKE '%us' OR w LIKE '%ss' THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN substr(w, 1, length(w) - 1) ELSE w END"


@query("stem_step_1a", "T5 T5g", f"SELECT w AS word, {STEM_1A} AS stem, n FROM (SELECT lw AS w, count(*) AS n FROM words WHERE regexp_matches(lw, '^[a-z]+$') GROUP BY lw) AS t")
def stem_step_1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "FROM words")
    own = spark.table("words").where("lw RLIKE '^[a-z]+$'").groupBy(F.col("lw").alias("w")).agg(F.count("*").alias("n"))
    return own.select(F.col("w").alias("word"), step_1a(F.col("w")).alias("stem"), "n")


R1 = "length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]', 0))"
sql(
    "stem_regions",
    "T5a T5b T5c T5i",
    f"""SELECT w AS word, cast({R1} AS bigint) AS r1, cast(length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]', 0)) AS bigint) AS r2, {{m}}(w, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywx])$') AS short_end,
      CASE WHEN {{m}}(w, '[^aeiouy]y$') AND length(w) > 2 THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END AS step_1c FROM (SELECT DISTINCT lw AS w FROM words WHERE {{m}}(lw, '^[a-z]+$')) AS t""".replace("{m}", "regexp_matches"),
    spark_text=f"""SELECT w AS word, cast({R1} AS bigint) AS r1, cast(length(regexp_extract(w, '^[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]', 0)) AS bigint) AS r2, {{m}}(w, '(^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywx])$') AS short_end,
      CASE WHEN {{m}}(w, '[^aeiouy]y$') AND length(w) > 2 THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END AS step_1c FROM (SELECT DISTINCT lw AS w FROM words WHERE {{m}}(lw, '^[a-z]+$')) AS t""".replace("{m}", "regexp_like"),
)
SUFFIXES = "(VALUES ('ational', 'ate', 2), ('tional', 'tion', 2), ('ization', 'ize', 2), ('fulness', 'ful', 2), ('ousness', 'ous', 2), ('iveness', 'ive', 2), ('biliti', 'ble', 2), ('ation', 'ate', 2), ('alism', 'al', 2), ('entli', 'ent', 2), ('icate', 'ic', 3), ('alize', 'al', 3), ('ical', 'ic', 3), ('ness', '', 3), ('ful', '', 3), ('ement', '', 4), ('able', '', 4), ('ible', '', 4), ('ance', '', 4), ('ence', '', 4), ('ment', '', 4), ('ism', '', 4), ('ate', '', 4), ('ous', '', 4), ('ive', '', 4), ('ize', '', 4), ('er', '', 4), ('al', '', 4)) AS s(suffix, put, step)"
_LOOKUP = f"""WITH w AS (SELECT DISTINCT lw AS word FROM words WHERE {{m}}(lw, '^[a-z]+$')), h AS (SELECT word, suffix, put, step, row_number() OVER (PARTITION BY word ORDER BY step, length(suffix) DESC) AS r FROM w JOIN {SUFFIXES} ON substr(word, greatest(1, length(word) - length(suffix) + 1)) = suffix AND length(word) > length(suffix) + 2)
SELECT word, suffix, cast(step AS bigint) AS step, substr(word, 1, length(word) - length(suffix)) || put AS stem FROM h WHERE r = 1"""
sql("suffix_lookup", "T5j T5k T5l T5m T6c T7b", _LOOKUP.replace("{m}", "regexp_matches"), spark_text=_LOOKUP.replace("{m}", "regexp_like"))
# The exceptional forms of the published English Snowball stemmer (and below, the beginnings whose first region it sets).
EXCEPTIONS = "(VALUES ('skis', 'ski'), ('skies', 'sky'), ('idly', 'idl'), ('gently', 'gentl'), ('ugly', 'ugli'), ('early', 'earli'), ('only', 'onli'), ('singly', 'singl'), ('sky', 'sky'), ('news', 'news'), ('howe', 'howe'), ('atlas', 'atlas'), ('cosmos', 'cosmos'), ('bias', 'bias'), ('andes', 'andes')) AS e(form, stem)"
# A prefix is learned: two to five letters that a word of at least four letters goes on with, which stands alone too.
_CUTS = " UNION ALL ".join(f"SELECT word, {n} AS len FROM w WHERE length(word) >= {n + 4}" for n in range(2, 6))
sql(
    "word_exceptions",
    "T5n T5d",
    f"""WITH w AS (SELECT lw AS word, count(*) AS n FROM words GROUP BY lw), k AS ({_CUTS}),
    p AS (SELECT k.word, substr(k.word, 1, cast(max(len) AS int)) AS prefix FROM k JOIN w AS rest ON rest.word = substr(k.word, len + 1) GROUP BY k.word),
    c AS (SELECT prefix, count(*) AS carried FROM p GROUP BY prefix)
    SELECT w.word, n, p.prefix, coalesce(carried, 0) AS carried, stem, CASE WHEN substr(w.word, 1, 5) IN ('gener', 'arsen') THEN 5 WHEN substr(w.word, 1, 6) = 'commun' THEN 6 END AS r1
    FROM w LEFT JOIN p ON w.word = p.word LEFT JOIN c ON p.prefix = c.prefix LEFT JOIN {EXCEPTIONS} ON w.word = form""",
)
sql("umlaut_fold", "T7a T7c T6a", "SELECT lw AS word, translate(replace(lw, 'ß', 'ss'), 'äöüàâéèêëîïôûù', 'aouaaeeeeiiouu') AS folded, count(*) AS n FROM words GROUP BY lw")


@query("snowball_stems", "T5 T5e T5f T5h T6 T6b T6d T7 T8 T8a U5")
def snowball_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of the distinct words of each language that has a stemmer."""
    views(spark, sf_dir, "FROM words JOIN documents")
    own = spark.table("words").join(spark.table("documents").select("doc_id", "lang"), "doc_id").where(F.col("lang").isin(*STEMMERS)).groupBy("lang", F.col("lw").alias("word")).agg(F.count("*").alias("n"))

    @F.pandas_udf("string")
    def stem(lang: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([STEMMERS[a](b) for a, b in zip(lang, word)], dtype=object)

    return own.select("lang", "word", "n", stem("lang", "word").alias("stem"))
