"""Grains: documents as symbols, bytes, words, tokens and lines; pages as tags; events as series.

Each grain is a view that queries read.  It is written twice, for Spark and for the
SQL oracle; whatever is said on top of it is the same text in both.  No grain
shuffles: a row is taken apart where it is read.
"""

from __future__ import annotations

#: A vector's value v as a sample, reckoned as floats all through: Spark would widen a float that meets an integer.
SAMPLE = "cast(floor(least(greatest(cast(v AS float) * 64F + 128F, 0F), 255F)) AS bigint)"
#: name -> (Spark SQL, oracle SQL)
GRAINS: dict[str, tuple[str, str]] = {
    "symbols": (
        """SELECT doc_id, cast(pos AS bigint) AS pos, ch, cast(ascii(ch) AS bigint) AS cp
           FROM (SELECT doc_id, posexplode(split(text, '')) AS (pos, ch) FROM documents) WHERE ch <> ''""",
        """SELECT doc_id, pos, ch, cast(unicode(ch) AS bigint) AS cp
           FROM (SELECT doc_id, unnest(l) AS ch, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, '') AS l FROM documents)) WHERE ch <> ''""",
    ),
    "bytes": (
        """SELECT doc_id, pos, k, ch, cast(conv(substr(h, cast(2 * k + 1 AS int), 2), 16, 10) AS bigint) AS b
           FROM (SELECT doc_id, pos, ch, h, explode(sequence(0L, cast(length(h) / 2 - 1 AS bigint))) AS k FROM (SELECT doc_id, pos, ch, hex(encode(ch, 'UTF-8')) AS h FROM symbols))""",
        """SELECT doc_id, pos, k, ch, cast('0x' || substr(h, 2 * k + 1, 2) AS bigint) AS b
           FROM (SELECT doc_id, pos, ch, h, unnest(range(0, length(h) // 2)) AS k FROM (SELECT doc_id, pos, ch, hex(encode(ch)) AS h FROM symbols))""",
    ),
    "words": (
        r"""SELECT doc_id, cast(pos AS bigint) AS pos, word, lower(word) AS lw
           FROM (SELECT doc_id, posexplode(regexp_extract_all(text, "[A-Za-z'\\u0080-\\uffff-]+", 0)) AS (pos, word) FROM documents)""",
        r"""SELECT doc_id, pos, word, lower(word) AS lw
           FROM (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z''\x{80}-\x{ffff}-]+') AS l FROM documents))""",
    ),
    # every character is in one token: words, numbers, spaces, others
    "tokens": (
        r"""SELECT doc_id, cast(pos AS bigint) AS pos, tok,
             CASE WHEN tok RLIKE "^[A-Za-z'\\u0080-\\uffff-]" THEN 'word' WHEN tok RLIKE '^[0-9]' THEN 'number' WHEN tok RLIKE '^[ \\t\\r\\n]' THEN 'space' ELSE 'punct' END AS kind
           FROM (SELECT doc_id, posexplode(regexp_extract_all(text, "[A-Za-z'\\u0080-\\uffff-]+|[0-9]+|[ \\t\\r\\n]+|[^A-Za-z'\\u0080-\\uffff0-9 \\t\\r\\n-]", 0)) AS (pos, tok) FROM documents)""",
        r"""SELECT doc_id, pos, tok,
             CASE WHEN regexp_matches(tok, '^[A-Za-z''\x{80}-\x{ffff}-]') THEN 'word' WHEN regexp_matches(tok, '^[0-9]') THEN 'number' WHEN regexp_matches(tok, '^[ \t\r\n]') THEN 'space' ELSE 'punct' END AS kind
           FROM (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z''\x{80}-\x{ffff}-]+|[0-9]+|[ \t\r\n]+|[^A-Za-z''\x{80}-\x{ffff}0-9 \t\r\n-]') AS l FROM documents))""",
    ),
    # case-aware pieces whose concatenation is the text
    "cased": (
        r"""SELECT doc_id, cast(pos AS bigint) AS pos, tok FROM (SELECT doc_id, posexplode(regexp_extract_all(text, '[A-Z]{2,}|[A-Z]?[a-z]+|[A-Z]|[^A-Za-z]', 0)) AS (pos, tok) FROM documents)""",
        r"""SELECT doc_id, pos, tok FROM (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z]{2,}|[A-Z]?[a-z]+|[A-Z]|[^A-Za-z]') AS l FROM (SELECT doc_id, text FROM documents)))""",
    ),
    "lines": (
        r"""SELECT doc_id, cast(pos AS bigint) AS line_no, line FROM (SELECT doc_id, posexplode(split(text, '\n')) AS (pos, line) FROM documents)""",
        r"""SELECT doc_id, pos AS line_no, line FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))""",
    ),
    "tags": (
        r"""SELECT page_id, cast(pos AS bigint) AS pos, tag, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, tag LIKE '</%' AS is_end,
             lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) IN ('meta', 'br', 'link', 'img', 'input', 'hr') OR tag LIKE '%/>' AS is_void
           FROM (SELECT page_id, posexplode(regexp_extract_all(html, '</?[a-zA-Z][^<>]*>', 0)) AS (pos, tag) FROM pages)""",
        r"""SELECT page_id, pos, tag, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, tag LIKE '</%' AS is_end,
             lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) IN ('meta', 'br', 'link', 'img', 'input', 'hr') OR tag LIKE '%/>' AS is_void
           FROM (SELECT page_id, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][^<>]*>') AS l FROM pages))""",
    ),
    # events of a user in order, as a series and as a categorical stream
    "series": (
        "SELECT user_id, event_id, event_type, value, ts, cast(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS bigint) AS pos FROM events",
        "SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events",
    ),
    # fixed-width records: six bytes of each line item
    "records": (
        """SELECT rid, line, cast(col AS bigint) AS col, cast(b AS bigint) AS b FROM (SELECT rid, line,
             posexplode(array(rid % 256, cast(floor(rid / 256) AS bigint) % 256, l_partkey % 256, l_suppkey % 256, cast(floor(l_quantity) AS bigint) % 256, line % 256)) AS (col, b) FROM
             (SELECT l_orderkey AS rid, l_partkey, l_suppkey, l_quantity, cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS bigint) AS line FROM lineitem))""",
        """SELECT rid, line, col, l[col + 1] AS b FROM (SELECT rid, line, unnest(range(0, 6)) AS col,
             [rid % 256, cast(floor(rid / 256) AS bigint) % 256, l_partkey % 256, l_suppkey % 256, cast(floor(l_quantity) AS bigint) % 256, line % 256] AS l FROM
             (SELECT l_orderkey AS rid, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS line FROM lineitem))""",
    ),
    # vectors as a grid of samples 0..255
    "grid": (
        f"SELECT vec_id AS y, cast(x AS bigint) AS x, {SAMPLE} AS p FROM (SELECT vec_id, posexplode(embedding) AS (x, v) FROM embeddings)",
        "SELECT vec_id AS y, x, cast(least(greatest(floor(cast(v AS FLOAT) * 64 + 128), 0), 255) AS bigint) AS p FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM embeddings)",
    ),
}
NEEDS = {"bytes": ("symbols",)}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
