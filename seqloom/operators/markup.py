"""Structured text: tags and levels, indents, record lengths, columns, markup."""

from __future__ import annotations

from seqloom.plans.registry import sql

sql(
    "tag_depth",
    "S1 M18",
    """WITH d AS (SELECT page_id, pos, name, is_end, sum(CASE WHEN is_void THEN 0 WHEN is_end THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos) AS level FROM tags)
    SELECT name, count(CASE WHEN NOT is_end THEN 1 END) AS opened, count(CASE WHEN is_end THEN 1 END) AS closed, cast(max(level) AS bigint) AS deepest, round(avg(level * 1.0e0), 6) AS mean_level FROM d GROUP BY name""",
)
sql("tag_counts", "S1", "SELECT page_id, count(*) AS tags, count(DISTINCT name) AS names, count(CASE WHEN is_void THEN 1 END) AS voids, count(CASE WHEN tag LIKE '%=%' THEN 1 END) AS with_attributes FROM tags GROUP BY page_id")
sql(
    "tag_attributes",
    "S1 S2 M18",
    "SELECT name, lower(attr) AS attr, count(*) AS n FROM (SELECT name, unnest(regexp_extract_all(tag, '([a-zA-Z-]+)=', 1)) AS attr FROM tags) AS t GROUP BY name, lower(attr)",
    spark_text="SELECT name, lower(attr) AS attr, count(*) AS n FROM (SELECT name, explode(regexp_extract_all(tag, '([a-zA-Z-]+)=', 1)) AS attr FROM tags) AS t GROUP BY name, lower(attr)",
)
sql(
    "indent_step",
    "S3",
    """WITH i AS (SELECT doc_id, line_no, length(line) - length(ltrim(line)) AS indent, line LIKE chr(9) || '%' AS tab FROM lines), d AS (SELECT doc_id, indent, tab, indent - coalesce(lag(indent) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS step FROM i)
    SELECT doc_id, count(*) AS n, cast(max(indent) AS bigint) AS deepest, cast(max(step) AS bigint) AS largest_step, count(CASE WHEN tab THEN 1 END) AS tabs FROM d GROUP BY doc_id""",
)
sql(
    "record_length_inference",
    "S4",
    """WITH s AS (SELECT line * 6 + col AS p, rid, b FROM records), g AS (SELECT rid, b, p - lag(p) OVER (PARTITION BY rid, b ORDER BY p) AS gap FROM s), e AS (SELECT rid, gap, lag(gap) OVER (PARTITION BY rid, b ORDER BY gap) AS before FROM g WHERE gap IS NOT NULL),
    v AS (SELECT rid, gap, count(*) AS votes FROM e WHERE gap = before GROUP BY rid, gap) SELECT gap, count(*) AS records, cast(sum(votes) AS bigint) AS votes FROM v GROUP BY gap""",
)
sql(
    "record_columns",
    "S5 S7 M19",
    """WITH t AS (SELECT rid, line, col, b, lag(b, 1) OVER w AS above, lag(b, 2) OVER w AS above2 FROM records WINDOW w AS (PARTITION BY rid, col ORDER BY line))
    SELECT col, count(*) AS n, count(CASE WHEN b = above THEN 1 END) AS same_above, round(avg(abs(b - above) * 1.0e0), 6) AS mean_step, round(avg(abs(b - (2 * above - above2)) * 1.0e0), 6) AS mean_extrapolated FROM t GROUP BY col""",
)
sql(
    "wide_row_lags",
    "S9",
    "SELECT col, count(*) AS n, count(CASE WHEN b = far THEN 1 END) AS same FROM (SELECT rid, line, col, b, lag(b, 3) OVER (PARTITION BY rid ORDER BY line, col) AS far FROM records) AS t WHERE far IS NOT NULL GROUP BY col",
)
sql(
    "wiki_markup",
    "S8 X22 X24",
    r"""SELECT doc_id, count(CASE WHEN line LIKE '%[[%]]%' THEN 1 END) AS links, count(CASE WHEN line LIKE '%{{%}}%' THEN 1 END) AS templates, count(CASE WHEN line LIKE '=%' THEN 1 END) AS headings, count(CASE WHEN line LIKE '*%' THEN 1 END) AS list_items, count(CASE WHEN line LIKE '%''''%' THEN 1 END) AS emphasis,
      count(CASE WHEN line LIKE '%|%' THEN 1 END) AS table_rows, count(*) AS n FROM lines GROUP BY doc_id""",
    spark_text=r"""SELECT doc_id, count(CASE WHEN line LIKE '%[[%]]%' THEN 1 END) AS links, count(CASE WHEN line LIKE '%{{%}}%' THEN 1 END) AS templates, count(CASE WHEN line LIKE '=%' THEN 1 END) AS headings, count(CASE WHEN line LIKE '*%' THEN 1 END) AS list_items, count(CASE WHEN contains(line, "''") THEN 1 END) AS emphasis,
      count(CASE WHEN line LIKE '%|%' THEN 1 END) AS table_rows, count(*) AS n FROM lines GROUP BY doc_id""",
)
sql("type_mix", "M3", "SELECT source, count(*) AS docs, count(CASE WHEN text LIKE '%|%' THEN 1 END) AS tables, count(CASE WHEN text LIKE '%!!%' THEN 1 END) AS shouting, count(CASE WHEN text LIKE '%###%' THEN 1 END) AS noisy FROM documents GROUP BY source")
