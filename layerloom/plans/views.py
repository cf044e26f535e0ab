"""Virtual tables of a code and document repository over the synthetic tables, as DataFrames and as SQL.

Each view is defined twice, once for Spark and once for DuckDB, with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".md", ".txt", ".html", ".pdf", ".cs", ".py")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: package by source, directory by language, suffix by id."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), ext)
    return d.select("doc_id", F.lit("corpus").alias("source"), F.col("source").alias("package"), F.concat(F.col("lang"), F.lit("/"), name).alias("rel"), F.coalesce("text", F.lit("")).alias("content"))


SQL_FILES = """f AS (SELECT doc_id, 'corpus' AS source, source AS package,
  lang || '/' || doc_id || ['.md', '.txt', '.html', '.pdf', '.cs', '.py'][doc_id % 6 + 1] AS rel, coalesce(text, '') AS content, lang AS dir,
  ['.md', '.txt', '.html', '.pdf', '.cs', '.py'][doc_id % 6 + 1] AS ext FROM documents)"""


def current_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for each document: key, fast and content hash."""
    f = files(spark, sf_dir)
    key = F.concat_ws("/", "source", "package", F.col("doc_id").cast("string"))
    return f.select(key.alias("comp_key"), F.md5(F.concat_ws(":", "rel", F.length("content").cast("string"))).alias("source_hash"), F.md5("content").alias("content_hash"), "doc_id", "package")


SQL_CURRENT = SQL_FILES + """,
cur AS (SELECT source || '/' || package || '/' || doc_id AS comp_key, md5(rel || ':' || length(content)) AS source_hash, md5(content) AS content_hash, doc_id, package FROM f)"""


def previous_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run before knew: some components missing, some with other hashes, failed or partial, and some since deleted."""
    c = current_components(spark, sf_dir)
    i = F.col("doc_id")
    status = F.when(i % 13 == 0, "failed").when(i % 13 == 1, "partial").when(i % 13 == 2, "skipped").otherwise("done")
    known = c.where(i % 11 != 0).select(
        "comp_key", status.alias("status"), F.when(i % 17 == 0, "").when(i % 7 < 2, "old").otherwise(F.col("source_hash")).alias("source_hash"),
        F.when(i % 7 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), (i % 1000).alias("tokens_in"), F.when(i % 5 > 0, i % 300).alias("tokens_out"),
    )
    gone = c.where(i % 19 == 0).select(
        F.concat_ws("/", F.lit("corpus"), "package", F.concat(F.lit("gone/"), i.cast("string"))).alias("comp_key"), F.lit("done").alias("status"), F.lit("x").alias("source_hash"), F.lit("x").alias("content_hash"),
        F.lit(1).cast("long").alias("tokens_in"), F.lit(None).cast("long").alias("tokens_out"),
    )
    return known.unionByName(gone)


SQL_META = SQL_CURRENT + """,
meta AS (SELECT comp_key, CASE WHEN doc_id % 13 = 0 THEN 'failed' WHEN doc_id % 13 = 1 THEN 'partial' WHEN doc_id % 13 = 2 THEN 'skipped' ELSE 'done' END AS status,
    CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 7 < 2 THEN 'old' ELSE source_hash END AS source_hash,
    CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash, doc_id % 1000 AS tokens_in, CASE WHEN doc_id % 5 > 0 THEN doc_id % 300 END AS tokens_out
  FROM cur WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'corpus/' || package || '/gone/' || doc_id, 'done', 'x', 'x', 1, NULL FROM cur WHERE doc_id % 19 = 0),
ch AS (SELECT coalesce(c.comp_key, m.comp_key) AS comp_key, CASE WHEN c.comp_key IS NULL THEN 'deleted' WHEN m.comp_key IS NULL THEN 'new'
    WHEN m.status IN ('failed', 'partial') THEN 'failed'
    WHEN m.source_hash <> '' AND (m.source_hash = c.source_hash OR (m.content_hash <> '' AND m.content_hash = c.content_hash)) THEN 'unchanged' ELSE 'changed' END AS change
  FROM cur c FULL JOIN meta m USING (comp_key))"""


def conversation_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown document for each conversation: a title and a heading for each turn."""
    c = table(spark, sf_dir, "conversations")
    turn = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n")
    return c.groupBy("conv_id").agg(F.concat(F.lit("# Conversation "), F.first("conv_id").cast("string"), F.lit("\n"), body).alias("md"))


SQL_CONVERSATIONS = """v AS (SELECT conv_id, '# Conversation ' || conv_id || chr(10) || string_agg('## ' || role || chr(10) || text, chr(10) ORDER BY turn, text) AS md FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS line FROM (SELECT conv_id, string_split(md, chr(10)) AS s FROM v)),
m AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,2}\\s+.+$') THEN length(regexp_extract(line, '^(#{1,2})\\s', 1)) END AS lvl FROM l),
g AS (SELECT *, count(lvl) OVER (PARTITION BY conv_id ORDER BY i) AS sec FROM m),
s AS (SELECT conv_id, min(i)::BIGINT AS line_start, max(i)::BIGINT AS line_end, coalesce(max(lvl), 0)::BIGINT AS level,
    coalesce(max(trim(regexp_extract(line, '^#{1,2}\\s+(.+)$', 1))) FILTER (WHERE lvl IS NOT NULL), CASE WHEN sec = 0 THEN '(preamble)' END) AS heading,
    trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(9) || chr(10) || chr(13)) AS content
  FROM g GROUP BY conv_id, sec),
a AS (SELECT *, regexp_replace(regexp_replace(lower(heading), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '[\\s_]+', '-', 'g') AS raw FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, raw ORDER BY line_start) AS k FROM a)"""


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of runs: one run for each user."""
    return progress_of(table(spark, sf_dir, "events"))


def progress_of(e: DataFrame) -> DataFrame:
    """The same of any table or stream of events."""
    kind = F.element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("event_type"))
    return e.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.coalesce(kind, F.lit("other")).alias("event"), F.get_json_object("props", "$.k").cast("long").alias("idx"),
        F.floor("value").cast("long").alias("tokens"), F.col("event_type").alias("name"),
    )


KINDS = {"signup": "pkg_done", "view": "llm_call", "purchase": "comp_done", "error": "error", "click": "phase_start"}
SQL_PROGRESS = """p AS (SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'signup' THEN 'pkg_done' WHEN 'view' THEN 'llm_call' WHEN 'purchase' THEN 'comp_done'
    WHEN 'error' THEN 'error' WHEN 'click' THEN 'phase_start' ELSE 'other' END AS event, (props::JSON ->> '$.k')::BIGINT AS idx, floor(value)::BIGINT AS tokens, event_type AS name FROM events)"""


def titled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions.html import title_of

    return table(spark, sf_dir, "pages").withColumn("title", title_of(F.col("html")))


def _decoded(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def _stripped(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160))"


SQL_PAGES = f"t AS (SELECT page_id, url, html, {_stripped(_decoded("regexp_extract(html, '<title>(.*?)</title>', 1, 's')"))} AS title FROM pages)"


def sql_markdown(x: str) -> str:
    """The plain HTML conversion of layerloom.functions.html in DuckDB's dialect."""
    chain = [(f"<h{n}[^>]*>(.*?)</h{n}>", "'" + "#" * n + " \\1' || chr(10)") for n in range(1, 7)]
    chain += [
        ("<(?:strong|b)>(.*?)</(?:strong|b)>", "'**\\1**'"), ("<(?:em|i)>(.*?)</(?:em|i)>", "'*\\1*'"), ("<code>(.*?)</code>", "'`\\1`'"),
        ('<a[^>]+href="([^"]*)"[^>]*>(.*?)</a>', "'[\\2](\\1)'"), ("<li[^>]*>(.*?)</li>", "'- \\1' || chr(10)"), ("<br\\s*/?>", "chr(10)"),
        ("<p[^>]*>(.*?)</p>", "'\\1' || chr(10) || chr(10)"), ("<[^>]+>", "''"),
    ]
    for a, b in chain:
        x = f"regexp_replace({x}, '{a}', {b}, 'gs')"
    return f"regexp_replace({_decoded(x)}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
