"""Every registered query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerloom.functions import html as H
from layerloom.functions import markdown as M
from layerloom.functions import paths as P
from layerloom.functions import tokens as T
from layerloom.operators import browse, changes, monitor, packing, scan, sections, summaries
from layerloom.plans import views as V
from layerloom.plans.views import table

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "pack_batches_flagship"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Scans, filters, estimates


@query(f"""WITH RECURSIVE {V.SQL_FILES},
e AS (SELECT package, rel, greatest(1, floor(length(content) / 1.5))::BIGINT AS tokens, row_number() OVER (PARTITION BY package ORDER BY dir, rel) AS n
  FROM f WHERE ext <> '.pdf' AND octet_length(encode(content)) <= 1048576),
r AS (SELECT package, n, tokens, 0::BIGINT AS batch_idx, tokens AS used FROM e WHERE n = 1
  UNION ALL SELECT e.package, e.n, e.tokens, CASE WHEN r.used + e.tokens > 8000 THEN r.batch_idx + 1 ELSE r.batch_idx END, CASE WHEN r.used + e.tokens > 8000 THEN e.tokens ELSE r.used + e.tokens END
  FROM r JOIN e ON e.package = r.package AND e.n = r.n + 1)
SELECT package, batch_idx, count(*)::BIGINT AS n_entries, sum(tokens)::BIGINT AS tokens FROM r GROUP BY package, batch_idx""")
def pack_batches_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files to entries with token estimates to greedy batches."""
    f = scan.included(V.files(spark, sf_dir), P.DOCUMENT_EXTENSIONS + P.CODE_EXTENSIONS, max_bytes=P.MAX_DOCUMENT_BYTES)
    entries = f.select("package", "dir", "rel", T.tokens(F.col("content"), 1.5).alias("tokens"))
    packed = packing.greedy_batches(entries, ["package"], ["dir", "rel"], "tokens")
    return packed.groupBy("package", "batch_idx").agg(F.count(F.lit(1)).alias("n_entries"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {V.SQL_FILES} SELECT source, package, dir AS component, count(*)::BIGINT AS file_count,
  sum(len(string_split(content, chr(10))) - CASE WHEN content = '' OR ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS total_lines,
  sum(octet_length(encode(content)))::BIGINT AS total_bytes FROM f WHERE ext <> '.pdf' GROUP BY ALL""")
def scan_component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.included(V.files(spark, sf_dir), P.DOCUMENT_EXTENSIONS + P.CODE_EXTENSIONS)
    return scan.component_stats(scan.component_of(f))


@query("SELECT doc_id, (len(string_split(coalesce(text, ''), chr(10))) - CASE WHEN coalesce(text, '') = '' OR ends_with(text, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM documents")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.line_count(F.coalesce("text", F.lit(""))).alias("n_lines"))


@query(f"WITH {V.SQL_FILES} SELECT DISTINCT ext FROM f WHERE ext IN ('.md', '.txt', '.html', '.pdf', '.cs', '.py') EXCEPT SELECT '.txt'")
def detected_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.detected_extensions(V.files(spark, sf_dir), ignored=(".txt",))


@query(f"""WITH {V.SQL_FILES}, k AS (SELECT unnest(['.md', '.MD', 'py']) AS raw)
SELECT rel, ext IN ('.md', '.py') AS ignored FROM f""")
def ignored_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffixes as users write them, normalized, against the files."""
    f = scan.with_names(V.files(spark, sf_dir))
    raw = F.array(*[P.normal_extension(F.lit(x)) for x in (".md", "*.MD ", "py", " ")])
    return f.select("rel", F.array_contains(F.array_compact(raw), F.col("ext")).alias("ignored"))


@query(f"""WITH {V.SQL_FILES} SELECT rel FROM f
WHERE NOT (regexp_matches(rel, '^en/.*1.*\\.md$') OR regexp_matches(rel, '^.*/7[0-4]\\.p.$') OR regexp_matches(regexp_extract(rel, '[^/]*$'), '^..\\.txt$') OR rel LIKE 'fr/%.html')""")
def exclude_glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.files(spark, sf_dir).where(~P.matches_any(F.col("rel"), ("en/*1*.md", "*/7[0-4].p?", "??.txt", "fr/*.html"))).select("rel")


@query(f"WITH {V.SQL_FILES} SELECT rel FROM f WHERE octet_length(encode(content)) <= 4000 AND ext IN ('.md', '.cs', '.py')")
def size_capped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.included(V.files(spark, sf_dir), (".md", ".cs", ".py"), max_bytes=4000).select("rel")


@query("""SELECT doc_id, greatest(1, length(t) // 4)::BIGINT AS quick, greatest(1, floor(length(t) / 3.0))::BIGINT AS tokens,
  greatest(n_chars, greatest(1, floor(length(t) / 1.5)))::BIGINT AS effective FROM (SELECT doc_id, n_chars, coalesce(text, '') AS t FROM documents)""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", T.quick_tokens(t).alias("quick"), T.tokens(t).alias("tokens"), T.effective_tokens(F.col("n_chars"), t).alias("effective"))


@query("""SELECT doc_id, least(greatest(floor(n_chars * 0.10::DOUBLE) + 80, 120), 700)::BIGINT AS leaf_limit, greatest(400, floor(n_chars * 0.85::DOUBLE) - 800 - 500)::BIGINT AS code_budget,
  least(24000, greatest(400, floor(n_chars * 0.85::DOUBLE) - 1100))::BIGINT AS auto_budget, greatest(900, least(18 * (doc_id % 100) + 180, 1600))::BIGINT AS package_limit FROM documents""")
def token_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.leaf_limit(n).alias("leaf_limit"), T.code_budget(n, F.lit(500)).alias("code_budget"), T.auto_budget(n, F.lit(24000)).alias("auto_budget"),
        T.package_limit(F.col("doc_id") % 100).alias("package_limit"),
    )


@query("SELECT o_orderkey, least(5.0::DOUBLE * pow(2.0, (o_orderkey % 5)), 30.0::DOUBLE)::DOUBLE AS delay FROM orders")
def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.retry_delay(F.col("o_orderkey") % 5 + 1).alias("delay"))


@query("""WITH d AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part),
x AS (SELECT DISTINCT w[1] AS component, w[2] || CASE WHEN p_partkey % 2 = 0 THEN '/src' ELSE '' END AS path FROM d),
h AS (SELECT DISTINCT component, split_part(path, '/', 1) AS child FROM x WHERE path LIKE '%/src')
SELECT component, child FROM h WHERE component IN (SELECT component FROM h GROUP BY component HAVING count(*) > 1)""")
def subprojects(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.split(F.lower("p_type"), " ")
    dirs = table(spark, sf_dir, "part").select(F.get(w, F.lit(0)).alias("component"), F.concat(F.get(w, F.lit(1)), F.when(F.col("p_partkey") % 2 == 0, "/src").otherwise("")).alias("path")).distinct()
    return scan.subprojects(dirs)


# Hashes and changes


@query(f"""WITH {V.SQL_FILES} SELECT package, md5(string_agg(rel || ':' || (doc_id * 7) || ':' || octet_length(encode(content)), chr(10) ORDER BY string_split(rel, '/'))) AS source_hash FROM f GROUP BY package""")
def fast_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.files(spark, sf_dir).withColumn("mtime", F.col("doc_id") * 7.0).withColumn("size", F.octet_length("content"))
    return changes.fast_hash(f, "package")


@query(f"""WITH {V.SQL_FILES} SELECT package, md5(string_agg(rel || ':' || md5(content), chr(10) ORDER BY string_split(rel, '/'))) AS content_hash FROM f GROUP BY package""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.content_hash(V.files(spark, sf_dir), "package")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.classify(V.current_components(spark, sf_dir), V.previous_meta(spark, sf_dir))


@query(f"WITH {V.SQL_META} SELECT comp_key, change FROM ch")
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir)


@query(f"WITH {V.SQL_META} SELECT comp_key FROM meta EXCEPT SELECT comp_key FROM cur")
def deleted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.previous_meta(spark, sf_dir).select("comp_key").subtract(V.current_components(spark, sf_dir).select("comp_key"))


@query(f"""WITH {V.SQL_META}, d AS (SELECT comp_key, 'corpus/' || split_part(comp_key, '/', 2) || '/gone_' || split_part(comp_key, '/', 4) AS b FROM ch WHERE change = 'deleted')
SELECT comp_key, b || '.md' AS path FROM d UNION ALL SELECT comp_key, b || '/' FROM d""")
def cleanup_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.owned_files(_changes(spark, sf_dir).where("change = 'deleted'").select("comp_key"))


@query(f"""WITH {V.SQL_META}, meta2 AS (SELECT comp_key, status, source_hash, content_hash FROM meta WHERE NOT regexp_matches(split_part(comp_key, '/', 2), '[13579]$')
  UNION ALL SELECT comp_key, 'done', source_hash, content_hash FROM cur WHERE regexp_matches(package, '[13579]$')),
ch2 AS (SELECT coalesce(c.comp_key, m.comp_key) AS comp_key, CASE WHEN c.comp_key IS NOT NULL AND m.comp_key IS NOT NULL AND m.status NOT IN ('failed', 'partial') AND m.source_hash <> ''
    AND (m.source_hash = c.source_hash OR (m.content_hash <> '' AND m.content_hash = c.content_hash)) THEN 'unchanged' ELSE 'other' END AS change FROM cur c FULL JOIN meta2 m USING (comp_key))
SELECT DISTINCT 'corpus/' || split_part(comp_key, '/', 2) AS package_key FROM ch2 WHERE change <> 'unchanged'""")
def dirty_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with a component that is not unchanged; those whose name ends in an odd digit are as the last run left them."""
    current, clean = V.current_components(spark, sf_dir), "rlike(package, '[13579]$')"
    same = current.where(clean).select("comp_key", F.lit("done").alias("status"), "source_hash", "content_hash")
    before = V.previous_meta(spark, sf_dir).where("not rlike(split(comp_key, '/')[1], '[13579]$')").select(*same.columns)
    return changes.dirty_packages(changes.classify(current, before.unionByName(same)))


@query(f"""WITH {V.SQL_META}, r AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY comp_key) AS k FROM ch)
SELECT change, count(*)::BIGINT AS n, string_agg(comp_key, ',' ORDER BY comp_key) FILTER (WHERE k <= 10) AS sample FROM r GROUP BY change""")
def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    r = _changes(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("change").orderBy("comp_key")))
    return r.groupBy("change").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("k") <= 10, F.col("comp_key")))), ",").alias("sample"))


@query(f"""WITH {V.SQL_META}, new AS (SELECT comp_key, 'done' AS status, source_hash FROM cur WHERE doc_id % 3 = 0)
SELECT comp_key, status, source_hash FROM meta WHERE comp_key NOT IN (SELECT comp_key FROM new) UNION ALL SELECT * FROM new""")
def meta_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = V.current_components(spark, sf_dir).where("doc_id % 3 = 0").select("comp_key", F.lit("done").alias("status"), "source_hash")
    return changes.upsert(V.previous_meta(spark, sf_dir).select("comp_key", "status", "source_hash"), new)


@query(f"WITH {V.SQL_META} SELECT sum(coalesce(tokens_in, 0))::BIGINT AS input_tokens, sum(coalesce(tokens_out, 0))::BIGINT AS output_tokens, count(*)::BIGINT AS total_components, count_if(status <> 'failed')::BIGINT AS completed FROM meta")
def meta_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.meta_totals(V.previous_meta(spark, sf_dir))


@query("""WITH s AS (SELECT n_name AS source, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'skipped' ELSE 'done' END AS status FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT source, count(*)::BIGINT AS n, count_if(status = 'failed')::BIGINT AS failed, count_if(status = 'skipped')::BIGINT AS skipped, count_if(status NOT IN ('failed', 'skipped'))::BIGINT AS done FROM s GROUP BY ROLLUP (source)""")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "skipped").otherwise("done")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("source"), status.alias("status"))
    return changes.status_counts(rows)


@query(f"""WITH {V.SQL_FILES} SELECT package, dir AS component, sum(greatest(1, length(content) // 4))::BIGINT AS tokens, CASE WHEN sum(greatest(1, length(content) // 4)) < 5000 THEN 'skipped' ELSE 'kept' END AS status FROM f GROUP BY ALL""")
def skip_below_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.with_names(V.files(spark, sf_dir))
    g = f.groupBy("package", F.col("dir").alias("component")).agg(F.sum(T.quick_tokens(F.col("content"))).alias("tokens"))
    return g.withColumn("status", F.when(F.col("tokens") < 5000, "skipped").otherwise("kept"))


@query(f"""WITH {V.SQL_FILES} SELECT package, dir AS component, CASE WHEN bool_or(length(content) < 60) THEN 'partial' ELSE 'done' END AS status,
  array_to_string(list_sort(list(DISTINCT ext)), ', ') AS languages FROM f GROUP BY ALL""")
def component_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.with_names(V.files(spark, sf_dir))
    return f.groupBy("package", F.col("dir").alias("component")).agg(
        F.when(F.bool_or(F.length("content") < 60), "partial").otherwise("done").alias("status"), F.array_join(F.array_sort(F.collect_set("ext")), ", ").alias("languages")
    )


@query(f"""WITH {V.SQL_FILES} SELECT count(DISTINCT package || '/' || dir)::BIGINT AS components, count(*)::BIGINT AS files, sum(greatest(1, length(content) // 4))::BIGINT AS tokens,
  (count(*) + count(DISTINCT package || '/' || dir) + 20)::BIGINT AS estimated_calls FROM f""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.with_names(V.files(spark, sf_dir))
    per = f.groupBy("package", "dir").agg(F.count(F.lit(1)).alias("n"), F.sum(T.quick_tokens(F.col("content"))).alias("t"))
    return per.agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("files"), F.sum("t").alias("tokens"), (F.sum("n") + F.count(F.lit(1)) + 20).alias("estimated_calls"))


# Sections, images, packing


@query(f"WITH {V.SQL_CONVERSATIONS} SELECT conv_id, line_start, line_end, level, heading, content FROM s WHERE content <> ''")
def parse_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(V.conversation_docs(spark, sf_dir), "conv_id", "md")


@query(f"WITH {V.SQL_CONVERSATIONS} SELECT conv_id, line_start, raw || CASE WHEN k > 1 THEN '-L' || line_start ELSE '' END AS anchor FROM n")
def section_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = sections.sections(V.conversation_docs(spark, sf_dir), "conv_id", "md")
    return sections.with_anchors(parts, "conv_id").select("conv_id", "line_start", "anchor")


@query("SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS content, '(document)' AS heading FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '(^|\\n)#{1,2}\\s+[^\\n]') AND trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) <> ''")
def section_preamble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without headings are one section each."""
    parts = sections.sections(table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text")
    return parts.where("heading = '(document)'").select("doc_id", "content", "heading")


_IMAGES = "'![a ' || doc_id || '](img/' || doc_id || '.png) ![b](./x.gif) ![c](https://h/' || doc_id || '.png) ![d](/root.png) ![e](_images/p.png)'"


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_IMAGES} AS md")


@query("SELECT doc_id, '![a ' || doc_id || '](asset://img/' || doc_id || '.png) ![b](asset://x.gif) ![c](https://h/' || doc_id || '.png) ![d](/root.png) ![e](asset://_images/p.png)' AS referred, '    ' AS dropped FROM documents")
def image_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("doc_id", M.refer_images(F.col("md")).alias("referred"), M.drop_images(F.col("md")).alias("dropped"))


@query("SELECT doc_id, '![a ' || doc_id || '](c/' || doc_id || '/__assets/img/' || doc_id || '.png) ![b](c/' || doc_id || '/__assets/x.gif) ![c](https://h/' || doc_id || '.png) ![d](/root.png) ![e](c/' || doc_id || '/__assets/_images/p.png)' AS md FROM documents")
def asset_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = M.asset_dir(F.concat(F.lit("c/"), F.col("doc_id").cast("string")), F.lit(False))
    return _images(spark, sf_dir).select("doc_id", M.resolve_assets(M.refer_images(F.col("md")), prefix).alias("md"))


@query("SELECT doc_id, '![a ' || doc_id || '](img/' || doc_id || '.png) ![b](./x.gif) ![c](https://h/' || doc_id || '.png) ![d](/root.png) ![e](__assets/' || doc_id || '/_images/p.png)' AS md, true AS changed FROM documents")
def legacy_asset_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = M.asset_dir(F.col("doc_id").cast("string"), F.lit(True))
    made = M.legacy_assets(F.col("md"), prefix)
    return _images(spark, sf_dir).select("doc_id", made.alias("md"), (made != F.col("md")).alias("changed"))


@query("""WITH d AS (SELECT DISTINCT p_brand AS component, replace(lower(p_type), ' ', '/') AS dir FROM part UNION SELECT DISTINCT p_brand, split_part(lower(p_type), ' ', 1) FROM part WHERE p_partkey % 3 = 0),
u AS (SELECT a.component, a.dir, max(b.dir) FILTER (WHERE length(b.dir) = m) AS up FROM (SELECT a.component, a.dir, max(length(b.dir)) AS m FROM d a JOIN d b ON a.component = b.component AND starts_with(a.dir, b.dir || '/') GROUP BY ALL) a
  JOIN d b ON a.component = b.component AND starts_with(a.dir, b.dir || '/') GROUP BY ALL)
SELECT d.component, d.dir, coalesce(u.up, d.dir) AS parent_dir FROM d LEFT JOIN u USING (component, dir)""")
def nearest_parent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    deep = p.select(F.col("p_brand").alias("component"), F.replace(F.lower("p_type"), F.lit(" "), F.lit("/")).alias("dir"))
    top = p.where("p_partkey % 3 = 0").select(F.col("p_brand").alias("component"), F.substring_index(F.lower("p_type"), " ", 1).alias("dir"))
    return scan.nearest_parents(deep.union(top).distinct())


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents WHERE length(coalesce(text, '')) > 900)),
r AS (SELECT doc_id, i, x, 0 AS chunk, length(x) + 1 AS used FROM l WHERE i = 1
  UNION ALL SELECT l.doc_id, l.i, l.x, CASE WHEN r.used + length(l.x) + 1 > 900 THEN r.chunk + 1 ELSE r.chunk END, CASE WHEN r.used + length(l.x) + 1 > 900 THEN length(l.x) + 1 ELSE r.used + length(l.x) + 1 END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
SELECT doc_id AS key, chunk, string_agg(x, chr(10) ORDER BY i) AS content FROM r GROUP BY ALL""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("content"))
    return packing.line_chunks(d.where(F.length("content") > 900), 600)


@query()
def tiny_batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-dependent merging; the tests hold it against a plain loop."""
    return packing.merge_small(pack_batches_flagship(spark, sf_dir), ["package"], 6000, 12000)


@query("""WITH b AS (SELECT conv_id % 50 AS component, row_number() OVER (PARTITION BY conv_id % 50 ORDER BY conv_id, turn) - 1 AS batch_idx, CASE WHEN conv_id % 7 = 0 THEN '' ELSE role || conv_id END AS group_key FROM conversations)
SELECT component, group_key, array_to_string(list(batch_idx ORDER BY batch_idx), ',') AS batch_indices FROM b WHERE group_key <> '' GROUP BY ALL HAVING count(*) > 1""")
def agg_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").withColumn("component", F.col("conv_id") % 50)
    n = F.row_number().over(Window.partitionBy("component").orderBy("conv_id", "turn")) - 1
    b = c.select("component", n.alias("batch_idx"), F.when(F.col("conv_id") % 7 == 0, "").otherwise(F.concat("role", F.col("conv_id").cast("string"))).alias("group_key"))
    return packing.aggregation_groups(b).withColumn("batch_indices", F.array_join("batch_indices", ","))


# HTML


@query(f"WITH {V.SQL_PAGES} SELECT page_id, {V._stripped(V.sql_markdown('html'))} AS md FROM t")
def html_basic_md(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.to_markdown(F.col("html")).alias("md"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<style\\b[^>]*>.*?</style>', '', 'gis'), '<script\\b[^>]*>.*?</script>', '', 'gis'), '<p>(?:\\s|&nbsp;|<br\\s*/?>)*</p>', '', 'gis') AS html FROM pages""")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.clean_storage(F.col("html")).alias("html"))


_LINE = "trim(x, ' ' || chr(9) || chr(13))"
_NOISE_SQL = "(regexp_matches(" + _LINE + ", '[{}]$') OR regexp_matches(" + _LINE + ", '^(font-|color:|span)') OR regexp_matches(" + _LINE + ", '^\\d+%$') OR " + _LINE + " IN ('center', 'count') OR regexp_matches(" + _LINE + ", '^[.#].*\\{'))"


@query(f"""WITH l AS (SELECT page_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS x FROM (SELECT page_id, string_split(replace(html, '>', '>' || chr(10)), chr(10)) AS s FROM pages))
SELECT page_id, count_if({_LINE} <> '' AND {_NOISE_SQL})::BIGINT AS noise, count(*)::BIGINT AS n FROM l GROUP BY page_id""")
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "pages").select("page_id", F.explode(F.split(F.replace("html", F.lit(">"), F.lit(">\n")), "\n", -1)).alias("x"))
    return lines.groupBy("page_id").agg(F.count_if((M.strip(F.col("x")) != "") & H.is_noise(F.col("x"))).alias("noise"), F.count(F.lit(1)).alias("n"))


@query()
def md_postprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful over lines; the tests hold it against a plain loop."""
    return table(spark, sf_dir, "pages").select("page_id", H.postprocess(H.to_markdown(F.col("html"))).alias("md"))


@query(f"""WITH {V.SQL_PAGES}, m AS (SELECT page_id, title, list_filter(list_transform(string_split({V._stripped(V.sql_markdown('html'))}, chr(10)), lambda x: {V._stripped('x')}), lambda x: x <> '' AND x <> '# ' || title AND NOT starts_with(x, '*(') AND x <> '---') AS l FROM t)
SELECT page_id, title, len(l) >= 3 AND length(array_to_string(l, '')) >= 40 AS substantive FROM m""")
def substantive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.titled_pages(spark, sf_dir).select("page_id", "title", H.substantive(H.to_markdown(F.col("html")), F.col("title")).alias("substantive"))


@query()
def nav_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and headings of every page as a navigation page; golden cases are in the tests."""
    return V.titled_pages(spark, sf_dir).select("page_id", H.navigation(F.col("html"), F.col("title")).alias("md"))


@query()
def html_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of the cleaned, the plain and the navigation conversion that has substance."""
    p = V.titled_pages(spark, sf_dir).withColumn("_c", H.postprocess(H.to_markdown(H.clean_storage(F.col("html")), F.col("title")))).withColumn("_b", H.to_markdown(F.col("html"), F.col("title")))
    t = F.col("title")
    md = F.when(H.substantive(F.col("_c"), t), F.col("_c")).when(H.substantive(F.col("_b"), t), F.col("_b")).otherwise(H.navigation(F.col("html"), t))
    return p.select("page_id", md.alias("md"))


@query("""SELECT page_id, regexp_extract(url, '^(\\w+)://', 1) AS scheme, regexp_extract(url, '^\\w+://([^/?#]*)', 1) AS host, regexp_extract(url, '^\\w+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages""")
def url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"), F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"),
        F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"),
    )


@query(f"""WITH {V.SQL_PAGES} SELECT page_id, left(regexp_replace(regexp_replace(title, '[<>:"/\\\\|?*]', '_', 'g'), '\\s+', '_', 'g'), 200) AS file_name,
  CASE WHEN trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') = '' THEN 'source' ELSE trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') END AS source_name FROM t""")
def sanitize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.titled_pages(spark, sf_dir).select("page_id", P.safe_name(F.col("title")).alias("file_name"), P.source_name(F.col("title")).alias("source_name"))


@query(f"""WITH {V.SQL_PAGES}, m AS (SELECT page_id, title, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS a FROM (SELECT page_id, title, regexp_extract_all(html, '<a\\b[^>]*href="[^"]+"[^>]*>.*?</a>', 0, 'is') AS a FROM t)),
k AS (SELECT page_id, title, i, {V._stripped(V._decoded("regexp_replace(regexp_extract(a, '<a[^>]*>(.*?)</a>', 1, 'is'), '<[^>]+>', '', 'g')"))} AS l, {V._stripped(V._decoded("regexp_extract(a, 'href=" + chr(34) + "([^" + chr(34) + "]+)" + chr(34) + "', 1, 'i')"))} AS h FROM m),
d AS (SELECT page_id, '- [' || l || '](' || h || ')' AS link, min(i) AS i FROM k WHERE l <> '' AND length(l) <= 200 AND lower(l) <> lower(title) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM d)
SELECT page_id, string_agg(link, chr(10) ORDER BY n) AS links FROM r WHERE n <= 60 GROUP BY page_id""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = V.titled_pages(spark, sf_dir).select("page_id", F.array_join(H.links(F.col("html"), F.col("title")), "\n").alias("links"))
    return found.where("links <> ''")


# Summaries


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a package's files by the last digit of their ids, keys in order."""
    f = V.files(spark, sf_dir).withColumn("batch_idx", F.col("doc_id") % 3)
    entries = f.select(F.col("package").alias("component"), F.col("doc_id").alias("entry_key"), "rel", F.col("content").alias("text"))
    batches = f.groupBy(F.col("package").alias("component"), "batch_idx").agg(F.array_sort(F.collect_list("doc_id")).alias("entry_keys"))
    return summaries.batch_contents(batches, entries)


_CONTENTS = V.SQL_FILES + """,
bc AS (SELECT package AS component, doc_id % 3 AS batch_idx, string_agg('// --- ' || rel || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY doc_id) AS content FROM f GROUP BY ALL),
mp AS (SELECT package AS component, doc_id % 3 AS batch_idx, list(rel ORDER BY doc_id) AS paths FROM f GROUP BY ALL),
fs AS (SELECT component, batch_idx, '## Responsibility' || chr(10) || 'Nothing could be summarized from this excerpt.' || chr(10) || chr(10) || '## Key Types and Relationships' || chr(10) || 'Nothing could be summarized from this excerpt.' || chr(10) || chr(10)
  || '## Source Files' || chr(10) || array_to_string(list_transform(paths[1:12], lambda p: '- ' || p), chr(10)) || chr(10) || chr(10) || '## Dependencies' || chr(10) || 'Nothing could be summarized from this excerpt.' AS summary FROM mp),
fr AS (SELECT component, string_agg('### Fragment ' || (batch_idx + 1) || chr(10) || summary, chr(10) || chr(10) ORDER BY batch_idx) AS text FROM fs GROUP BY component)"""


@query(f"WITH {_CONTENTS} SELECT component, batch_idx, content FROM bc")
def batch_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir)


@query(f"WITH {_CONTENTS} SELECT component, batch_idx, array_to_string(paths, ',') AS paths FROM mp")
def marked_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contents(spark, sf_dir).select("component", "batch_idx", F.array_join(M.marked_paths(F.col("content")), ",").alias("paths"))


@query(f"WITH {_CONTENTS} SELECT component, batch_idx, summary FROM fs")
def fallback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.leaves(_contents(spark, sf_dir)).select("component", "batch_idx", "summary")


@query(f"WITH {_CONTENTS} SELECT component, text FROM fr WHERE component IN (SELECT component FROM fs GROUP BY 1 HAVING count(*) > 1) OR true")
def fragment_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.fragments(summaries.leaves(_contents(spark, sf_dir)), ["component"])


@query(f"""WITH {V.SQL_FILES}, p AS (SELECT package, dir, count(*) AS n, max(content) AS t FROM f GROUP BY ALL)
SELECT package, string_agg('### ' || dir || ' (' || n || ' files)' || chr(10) || t, chr(10) || chr(10) ORDER BY dir) AS text FROM p GROUP BY package""")
def package_overview_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.with_names(V.files(spark, sf_dir))
    p = f.groupBy("package", "dir").agg(F.count(F.lit(1)).alias("n"), F.max("content").alias("t"))
    return summaries.overview_input(p, ["package"], "dir", "t", F.concat(F.col("n").cast("string"), F.lit(" files")))


@query("""SELECT r_name AS source, string_agg('### ' || n_name || chr(10) || lower(n_name), chr(10) || chr(10) ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def component_overview_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return summaries.overview_input(n.select(F.col("r_name").alias("source"), "n_name", F.lower("n_name").alias("t")), ["source"], "n_name", "t")


@query("""SELECT string_agg('### ' || n_name || ' (source: ' || r_name || ')' || chr(10) || lower(n_name), chr(10) || chr(10) ORDER BY n_name) AS text FROM nation JOIN region ON n_regionkey = r_regionkey""")
def index_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return summaries.overview_input(n.withColumn("t", F.lower("n_name")), [], "n_name", "t", F.concat(F.lit("source: "), "r_name"))


@query("""SELECT c_custkey, '[' || n_name || '](' || r_name || '/' || n_name || '.md) and [' || r_name || '/' || n_name || '](' || r_name || '/' || n_name || '.md) or [else](x.md)' AS md
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def index_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.concat_ws("/", "r_name", "n_name")
    text = F.concat(F.lit("["), "n_name", F.lit("](old/where.md) and ["), key, F.lit("](b.md) or [else](x.md)"))
    return j.select("c_custkey", M.index_links(text, F.array(key)).alias("md"))


@query("""WITH s AS (SELECT doc_id, '## A' || chr(10) || coalesce(text, '') || chr(10) || '### B' || chr(10) || left(coalesce(text, ''), 900) AS t FROM documents),
x AS (SELECT doc_id, t, '## A' || chr(10) || coalesce(text, '') AS a, '### B' || chr(10) || left(coalesce(text, ''), 900) AS b FROM s JOIN documents USING (doc_id))
SELECT doc_id, CASE WHEN greatest(1, floor(length(t) / 3.0)) <= 400 THEN t ELSE '*[1 section(s) omitted]*' || chr(10) || chr(10) || trim(b, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) END AS kept FROM x""")
def suffix_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    md = F.concat(F.lit("## A\n"), t, F.lit("\n### B\n"), F.substring(t, 1, 900))
    return table(spark, sf_dir, "documents").select("doc_id", M.keep_last_sections(md, 400).alias("kept"))


@query("""SELECT doc_id, CASE WHEN greatest(1, floor(length(t) / 3.0)) <= 300 THEN t ELSE '*[truncated to fit context]*' || chr(10) || chr(10) || right(t, 870) END AS kept FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def tail_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", M.keep_tail(F.coalesce("text", F.lit("")), 300).alias("kept"))


_HEADS = "'## Responsibility' || chr(10) || '## Key Types and Relationships' || chr(10) || '## Source Files' || chr(10) || CASE WHEN doc_id % 3 > 0 THEN '## Dependencies' || chr(10) ELSE '' END"


@query(f"""SELECT doc_id, t = '' OR NOT contains(t, '## Dependencies') OR regexp_matches(t, '[`(\\[:-]$') OR (length(t) - length(replace(t, '`', ''))) % 2 = 1 AS truncated FROM
(SELECT doc_id, rtrim({_HEADS} || coalesce(text, '') || CASE WHEN doc_id % 7 = 0 THEN '`' WHEN doc_id % 7 = 1 THEN ' (' ELSE '' END, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS t FROM documents)""")
def truncated_summary_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = F.when(F.col("doc_id") % 7 == 0, "`").when(F.col("doc_id") % 7 == 1, " (").otherwise("")
    t = F.concat(F.lit("## Responsibility\n## Key Types and Relationships\n## Source Files\n"), F.when(F.col("doc_id") % 3 > 0, "## Dependencies\n").otherwise(""), F.coalesce("text", F.lit("")), tail)
    return table(spark, sf_dir, "documents").select("doc_id", M.looks_truncated(t, M.CODE_HEADINGS).alias("truncated"))


# Writing and reading a knowledge base


def _kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files (path, content) of a knowledge base: an overview for each supplier of a nation and leaves for some customers."""
    s, n, c = (table(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    over = s.where("s_suppkey % 5 > 0").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.lit("/S"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", "s_name", F.lit("BUILDING supplies")).alias("content"))
    leaf = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("n_name", F.lit("/S"), (F.col("c_custkey") % 10).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "/core").otherwise("/interface"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"), F.concat_ws("\n", "c_name", "c_mktsegment").alias("content"))
    return over.unionByName(leaf)


_KB = """kb AS (SELECT n_name || '/S' || s_suppkey || '.md' AS path, s_name || chr(10) || 'BUILDING supplies' AS content FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 > 0
  UNION ALL SELECT n_name || '/S' || (c_custkey % 10) || CASE WHEN c_custkey % 2 = 0 THEN '/core' ELSE '/interface' END || c_custkey || '.md', c_name || chr(10) || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT split_part(path, '/', 1) AS package, replace(split_part(path, '/', 2), '.md', '') AS component, true AS o FROM kb WHERE len(string_split(path, '/')) = 2),
lv AS (SELECT split_part(path, '/', 1) AS package, split_part(path, '/', 2) AS component, list(replace(split_part(path, '/', 3), '.md', '') ORDER BY replace(split_part(path, '/', 3), '.md', '')) AS l FROM kb WHERE len(string_split(path, '/')) = 3 GROUP BY 1, 2),
nav AS (SELECT coalesce(o.package, lv.package) AS package, coalesce(o.component, lv.component) AS component, coalesce(o, false) AS has_overview, coalesce(l, []) AS leaves FROM o FULL JOIN lv ON o.package = lv.package AND o.component = lv.component)"""


@query(f"WITH {_KB} SELECT package, component, has_overview, array_to_string(leaves, ',') AS leaves FROM nav")
def nav_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.navigation(_kb(spark, sf_dir)).withColumn("leaves", F.array_join("leaves", ","))


@query(f"WITH {_KB} SELECT package, sum(len(leaves) + has_overview::INT)::BIGINT AS n_files, count(*)::BIGINT AS n_components FROM nav GROUP BY package")
def browse_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.browse(_kb(spark, sf_dir))


@query(f"""WITH {_KB} SELECT path, CASE WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'interface|declaration|api') THEN 1 WHEN regexp_matches(lower(regexp_extract(path, '[^/]*$')), 'core|impl') THEN 2
  WHEN lower(regexp_extract(path, '[^/]*$')) = 'building.md' THEN 3 ELSE 4 END AS rank FROM kb WHERE contains(content, 'BUILDING')""")
def symbol_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.symbol_search(_kb(spark, sf_dir), "BUILDING")


@query("""WITH d AS (SELECT n_name || '/' || CASE WHEN s_suppkey % 3 = 0 THEN '_meta.json' WHEN s_suppkey % 3 = 1 THEN 'INDEX.md' ELSE 'x.md' END AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT split_part(path, '/', 1) AS dir FROM d GROUP BY 1 HAVING bool_or(path LIKE '%/_meta.json') AND bool_or(path LIKE '%/INDEX.md')""")
def kb_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    i = F.col("s_suppkey") % 3
    return browse.knowledge_bases(j.select(F.concat("n_name", F.lit("/"), F.when(i == 0, "_meta.json").when(i == 1, "INDEX.md").otherwise("x.md")).alias("path"), F.lit("").alias("content")))


@query("""SELECT name, root_idx, path FROM (SELECT c_mktsegment AS name, c_nationkey AS root_idx, c_name AS path, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey, c_name) AS n FROM customer) WHERE n = 1""")
def duplicate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.first_roots(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("root_idx"), F.col("c_name").alias("path")))


@query(f"WITH {V.SQL_CONVERSATIONS} SELECT conv_id, content FROM s WHERE heading = 'user' AND content <> ''")
def relationship_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse.relationships(sections.sections(V.conversation_docs(spark, sf_dir), "conv_id", "md"), "conv_id", "user")


@query(f"""WITH {V.SQL_FILES}, r AS (SELECT source || '/' || package || '/' || replace(lang, '/', '_') AS base, n, b, doc_text FROM (SELECT 'corpus' AS source, source AS package, lang || '/x' AS lang, count(*) AS n, count(*) % 3 AS b, min(doc_id)::VARCHAR AS doc_text FROM documents GROUP BY source, lang))
SELECT base || '.md' AS path, 'o' || doc_text AS content FROM r UNION ALL SELECT base || '/a_' || doc_text || '.md', doc_text FROM r WHERE NOT (b <= 1 AND n < 10)""")
def leaf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("file_count"), F.min("doc_id").cast("string").alias("d"))
    results = g.select(
        F.lit("corpus").alias("source"), F.col("source").alias("package"), F.concat("lang", F.lit("/x")).alias("component"), "file_count", (F.col("file_count") % 3).alias("batch_count"),
        F.concat(F.lit("o"), "d").alias("overview"), F.create_map(F.concat(F.lit("a/"), "d"), F.col("d"), F.lit("blank"), F.lit(" \n")).alias("leaves"),
    )
    return summaries.component_files(results)


_STRIP = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(f"""SELECT doc_id, CASE WHEN {_STRIP} = '' THEN 'sum' WHEN doc_id % 2 = 0 THEN 'sum' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Original Content' || chr(10) || chr(10) || text
  ELSE 'sum' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Complete API Signatures' || chr(10) || chr(10) || '```cpp' || chr(10) || text || chr(10) || '```' END AS page, 'sum' AS summary FROM documents""")
def append_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(F.col("doc_id") % 2 == 0, "markdown").otherwise("cpp")
    made = table(spark, sf_dir, "documents").select("doc_id", M.append_original(F.lit("sum"), F.coalesce("text", F.lit("")), lang).alias("page"))
    return made.withColumn("summary", M.summary_part(F.col("page")))


@query(f"""WITH {V.SQL_META}, r AS (SELECT comp_key, coalesce(CASE WHEN doc_id % 4 = 0 THEN 'fresh ' || doc_id END, CASE WHEN doc_id % 4 = 1 THEN 'disk ' || doc_id END, CASE status WHEN 'failed' THEN '*Generation failed.*' WHEN 'skipped' THEN '*Skipped.*' END) AS text
  FROM cur LEFT JOIN (SELECT comp_key, status FROM meta) USING (comp_key)) SELECT comp_key, text FROM r WHERE text IS NOT NULL""")
def component_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.current_components(spark, sf_dir)
    texts = lambda r, w: c.where(F.col("doc_id") % 4 == r).select("comp_key", F.concat(F.lit(w), F.col("doc_id").cast("string")).alias("text"))
    return summaries.with_kept_texts(c, texts(0, "fresh "), texts(1, "disk "), V.previous_meta(spark, sf_dir))


# Runs


@query(f"""WITH {V.SQL_PROGRESS} SELECT run, max_by(name, seq) FILTER (WHERE event = 'phase_start') AS phase, coalesce(max(idx) FILTER (WHERE event = 'comp_done'), 0)::BIGINT AS done,
  coalesce(sum(tokens) FILTER (WHERE event = 'comp_done'), 0)::BIGINT AS tokens, count_if(event = 'llm_call')::BIGINT AS llm_calls, count_if(event = 'pkg_done')::BIGINT AS packages,
  count_if(event = 'error')::BIGINT AS errors, false AS finished, max(seq) AS last_seq FROM p GROUP BY run""")
def monitor_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.run_state(V.progress(spark, sf_dir), ["run"])


@query(f"WITH {V.SQL_PROGRESS} SELECT run, seq, event FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS n FROM p) WHERE n <= 8")
def event_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitor.tail(V.progress(spark, sf_dir), 8, "run").select("run", "seq", "event")


@query("""SELECT o_orderkey, (o_orderkey % 97) * 100 // 97 AS percent, CASE WHEN o_orderkey % 97 > 0 THEN round((97 - o_orderkey % 97) * floor(o_totalprice)::BIGINT / (o_orderkey % 97)::DOUBLE, 3) END AS eta,
  CASE WHEN floor(o_totalprice) >= 3600 THEN printf('%dh %02dm %02ds', floor(o_totalprice)::BIGINT // 3600, floor(o_totalprice)::BIGINT % 3600 // 60, floor(o_totalprice)::BIGINT % 60)
  ELSE printf('%dm %02ds', floor(o_totalprice)::BIGINT // 60, floor(o_totalprice)::BIGINT % 60) END AS elapsed FROM orders""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, s = F.col("o_orderkey") % 97, F.floor("o_totalprice").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.floor(d * 100 / 97).cast("long").alias("percent"), F.round(T.remaining(d, F.lit(97), s), 3).alias("eta"), T.elapsed(s).alias("elapsed"))


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE value > 0),
r AS (SELECT user_id, n, value::DOUBLE AS ema FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, r.ema * 0.7::DOUBLE + e.value * 0.3::DOUBLE FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, round(max_by(ema, n), 4) AS cpt FROM r GROUP BY user_id""")
def calibrated_cpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("v"))
    return e.select("user_id", F.round(T.calibrated(F.col("v")), 4).alias("cpt")).where("cpt IS NOT NULL")


@query("SELECT s_nationkey, count(*)::BIGINT AS file_count FROM supplier GROUP BY 1 ORDER BY file_count DESC, s_nationkey LIMIT 10")
def top_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("file_count")).orderBy(F.desc("file_count"), "s_nationkey").limit(10)


@query("""WITH f AS (SELECT p_brand AS component, replace(p_name, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN '.h' ELSE '.cpp' END AS rel, lower(replace(p_name, ' ', '_')) AS stem, p_partkey % 2 = 0 AS head FROM part)
SELECT component, rel, EXISTS (SELECT 1 FROM f h WHERE h.head AND h.component = f.component AND h.stem = f.stem) AS is_supplementary FROM f WHERE NOT head""")
def header_impl_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rel = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 2 == 0, ".h").otherwise(".cpp"))
    return scan.header_matches(p.select(F.col("p_brand").alias("component"), rel.alias("rel")))


@query("""WITH RECURSIVE t AS (SELECT page_id, page_id AS root_id, 0 AS depth FROM pages WHERE page_id < 4
  UNION ALL SELECT p.page_id, t.root_id, t.depth + 1 FROM t JOIN pages p ON p.page_id >= 4 AND p.page_id // 4 = t.page_id WHERE t.depth < 10) SELECT page_id, root_id, depth FROM t""")
def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") >= 4, F.floor(F.col("page_id") / 4)).cast("long").alias("parent_id"))
    return scan.page_tree(p)


@query("""SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'stale' WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS state FROM pages""")
def stale_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled pages against the crawl before, by id and version."""
    p = table(spark, sf_dir, "pages").select("page_id")
    now = p.where("page_id % 9 <> 0").select("page_id", F.lit(2).alias("version"))
    old = p.where("page_id % 9 = 0 OR page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, 1).otherwise(2).alias("old"))
    state = F.when(F.col("version").isNull(), "stale").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("version"), "unchanged").otherwise("changed")
    return now.join(old, "page_id", "full_outer").select("page_id", state.alias("state"))


# Code, routing, streams


#: Rows of part whose four files a task parses: few bytes, but much work, so the scan's own tasks would be too large.
PARTS_A_TASK = 2500


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file in each language for each part, spread over tasks before texts are made."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    p = parts.repartition(max(1, -(-parts.count() // PARTS_A_TASK))).select("p_partkey", F.initcap(F.regexp_replace("p_name", "[^a-zA-Z0-9]", "")).alias("n"), F.col("p_brand").alias("component"))
    n = F.col("n")
    texts = F.array(
        F.struct(F.lit(".py").alias("e"), F.concat(F.lit("import os\nclass "), n, F.lit("(Base):\n    size: int = 1\n    def run(self, x: int) -> int:\n        return x\n    def _hide(self): pass\n")).alias("t")),
        F.struct(F.lit(".cs").alias("e"), F.concat(F.lit("using System;\nnamespace A.B {\n  public class "), n, F.lit(" : Base {\n    private int x;\n    public int Twice(int y) { return 2 * y; }\n    public int Size { get; set; }\n  }\n}\n")).alias("t")),
        F.struct(F.lit(".h").alias("e"), F.concat(F.lit('#include "a.h"\n#include <vector>\nnamespace q {\nclass '), n, F.lit(" {\npublic:\n  int size() const;\nprivate:\n  int hidden(int);\n};\n}\n")).alias("t")),
        F.struct(F.lit(".ts").alias("e"), F.concat(F.lit("import {a} from './a';\nexport class "), n, F.lit(" {\n  private x = 1;\n  run(y: number): number { return y; }\n}\n")).alias("t")),
    )
    return p.select("component", F.explode(texts).alias("s"), "p_partkey").select("component", F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.col("s.e")).alias("rel"), F.col("s.t").alias("content"))


_SKELETON = """n AS (SELECT p_brand AS component, p_partkey, upper(left(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g'), 1)) || lower(substr(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g'), 2)) AS n FROM part)
SELECT component, 'f' || p_partkey || '.py' AS rel, 'python' AS language, 'import os' || chr(10) || 'class ' || n || '(Base):' || chr(10) || '    size: int = 1' || chr(10) || '    def run(self, x: int) -> int: ...' AS skeleton FROM n
UNION ALL SELECT component, 'f' || p_partkey || '.cs', 'csharp', 'using System;' || chr(10) || 'namespace A.B {' || chr(10) || '    public class ' || n || ' : Base {' || chr(10) || '        public int Twice(int y);' || chr(10) || '        public int Size { get; set; }' || chr(10) || '    }' || chr(10) || '}' FROM n
UNION ALL SELECT component, 'f' || p_partkey || '.h', 'cpp', '#include "a.h"' || chr(10) || 'namespace q {' || chr(10) || 'class ' || n || ' {' || chr(10) || '    public:' || chr(10) || '    int size() const;' || chr(10) || '};' || chr(10) || '}' FROM n
UNION ALL SELECT component, 'f' || p_partkey || '.ts', 'typescript', 'import {a} from ''./a'';' || chr(10) || 'export class ' || n || ' {' || chr(10) || '    run(y: number): number;' || chr(10) || '}' FROM n"""


@query(f"WITH {_SKELETON}")
def code_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions import skeletons

    return skeletons.extract(_sources(spark, sf_dir)).select("component", "rel", "language", "skeleton")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'openai/m' || c_custkey WHEN c_custkey % 4 = 1 THEN 'azure/m' || c_custkey WHEN c_custkey % 4 = 2 THEN 'openai/org/m' || c_custkey ELSE 'own/m' || c_custkey END AS model, c_custkey % 4 <> 1 AS inferred FROM customer""")
def model_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions.routing import routed

    k = F.col("c_custkey")
    name = F.when(k % 4 == 1, F.concat(F.lit("azure/m"), k.cast("string"))).when(k % 4 == 2, F.concat(F.lit("org/m"), k.cast("string"))).otherwise(F.concat(F.lit("m"), k.cast("string")))
    got = routed(name, F.lit("http://host"), F.when(k % 4 == 3, "own"))
    return table(spark, sf_dir, "customer").select("c_custkey", got["model"].alias("model"), got["inferred"].alias("inferred"))


@query("""SELECT event_id, event_type IN ('click', 'view') AS retryable, event_type = 'error' AS overflow FROM events""")
def retryable_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions.routing import overflows, retryable

    kind = F.col("event_type")
    message = F.when(kind == "click", "Request TIMED OUT (timeout)").when(kind == "view", "HTTP 429: rate_limit reached").when(kind == "error", "maximum context length is 4096 tokens").otherwise("bad key")
    return table(spark, sf_dir, "events").select("event_id", retryable(message).alias("retryable"), overflows(message).alias("overflow"))


@query("""WITH n AS (SELECT c_custkey, lower(c_mktsegment) AS base, row_number() OVER (PARTITION BY lower(c_mktsegment) ORDER BY c_custkey) AS k FROM customer)
SELECT c_custkey, base || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS name FROM n""")
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of sources, the second and later of one name numbered."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").select("c_custkey", P.source_name(F.col("c_mktsegment")).alias("base"))
    k = F.row_number().over(Window.partitionBy("base").orderBy("c_custkey"))
    return c.withColumn("k", k).select("c_custkey", F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("-"), F.col("k").cast("string"))).otherwise("")).alias("name"))


@query("""SELECT p_partkey, p_partkey % 5 IN (0, 3) AS python_private, p_partkey % 3 <> 1 AS csharp_visible, p_partkey % 2 = 0 AS member, p_partkey % 4 = 1 AS project_include FROM part""")
def visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions import routing as R

    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("_a", "a", "__a__", "__b", "a_"))), (k % 5 + 1).cast("int"))
    modifiers = F.when(k % 3 == 0, F.array(F.lit("public"))).when(k % 3 == 1, F.array(F.lit("private"))).otherwise(F.array(F.lit("private"), F.lit("protected")))
    sig = F.when(k % 2 == 0, "int A::f(B::C x)").otherwise("int f(B::C x)")
    line = F.when(k % 4 == 1, '  # include "a.h"').otherwise("#include <a.h>")
    return table(spark, sf_dir, "part").select("p_partkey", R.python_private(name).alias("python_private"), R.csharp_visible(modifiers).alias("csharp_visible"), R.member_function(sig).alias("member"), R.project_include(line).alias("project_include"))


@query(ORACLE_SQL["monitor_state"])
def stream_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of all runs, folded from the event table as a stream."""
    from layerloom.streaming import runs

    e = runs.parquet_stream(spark, sf_dir, "events.parquet")
    out = runs.shared_folder(spark, "runs")
    runs.follow_runs(V.progress_of(e), f"{out}/state", f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/state")


@query("SELECT page_id AS comp_key, md5(html) AS source_hash FROM pages")
def incremental_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as snapshots, merged into a metadata table batch by batch."""
    from layerloom.streaming import runs

    pages = runs.parquet_stream(spark, sf_dir, "pages.parquet").select(F.col("page_id").alias("comp_key"), F.md5("html").alias("source_hash"))
    out = runs.shared_folder(spark, "snapshots")
    newest = runs.merge_snapshots(pages, f"{out}/meta", f"{out}/checkpoint", "comp_key")
    return spark.read.parquet(f"{out}/meta/{newest}")


# Listings, states and small functions


@query("""WITH c AS (SELECT n_name AS name, o_orderpriority AS model, o_orderdate AS generated_at FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY generated_at DESC, model DESC) AS k, count(*) OVER (PARTITION BY name) AS components FROM c)
SELECT name, components::BIGINT AS components, model, generated_at FROM r WHERE k = 1""")
def sources_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return browse.sources_listing(rows.select(F.col("n_name").alias("name"), F.col("o_orderpriority").alias("model"), F.col("o_orderdate").alias("generated_at")))


@query("""WITH p AS (SELECT 'INDEX.md' AS path UNION ALL SELECT r_name || '.md' FROM region WHERE r_regionkey <> 2 UNION ALL SELECT r_name || '/' || n_name || '.md' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0
  UNION ALL SELECT r_name || '/' || n_name || '/' || c_custkey || '.md' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT p.path, CASE WHEN p.path = 'INDEX.md' THEN NULL ELSE coalesce(c.path, k.path, 'INDEX.md') END AS parent FROM p
LEFT JOIN p c ON len(string_split(p.path, '/')) = 3 AND c.path = split_part(p.path, '/', 1) || '/' || split_part(p.path, '/', 2) || '.md'
LEFT JOIN p k ON len(string_split(p.path, '/')) > 1 AND k.path = split_part(p.path, '/', 1) || '.md'""")
def drill_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, components and packages of a knowledge base of customers, some of whose upper pages are missing."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    leaves = c.join(named, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat("r_name", F.lit("/"), "n_name", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".md")).alias("path"))
    parts = named.where("n_nationkey % 3 <> 0").select(F.concat("r_name", F.lit("/"), "n_name", F.lit(".md")).alias("path"))
    tops = r.where("r_regionkey <> 2").select(F.concat("r_name", F.lit(".md")).alias("path")).unionByName(spark.createDataFrame([("INDEX.md",)], "path string"))
    return browse.drill_down(leaves.unionByName(parts).unionByName(tops))


@query(f"""WITH {V.SQL_FILES}, c AS (SELECT doc_id % 500 AS comp_key, CASE WHEN doc_id % 500 % 11 = 0 THEN 'timeout' END AS error, CASE WHEN doc_id % 500 % 7 = 0 THEN 'tokens_below_threshold' ELSE '' END AS reason, content FROM f)
SELECT comp_key, CASE WHEN max(error) IS NOT NULL THEN 'failed' WHEN max(reason) <> '' THEN 'skipped' WHEN bool_or(trim(content) = '') OR comp_key % 5 = 0 THEN 'partial' ELSE 'done' END AS status FROM c GROUP BY comp_key""")
def derived_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = V.files(spark, sf_dir).withColumn("comp_key", F.col("doc_id") % 500)
    k = F.col("comp_key")
    comps = f.select("comp_key").distinct().select("comp_key", F.when(k % 11 == 0, "timeout").alias("error"), F.when(k % 7 == 0, "tokens_below_threshold").otherwise("").alias("reason"))
    leaves = f.select("comp_key", F.when(k % 5 == 0, "  ").otherwise(F.col("content")).alias("summary"))
    return changes.derived_status(comps, leaves)


@query(f"""WITH {V.SQL_META}, b AS (SELECT comp_key, 'error ' || doc_id AS error FROM cur WHERE doc_id % 4 = 1)
SELECT comp_key, status, source_hash, NULL::VARCHAR AS error FROM meta WHERE comp_key NOT IN (SELECT comp_key FROM b) UNION ALL SELECT comp_key, 'failed', NULL, error FROM b""")
def failed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = V.current_components(spark, sf_dir).where("doc_id % 4 = 1").select("comp_key", F.concat(F.lit("error "), F.col("doc_id").cast("string")).alias("error"))
    return changes.upsert_failed(V.previous_meta(spark, sf_dir).select("comp_key", "status", "source_hash"), bad)


@query(f"""WITH {V.SQL_FILES} SELECT package AS component, 0::BIGINT AS batch_idx, string_agg('// --- ' || rel || ' ---' || chr(10) || content || chr(10), chr(10) ORDER BY doc_id) AS content FROM f WHERE dir IN ('en', 'de') GROUP BY package""")
def directory_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scan.with_names(V.files(spark, sf_dir))
    batches = f.select(F.col("package").alias("component")).distinct().select("component", F.lit(0).cast("long").alias("batch_idx"), F.array(F.lit("en"), F.lit("de"), F.lit("")).alias("dirs"))
    return summaries.directory_contents(batches, f.select(F.col("package").alias("component"), F.col("doc_id").alias("entry_key"), "dir", "rel", F.col("content").alias("text")))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<img alt="a" src="/abs.png"><img src="/assets/kb/x.png">' ELSE '<img alt="a" src="/abs.png"><img src="/assets/kb/dir' || page_id || '/x.png">' END
  || '<img src="https://h/y.png">' AS html FROM pages""")
def asset_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.when(F.col("page_id") % 3 == 0, ".").otherwise(F.concat(F.lit("dir"), F.col("page_id").cast("string")))
    return table(spark, sf_dir, "pages").select("page_id", H.asset_sources(F.lit('<img alt="a" src="/abs.png"><img src="x.png"><img src="https://h/y.png">'), F.lit("kb"), folder).alias("html"))


@query("""SELECT page_id, replace(url_encode(html), '%2F', '/') AS quoted, html AS back FROM pages""")
def url_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = H.url_quote(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", quoted.alias("quoted"), H.url_unquote(quoted).alias("back"))


@query("""SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value END, 3.5) AS cpt, round_even(value, 1) AS elapsed FROM events""")
def token_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.chars_per_token(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.lit(3.5)).alias("cpt"), T.elapsed_tenths(F.col("value")).alias("elapsed"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '.html,.pdf' ELSE '.html' END AS need FROM part""")
def converted_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 2 == 0, F.array(*map(F.lit, (".pdf", ".md", ".html", ".txt")))).otherwise(F.array(*map(F.lit, (".txt", ".html"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(P.converted_extensions(given), ",").alias("need"))


@query("""SELECT col0 AS path, col1 AS kept FROM (VALUES ('p/build/y.py', true), ('p/bin/a.c', true), ('p/.git/x.py', false), ('p/node_modules/z.js', false), ('p/__pypackages__/q.py', false), ('p/src/vendor/v.cpp', true),
  ('p/env/e.py', false), ('p/src/w.svg', false), ('p/src/u.uasset', false), ('p/src/__init__.py', true))""")
def skipped_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths a scan keeps: directories and suffixes of the fixed lists."""
    names = ("p/build/y.py", "p/bin/a.c", "p/.git/x.py", "p/node_modules/z.js", "p/__pypackages__/q.py", "p/src/vendor/v.cpp", "p/env/e.py", "p/src/w.svg", "p/src/u.uasset", "p/src/__init__.py")
    rows = spark.createDataFrame([(n,) for n in names], "rel string").withColumn("content", F.lit("x"))
    kept = scan.included(rows, (*P.CODE_EXTENSIONS, ".svg", ".uasset")).select("rel", F.lit(True).alias("k"))
    return rows.join(kept, "rel", "left").select(F.col("rel").alias("path"), F.coalesce("k", F.lit(False)).alias("kept"))


@query("""SELECT doc_id, length(replace(coalesce(text, ''), chr(0), '')) + 2 AS chars FROM documents""")
def scan_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes with two stray ones, decoded with replacement."""
    from layerloom.sources.files import decoded

    raw = F.concat(F.lit(b"\xff"), F.encode(F.replace(F.coalesce("text", F.lit("")), F.lit("\x00"), F.lit("")), "UTF-8"), F.lit(b"\xc3"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(decoded(raw)).cast("long").alias("chars"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'llm.base=x,llm.model=new,out=' || p_type WHEN 1 THEN 'llm=off,out=' || p_type ELSE 'llm.base=x,llm.model=' || p_brand || ',out.dir=d' END AS settings FROM part""")
def layered_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from layerloom.functions.config import layered

    k = F.col("p_partkey") % 3
    base = F.create_map(F.lit("llm.model"), F.col("p_brand"), F.lit("llm.base"), F.lit("x"), F.lit("out"), F.col("p_type"))
    own = F.when(k == 0, F.create_map(F.lit("llm.model"), F.lit("new"))).when(k == 1, F.create_map(F.lit("llm"), F.lit("off"))).otherwise(F.create_map(F.lit("out.dir"), F.lit("d")))
    lines = F.transform(F.map_entries(layered(base, own)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(lines), ",").alias("settings"))


@query("""SELECT run, path, mtime FROM (SELECT o_custkey AS run, o_orderkey || '.jsonl' AS path, o_orderdate AS mtime, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey || '.jsonl' DESC) AS k FROM orders) WHERE k = 1""")
def newest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jsonl")).alias("path"), F.col("o_orderdate").alias("mtime"))
    return monitor.newest_files(files, "run")
