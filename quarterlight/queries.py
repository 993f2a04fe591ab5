"""The engine's operators as queries over the driver's tables, each with its SQL.

Stand-ins: conversations are document pages, documents filing texts, labels original
records, orders tasks, events the task log, customers the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import periods as P
from .functions import session
from .functions import text as T
from .operators import catalog, classify, extract, merge, tracking, validate
from .operators import records as variant
from .plans import enhance
from .schemas import FINANCIALS, INCOME_STATEMENT

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Patterns that stand in for the filing catalog, ASCII classes only, as both engines read them alike.
LINE = extract.Catalog({"code": [r"([0-9]{4})-[0-9]{4}", r"\(([0-9]{3})\)"], "amount": [r"[a-z] ([0-9,]{3,12})", r"([0-9]{2,9})"], "address": [r"([0-9]+)\.[0-9]+\.[0-9]+"]})
DOCUMENT = extract.Catalog({"first": [r"version ([0-9.]+)", r"([0-9]{3,9})"], "second": [r"([0-9]+)-[0-9]+", r"\b([0-9]+) "]})
KEYS = "'([A-Za-zÀ-ÿ]+)'"
LINES_SQL = """
lines AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE length(text) >= 100)),
tries AS (
  SELECT doc_id, line_no, unnest(['code', 'code', 'amount', 'amount', 'address']) AS field, unnest([0, 1, 0, 1, 0]) AS pattern_no,
    unnest([regexp_extract(line, '([0-9]{4})-[0-9]{4}', 1), regexp_extract(line, '\\(([0-9]{3})\\)', 1), regexp_extract(line, '[a-z] ([0-9,]{3,12})', 1), regexp_extract(line, '([0-9]{2,9})', 1), regexp_extract(line, '([0-9]+)\\.[0-9]+\\.[0-9]+', 1)]) AS hit FROM lines),
parsed AS (SELECT doc_id, field, line_no, pattern_no, try_cast(replace(hit, ',', '') AS DOUBLE) AS value FROM tries WHERE hit <> ''),
firsts AS (
  SELECT doc_id, field, arg_min(value, (line_no, pattern_no)) AS value, CAST(min(line_no) AS BIGINT) AS line_no
  FROM parsed WHERE value > 0 GROUP BY doc_id, field)
""".replace("\\\\", "\\")


@query("""
SELECT conv_id AS doc_id, total_pages, meaningful_chars, text_ratio,
  CASE WHEN meaningful_chars <= 100 THEN 'scanned' WHEN text_ratio > 0.3 OR meaningful_chars > 1000 THEN 'text_based' ELSE 'mixed' END AS doc_type
FROM (SELECT *, least(meaningful_chars::DOUBLE / (least(total_pages, 5) * 500), 1.0) AS text_ratio FROM (
  SELECT conv_id, count(*) AS total_pages, CAST(coalesce(sum(CASE WHEN rk <= 5 THEN length(regexp_replace(coalesce(text, ''), '[^\\p{L}\\p{N}，。、；：！？"（）【】]', '', 'g')) END), 0) AS BIGINT) AS meaningful_chars
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM conversations) GROUP BY conv_id))
""")
def doc_type(spark, d):
    return classify.document_types(read(spark, d, "conversations"), "conv_id", "turn")


@query(f"WITH {LINES_SQL} SELECT doc_id, field, value, line_no FROM firsts")
def extract_first_line(spark, d):
    found = extract.by_line(read(spark, d, "documents"), LINE, accept=lambda v, f: v > 0)
    return found.select("doc_id", "field", "value", F.col("line_no").cast("long").alias("line_no"))


@query(r"""
SELECT doc_id, field, value FROM (
  SELECT doc_id, unnest(['first', 'second']) AS field, unnest([
    coalesce(try_cast(regexp_extract(text, 'version ([0-9.]+)', 1) AS DOUBLE), try_cast(regexp_extract(text, '([0-9]{3,9})', 1) AS DOUBLE)),
    coalesce(try_cast(regexp_extract(text, '([0-9]+)-[0-9]+', 1) AS DOUBLE), try_cast(regexp_extract(text, '\b([0-9]+) ', 1) AS DOUBLE))]) AS value FROM documents)
WHERE value IS NOT NULL
""")
def extract_doc_cascade(spark, d):
    return extract.by_document(read(spark, d, "documents"), DOCUMENT)


@query(r"""
SELECT doc_id, 'number' AS field, arg_max(value, line_no) AS value FROM (
  SELECT doc_id, line_no, try_cast(regexp_extract(line, '([0-9]{2,9})', 1) AS DOUBLE) AS value FROM (
    SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))
WHERE value IS NOT NULL GROUP BY doc_id
""")
def extract_last_match(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.select("doc_id", F.lit("number").alias("field"), "line_no", F.regexp_extract("line", "([0-9]{2,9})", 1).try_cast("double").alias("value"))
    return extract.last_match(rows.filter("value is not null"), ["line_no"])


PAGE_LINES_SQL = LINES_SQL.replace("FROM documents WHERE length(text) >= 100)),", "FROM joined WHERE length(text) >= 100)),", 1).replace("'([0-9]+)\\.[0-9]+\\.[0-9]+', 1)]) AS hit FROM lines)", "'([0-9]+)\\.[0-9]+\\.[0-9]+', 1)]) AS hit FROM lines WHERE NOT starts_with(line, '=== 第'))")


@query(f"""
WITH joined AS (SELECT doc_id // 4 AS doc_id, string_agg('=== 第' || doc_id % 4 || '頁 ===' || chr(10) || text, chr(10) ORDER BY doc_id) AS text FROM documents WHERE trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> '' GROUP BY 1),
{PAGE_LINES_SQL} SELECT doc_id, field, value, line_no FROM firsts
""")
def page_first_line(spark, d):
    """The first match over all pages; four documents are the pages of one."""
    pages = read(spark, d, "documents").select(F.floor(F.col("doc_id") / 4).alias("doc_id"), (F.col("doc_id") % 4).alias("page_no"), "text")
    found = extract.by_page(pages, LINE, accept=lambda v, f: v > 0)
    return found.select("doc_id", "field", "value", F.col("line_no").cast("long").alias("line_no"))


@query(f"""
WITH {LINES_SQL}, got AS (SELECT doc_id, list(field) AS fields FROM firsts GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(fields), 0) AS BIGINT) AS n_found,
  array_to_string(list_filter(['code', 'amount', 'address'], lambda x: NOT coalesce(list_contains(fields, x), false)), ',') AS missing
FROM documents LEFT JOIN got USING (doc_id)
""")
def field_summary(spark, d):
    docs = read(spark, d, "documents")
    found = extract.by_line(docs, LINE, accept=lambda v, f: v > 0)
    return extract.field_summary(found, docs, ("code", "amount", "address")).withColumn("missing", F.array_join("missing", ","))


@query("""
SELECT l_orderkey, l_linenumber, field, value, CASE WHEN field = 'eps' THEN value BETWEEN 0.01 AND 100 WHEN field = 'net_revenue' THEN value BETWEEN 1000 AND 999999999999 ELSE value > 0 END AS plausible
FROM (SELECT l_orderkey, l_linenumber, unnest(['eps', 'net_revenue', 'other']) AS field, unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem)
""")
def plausible_values(spark, d):
    one = lambda f, c: F.struct(F.lit(f).alias("field"), F.col(c).alias("value"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.array(one("eps", "l_quantity"), one("net_revenue", "l_extendedprice"), one("other", "l_discount"))).alias("v")).select("l_orderkey", "l_linenumber", "v.*")
    return rows.withColumn("plausible", extract.plausible(F.col("value"), F.col("field")))


@query(r"""
SELECT page_id, position, url, trim(label) AS text, coalesce(try_cast(replace(regexp_extract(label, '([0-9]+(?:,[0-9]+)*)\s*bytes?', 1), ',', '') AS BIGINT), 0) AS size, 'the' AS filename FROM (
  SELECT page_id, CAST(generate_subscripts(u, 1) - 1 AS BIGINT) AS position, unnest(u) AS url, unnest(t) AS label FROM (
    SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*/[^"'']*)["''][^>]*>([^<]*)</a>', 1) AS u, regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*/[^"'']*)["''][^>]*>([^<]*)</a>', 2) AS t FROM pages))
WHERE contains(url, 'the') OR contains(label, 'the')
""")
def html_links(spark, d):
    return extract.document_links(read(spark, d, "pages"), "the", "/").withColumn("position", F.col("position").cast("long"))


@query(r"""
SELECT page_id, url FROM (
  SELECT page_id, unnest(u) AS url, unnest(range(len(u))) AS position FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*/[^"'']*)["''][^>]*>([^<]*)</a>', 1) AS u FROM pages))
WHERE position = 0
""")
def first_link(spark, d):
    return extract.first_links(extract.document_links(read(spark, d, "pages"), "/", "/")).select("page_id", "url")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE 'plain' END AS unwrapped FROM events")
def json_field_access(spark, d):
    rows = read(spark, d, "events").withColumn("wrapped", F.when(F.col("event_id") % 2 == 0, F.replace("props", F.lit('"k"'), F.lit('"value"'))).otherwise("plain"))
    return rows.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), T.unwrap(F.col("wrapped")).alias("unwrapped"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_distribution(spark, d):
    return catalog.counts(read(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status")


@query("SELECT c_mktsegment AS company, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC")
def company_distribution(spark, d):
    return catalog.counts(read(spark, d, "customer").withColumnRenamed("c_mktsegment", "company"), "company").orderBy(F.desc("n"))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC")
def year_distribution(spark, d):
    return catalog.counts(read(spark, d, "orders").withColumn("year", F.year("o_orderdate")), "year").orderBy(F.desc("year"))


@query("""
SELECT coalesce(sum(v)::DOUBLE / count(v), 0) AS average, coalesce(min(v)::DOUBLE, 0) AS minimum, coalesce(max(v)::DOUBLE, 0) AS maximum
FROM (SELECT CAST(value AS DECIMAL(28, 6)) AS v FROM events)
""")
def time_statistics(spark, d):
    return tracking.time_statistics(read(spark, d, "events"), "value")


@query("SELECT props AS error_message, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def top_errors(spark, d):
    return tracking.top_errors(read(spark, d, "events").filter("event_type = 'error'"), "props").withColumnRenamed("props", "error_message")


@query("""
SELECT total, completed, pending, failed, retryable, coalesce(round(completed::DECIMAL(18, 0) * 100 / total, 2), 0)::DOUBLE AS completion, average_seconds, round(average_seconds * pending / 60, 1) AS eta_minutes FROM (
  SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'failed') AS failed,
    count(*) FILTER (o_orderstatus = 'failed' AND o_custkey % 5 < 3) AS retryable, coalesce(sum(CAST(o_totalprice AS DECIMAL(28, 6)))::DOUBLE / count(o_totalprice), 0) AS average_seconds FROM orders)
""")
def progress_overview(spark, d):
    return tracking.progress(read(spark, d, "orders").withColumn("retries", F.col("o_custkey") % 5), "F", "O", "o_orderstatus", "o_totalprice", "retries")


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate")
def tasks_by_status(spark, d):
    rows = read(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status"})
    return tracking.by_status(rows, "F", "o_orderdate").select("o_orderkey", "o_custkey", "o_orderdate")


@query("SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def task_lookup(spark, d):
    return tracking.task(read(spark, d, "orders").withColumnRenamed("o_orderkey", "id"), 7).select("id", "o_orderstatus", "o_totalprice")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id % 5 < 3")
def retryable(spark, d):
    rows = read(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "error", "failed").alias("status"), (F.col("user_id") % 5).alias("retry_count"))
    return tracking.retryable(rows).select("event_id", "user_id")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def latest_per_key(spark, d):
    return catalog.latest(read(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


FOLD_SQL = """
WITH log AS (SELECT user_id AS id, event_id AS seq, CASE WHEN event_type = 'signup' THEN 'create' ELSE 'status' END AS kind, CASE WHEN event_type = 'error' THEN 'failed' ELSE event_type END AS status, CASE WHEN event_type = 'error' THEN props ELSE '' END AS message, CASE WHEN event_type = 'view' THEN 0 ELSE value END AS seconds FROM events),
created AS (SELECT id, max(seq) AS since FROM log WHERE kind = 'create' GROUP BY id),
live AS (SELECT log.* FROM log JOIN created USING (id) WHERE seq >= since)
SELECT id, coalesce(arg_max(status, seq) FILTER (kind = 'status'), 'pending') AS status, coalesce(arg_max(message, seq) FILTER (message <> ''), '') AS error_message,
  count(*) FILTER (kind = 'status' AND status = 'failed' AND message <> '') AS retry_count, coalesce(arg_max(seconds, seq) FILTER (coalesce(seconds, 0) <> 0), 0) AS processing_time
FROM live GROUP BY id
"""


def event_log(spark, d) -> DataFrame:
    kind = F.col("event_type")
    return read(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(kind == "signup", "create").otherwise("status").alias("kind"), F.when(kind == "error", "failed").otherwise(kind).alias("status"),
        F.when(kind == "error", F.col("props")).otherwise("").alias("error_message"), F.when(kind == "view", 0.0).otherwise(F.col("value")).alias("processing_time"),
    )


def without_nulls(tasks: DataFrame) -> DataFrame:
    return tasks.withColumns({"error_message": F.coalesce("error_message", F.lit("")), "processing_time": F.coalesce("processing_time", F.lit(0.0))})


@query(FOLD_SQL)
def event_fold(spark, d):
    return without_nulls(tracking.folded(event_log(spark, d)))


@query(FOLD_SQL)
def event_fold_merged(spark, d):
    """The fold of the whole log from three parts of it, out of order and with a part that comes twice."""
    log = event_log(spark, d)
    first, second, third = (tracking.partial(log.filter(test)) for test in ("seq % 3 = 0", "seq % 3 <> 0 and seq % 5 <> 0", "seq % 5 = 0"))
    return without_nulls(tracking.finished(*tracking.merged(tracking.merged(third, first), tracking.merged(second, first))))


@query("SELECT c_custkey AS id, c_name AS company_name, CAST(c_nationkey AS INTEGER) AS year FROM customer WHERE contains(lower(c_name), 'r#00') AND c_nationkey = 7")
def catalog_search(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("year"))
    return catalog.searched(rows, company_name="R#00", year=7)


@query("SELECT count(*) AS total_reports, count(DISTINCT n_name) AS n_codes, array_to_string(list_sort(list(DISTINCT n_name)), ',') AS codes FROM customer JOIN nation ON c_nationkey = n_nationkey")
def catalog_stats(spark, d):
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return catalog.stats(rows, "n_name").withColumn("codes", F.array_join("codes", ","))


@query("""
SELECT * EXCLUDE rk FROM (SELECT c_custkey AS id, c_acctbal AS crawled_at, c_mktsegment AS company_name, row_number() OVER (PARTITION BY c_custkey ORDER BY fresh DESC) AS rk FROM (
  SELECT c_custkey, c_acctbal, c_mktsegment, 0 AS fresh FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 'NEW', 1 FROM customer WHERE c_custkey % 3 = 0)) WHERE rk = 1
""")
def catalog_upsert(spark, d):
    index = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("crawled_at"), F.col("c_mktsegment").alias("company_name"))
    new = index.filter("id % 3 = 0").select("id", (F.col("crawled_at") + 1).alias("crawled_at"), F.lit("NEW").alias("company_name"))
    return catalog.upserted(index, new)


PERIODS_SQL = """SELECT o_orderkey, year(o_orderdate)::VARCHAR AS y, 'Q' || quarter(o_orderdate) AS s, lpad((o_custkey % 10000)::VARCHAR, 4, '0') AS code FROM orders"""


def orders_periods(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("s"), F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0").alias("code"))


@query(f"""
SELECT o_orderkey, s AS season, y || s AS period, y || '0' || s[2:] || '_' || code || '_AI1.pdf' AS pdf_file, code || '_' || y || s AS task_id, code || '_' || y || s AS index_id, true AS valid_season, true AS valid_code FROM ({PERIODS_SQL})
""")
def period_key(spark, d):
    y, s, code = F.col("y"), F.col("s"), F.col("code")
    lower = F.lower(s)
    return orders_periods(spark, d).select(
        "o_orderkey", P.normalize_season(lower).alias("season"), P.period(y, lower).alias("period"), P.file_name(y, s, code).alias("pdf_file"), P.task_id(code, y, s).alias("task_id"),
        P.index_id(code, y, F.concat(F.lit("Q"), s)).alias("index_id"), P.valid_season(s).alias("valid_season"), P.valid_stock_code(code).alias("valid_code"),
    )


@query(f"""
SELECT o_orderkey, y::INTEGER AS year, 'Q1' AS season, code AS stock_code, y || CASE WHEN s = 'Q4' THEN 'Q2' WHEN s = 'Q3' THEN 'Q1' ELSE 'Q1' END AS calendar FROM ({PERIODS_SQL}) WHERE s <> 'Q3'
UNION ALL SELECT o_orderkey, y::INTEGER, 'Q1', code, y || 'Q1' FROM ({PERIODS_SQL}) WHERE s = 'Q3'
""")
def period_from_name(spark, d):
    # Month 03 of the third quarter's file reads as Q1 by either rule; 04 is Q2 by the calendar, Q1 by name.
    named = orders_periods(spark, d).withColumn("name", P.file_name(F.col("y"), F.col("s"), F.col("code"))).withColumn("p", P.parse_name(F.col("name")))
    return named.select("o_orderkey", "p.year", "p.season", "p.stock_code", P.calendar_period(F.col("name")).alias("calendar"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_original' ELSE 'ready' END AS status FROM documents LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)".replace("SELECT doc_id, CASE", "SELECT documents.doc_id, CASE").replace("LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)", "LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON documents.doc_id = l.doc_id"))
def pair_status(spark, d):
    return merge.pair_status(read(spark, d, "documents").select("doc_id"), read(spark, d, "labels"), "doc_id")


@query("SELECT d.doc_id, d.n_chars, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def pairs_ready(spark, d):
    return merge.paired(read(spark, d, "documents").select("doc_id", "n_chars"), read(spark, d, "labels").select("doc_id", "quality"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unprocessed(spark, d):
    return merge.unprocessed(read(spark, d, "documents").select("doc_id", "source"), read(spark, d, "labels"), "doc_id")


@query("SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM labels) AS processed, (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels) AS remaining")
def processed_counts(spark, d):
    return merge.processed_counts(read(spark, d, "documents"), read(spark, d, "labels"))


@query("SELECT c_custkey, coalesce(n_name, 'nation ' || c_nationkey) AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 1) n ON c_nationkey = n_nationkey")
def name_lookup(spark, d):
    names = read(spark, d, "nation").filter("n_regionkey <> 1").withColumnRenamed("n_nationkey", "c_nationkey")
    return merge.named(read(spark, d, "customer").select("c_custkey", "c_nationkey"), names, "c_nationkey", "n_name", "nation ").select("c_custkey", "n_name")


RECORDS_SQL = """
old AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS equity, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id AS DOUBLE) END AS eps FROM documents),
new AS (SELECT doc_id, CASE WHEN quality = 1 THEN 5.0::DOUBLE END AS equity, CAST(toxic AS DOUBLE) AS eps FROM labels),
merged AS (SELECT old.doc_id, coalesce(new.equity, old.equity) AS equity, coalesce(new.eps, old.eps) AS eps FROM old LEFT JOIN new ON old.doc_id = new.doc_id)
"""


def records(spark, d) -> tuple[DataFrame, DataFrame]:
    old = read(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("equity"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("double")).alias("eps"))
    new = read(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, F.lit(5.0)).alias("equity"), F.col("toxic").cast("double").alias("eps"))
    return old, merge.backfilled(old, new, "doc_id", ("equity", "eps"))


@query(f"WITH {RECORDS_SQL} SELECT doc_id, equity, coalesce(eps, -1) AS eps FROM merged")
def backfill_merge(spark, d):
    return records(spark, d)[1].withColumn("eps", F.coalesce("eps", F.lit(-1.0)))


@query(f"""
WITH {RECORDS_SQL}, pairs AS (SELECT m.doc_id, unnest(['equity', 'eps']) AS field, unnest([o.equity, o.eps]) AS old, unnest([m.equity, m.eps]) AS new FROM merged m JOIN old o ON m.doc_id = o.doc_id)
SELECT doc_id, field, coalesce(old, -1) AS old, coalesce(new, -1) AS new FROM pairs WHERE old IS DISTINCT FROM new
""")
def change_summary(spark, d):
    old, new = records(spark, d)
    return merge.changes(old, new, "doc_id", ("equity", "eps")).withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("old", "new")})


@query("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'null' ELSE coalesce(json_extract_string(props, '$.k'), 'absent') END AS k, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE '7' END AS z,
  CAST((CASE WHEN event_id % 3 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_values FROM events
""")
def present_wins_merge(spark, d):
    later = F.when(F.col("event_id") % 3 == 0, F.lit('{"k": null}')).otherwise(F.lit('{"z": 7}'))
    merged = merge.present_wins(F.from_json("props", "map<string,string>"), F.from_json(later, "map<string,string>"))
    rows = read(spark, d, "events").select("event_id", merged.alias("m"))
    said = lambda k, none: F.when(F.map_contains_key("m", k), F.coalesce(F.try_element_at("m", F.lit(k)), F.lit("null"))).otherwise(none)
    return rows.select("event_id", said("k", "absent").alias("k"), said("z", "none").alias("z"), merge.non_null_count(F.col("m")).alias("n_values"))


JUDGED_SQL = """
judged AS (
  SELECT c_custkey, list_filter([
      CASE WHEN NOT regexp_matches(c_custkey::VARCHAR, '^[0-9]{4}$') THEN '股票代碼應為4位數字 (格式不符: ' || c_custkey || ')' END,
      CASE WHEN c_nationkey * 2 + 1990 < 2000 THEN '報告年度應在合理範圍內(2000-2030) (值太小: ' || (c_nationkey * 2 + 1990) || ')' WHEN c_nationkey * 2 + 1990 > 2030 THEN '報告年度應在合理範圍內(2000-2030) (值太大: ' || (c_nationkey * 2 + 1990) || ')' END,
      CASE WHEN c_mktsegment <> 'BUILDING' THEN '報告季度應為Q1-Q4格式 (格式不符: ' || c_mktsegment || ')' END,
      CASE WHEN c_custkey % 7 <> 0 AND abs(1000 - (900 + c_custkey % 50 * 4)) / 1000.0 > 0.01 THEN '資產負債表不平衡：資產 ≠ 負債 + 權益' END], lambda x: x IS NOT NULL) AS errors,
    list_filter([
      CASE WHEN c_custkey % 7 = 0 THEN '財務數據欄位為必要 (欄位為空)' END, '損益表數據為必要', '資產負債表數據為必要',
      CASE WHEN c_custkey * 40 < 10000 THEN '檔案大小異常 (值太小: ' || c_custkey * 40 || ')' WHEN c_custkey * 40 > 50000000 THEN '檔案大小異常 (值太大: ' || c_custkey * 40 || ')' END,
      '缺少重要財務數據: net_revenue, gross_profit, operating_income, net_income' || CASE WHEN c_custkey % 7 = 0 THEN ', total_assets, total_liabilities, equity' ELSE '' END,
      CASE WHEN c_custkey * 40 < 10000 THEN 'PDF檔案過小，可能不完整' END], lambda x: x IS NOT NULL) AS warnings,
    CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 3 END AS figures FROM customer),
scored AS (SELECT *, greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - len(errors) * 20 - len(warnings) * 5 + figures::DOUBLE / 7 * 20 + 1::DOUBLE / 5 * 10)) AS score FROM judged)
"""


def judged(spark, d) -> DataFrame:
    text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    full = F.create_map(F.lit("total_assets"), F.lit("1000"), F.lit("total_liabilities"), F.lit("900"), F.lit("equity"), text(F.col("c_custkey") % 50 * 4))
    rows = read(spark, d, "customer").select(
        "c_custkey", text("c_custkey").alias("stock_code"), F.col("c_name").alias("company_name"), (F.col("c_nationkey") * 2 + 1990).alias("report_year"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Q2").otherwise(F.col("c_mktsegment")).alias("report_season"),
        F.when(F.col("c_custkey") % 7 == 0, F.create_map().cast("map<string,string>")).otherwise(full).alias("financials"), F.lit(None).cast("map<string,string>").alias("income_statement"), F.lit(None).cast("map<string,string>").alias("balance_sheet"),
        F.create_map(F.lit("file_size"), text(F.col("c_custkey") * 40)).alias("metadata"),
    )
    return validate.validated(rows)


@query(f"WITH {JUDGED_SQL} SELECT c_custkey, len(errors) = 0 AS is_valid, array_to_string(errors, ';') AS errors, array_to_string(warnings, ';') AS warnings FROM scored")
def rule_validation(spark, d):
    return judged(spark, d).select("c_custkey", "is_valid", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query(f"WITH {JUDGED_SQL} SELECT c_custkey, score FROM scored")
def quality_score(spark, d):
    return judged(spark, d).select("c_custkey", "score")


@query(f"""
WITH {JUDGED_SQL} SELECT count(*) AS total, count(*) FILTER (len(errors) = 0) AS valid, count(*) FILTER (len(warnings) > 0) AS with_warnings, count(*) FILTER (len(errors) > 0) AS with_errors,
  sum(CAST(score AS DECIMAL(20, 6)))::DOUBLE / count(*) AS average_score FROM scored
""")
def quality_summary(spark, d):
    return validate.quality_summary(judged(spark, d))


@query(f"WITH {JUDGED_SQL} SELECT trim(split_part(m, '(', 1)) AS issue, count(*) AS n FROM (SELECT unnest(list_concat(errors, warnings)) AS m FROM judged) GROUP BY 1")
def common_issues(spark, d):
    return validate.common_issues(judged(spark, d))


@query("""
SELECT o_orderkey, total, lines, abs(total - lines) / total > 0.01 AS unbalanced FROM (
  SELECT o_orderkey, o_totalprice AS total, sum(CAST(l_extendedprice AS DECIMAL(18, 2)))::DOUBLE AS lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice)
""")
def balance_check(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("lines"))
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("total")).join(lines, "o_orderkey")
    return rows.withColumn("unbalanced", validate.balance_message(F.col("total"), F.col("lines"), F.lit(0.0)).isNotNull())


@query("""
SELECT o_orderkey, o_custkey BETWEEN 1000 AND 9999 AND year BETWEEN 2020 AND 2030 AND season IN ('1', '2', '3', '4') AS is_valid,
  CASE WHEN o_custkey BETWEEN 1000 AND 9999 AND year BETWEEN 2020 AND 2030 AND season IN ('1', '2', '3', '4') THEN year || '0' || season || '_' || o_custkey || '_AI1.pdf' ELSE '' END AS pdf_file
FROM (SELECT o_orderkey, o_custkey, CAST(year(o_orderdate) + 25 AS INTEGER) AS year, (o_orderkey % 6)::VARCHAR AS season FROM orders)
""")
def query_validation(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("stock_code"), F.lit("x").alias("company_name"), (F.year("o_orderdate") + 25).alias("year"), (F.col("o_orderkey") % 6).cast("string").alias("season"))
    return catalog.requests_checked(rows).select("o_orderkey", "is_valid", F.coalesce("pdf_file", F.lit("")).alias("pdf_file"))


@query("""
SELECT doc_id, CASE WHEN n_chars = 0 THEN '0 B' WHEN n_chars < 1024 THEN round(n_chars::DECIMAL(20, 0) / 1, 2)::DOUBLE || ' B' ELSE round(n_chars::DECIMAL(20, 6) / 1024, 2)::DOUBLE || ' KB' END AS label FROM documents
""")
def file_size_label(spark, d):
    return read(spark, d, "documents").select("doc_id", T.size_label(F.col("n_chars")).alias("label"))


@query("""
SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_mktsegment = 'BUILDING' THEN 'company_name' END, CASE WHEN c_nationkey + 2010 > 2026 THEN 'report_year' END, CASE WHEN c_custkey % 5 NOT IN (1, 2, 3, 4) THEN 'report_season' END], lambda x: x IS NOT NULL), ',') AS errors FROM customer
""")
def report_validity(spark, d):
    name = F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_name"))
    errors = validate.report_errors(F.col("c_custkey").cast("string"), name, F.col("c_nationkey") + 2010, F.concat(F.lit("Q"), (F.col("c_custkey") % 5).cast("string")), 2025)
    return read(spark, d, "customer").select("c_custkey", F.array_join(errors, ",").alias("errors"))


@query("SELECT count(*) AS n, arg_max(doc_id::VARCHAR, (n_chars, doc_id::VARCHAR)) AS newest FROM documents")
def newest_file(spark, d):
    return catalog.newest(read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("n_chars").alias("modified")))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS succeeded, coalesce(bool_or(quality = 1), false) AS any_success FROM labels")
def batch_success(spark, d):
    return merge.batch_result(read(spark, d, "labels").withColumn("success", F.col("quality") == 1))


@query("""
SELECT total, failed, average_seconds, array_to_string(list_filter([
  CASE WHEN failed::DOUBLE / total > 0.2 THEN '失敗率較高，建議檢查PDF品質和OCR設定' END, CASE WHEN average_seconds > 300 THEN '處理時間較長，建議啟用並行處理或GPU加速' END,
  'OCR相關錯誤較多，建議調整信心閾值或切換OCR引擎'], lambda x: x IS NOT NULL), ';') AS recommendations FROM (
  SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS failed, coalesce(sum(CAST(o_totalprice AS DECIMAL(28, 6)))::DOUBLE / count(o_totalprice), 0) AS average_seconds FROM orders)
""")
def recommendations(spark, d):
    rows = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "failed").otherwise("pending").alias("status"), F.col("o_totalprice").alias("processing_time"), F.lit(0).alias("retry_count"))
    errors = tracking.top_errors(read(spark, d, "region").select(F.when(F.col("r_regionkey") < 3, "OCR failed").otherwise("other").alias("error_message")))
    report = tracking.progress(rows).crossJoin(F.broadcast(errors.agg(F.collect_list("error_message").alias("errors"))))
    report = tracking.recommendations(report, F.col("errors"))
    return report.select("total", "failed", "average_seconds", F.array_join("recommendations", ";").alias("recommendations"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def grouped_counts(spark, d):
    return catalog.counts(read(spark, d, "documents"), "lang", "source")


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com')")
def name_search(spark, d):
    return catalog.files_named(read(spark, d, "pages"), "Example.COM", "url").select("page_id", "url")


@query("""
SELECT conv_id, CASE WHEN doc_type = 'scanned' THEN 'low' WHEN n > 0 AND doc_type = 'text_based' THEN 'high' WHEN n > 0 OR chars > 0 THEN 'medium' ELSE 'low' END AS confidence FROM (
  SELECT conv_id, n, chars, CASE WHEN chars <= 100 THEN 'scanned' WHEN chars::DOUBLE / (pages * 500) > 0.3 OR chars > 1000 THEN 'text_based' ELSE 'mixed' END AS doc_type FROM (
    SELECT conv_id, conv_id % 2 AS n, least(count(*), 5) AS pages, sum(CASE WHEN rk <= 5 THEN length(regexp_replace(text, '[^\\p{L}\\p{N}，。、；：！？"（）【】]', '', 'g')) ELSE 0 END) AS chars
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rk FROM conversations) GROUP BY conv_id))
""")
def strategy_confidence(spark, d):
    types = classify.document_types(read(spark, d, "conversations"), "conv_id", "turn")
    return types.select(F.col("doc_id").alias("conv_id"), classify.strategy(F.col("doc_type"), F.col("doc_id") % 2, F.col("meaningful_chars") > 0).alias("confidence"))


# Filings made of orders: the real catalogs on texts whose values are known from the order itself.

def filings(spark, d) -> DataFrame:
    """doc_id, revenue (thousands) and kind (0 to 3) of each order."""
    return read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), F.floor("o_totalprice").cast("long").alias("revenue"), (F.col("o_orderkey") % 4).cast("int").alias("kind"))


FILINGS_SQL = "filings AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(floor(o_totalprice) AS BIGINT) AS revenue, CAST(o_orderkey % 4 AS INTEGER) AS kind FROM orders)"
# A code behind a label wins; eps 0.00 is not plausible, so the next line decides; 負債及權益總計 is equity.
LINE_VALUES_SQL = f"""
{FILINGS_SQL}, line_values AS (
  SELECT doc_id, unnest(['net_revenue', 'gross_profit', 'eps', 'equity']) AS field, unnest([revenue::DOUBLE, 5900.0::DOUBLE, CASE WHEN kind = 3 THEN 2.25::DOUBLE ELSE 1.5::DOUBLE END, revenue * 2.0::DOUBLE]) AS value, revenue FROM filings)
"""


def line_texts(spark, d, pad: int) -> DataFrame:
    amount = lambda c: F.format_number(c, 0)
    text = F.concat(
        F.lit("合併報表\n  營業收入淨額　$"), amount("revenue"), F.lit(" 千元\n營業毛利（毛損） 5900 營業毛利 "), amount("revenue"), F.lit("\n每股盈餘 "), F.when(F.col("kind") == 3, "0.00").otherwise("1.5"),
        F.lit("\n基本每股盈餘 2.25\n負債及權益總計 "), amount(F.col("revenue") * 2), F.lit("\n營業收入 9,999\n" + "字" * pad),
    )
    return filings(spark, d).select("doc_id", text.alias("text"))


@query(f"WITH {LINE_VALUES_SQL} SELECT doc_id, field, CASE WHEN field = 'net_revenue' AND revenue < 1000 THEN 9999 ELSE value END AS value, 1.0::DOUBLE AS confidence, 'text' AS source FROM line_values WHERE field <> 'equity' OR value >= 1000")
def filing_lines(spark, d):
    return extract.smart_fields(line_texts(spark, d, 100))


@query(f"WITH {LINE_VALUES_SQL} SELECT doc_id, field, CASE WHEN field = 'net_revenue' AND revenue < 1000 THEN 9999 ELSE value END AS value, 0.7::DOUBLE AS confidence, 'ocr' AS source FROM line_values WHERE field <> 'equity' OR value >= 1000")
def filing_ocr_lines(spark, d):
    return extract.ocr_fields(line_texts(spark, d, 0))


LABEL_VALUES_SQL = f"""
{FILINGS_SQL}, label_values AS (
  SELECT doc_id, unnest(['net_revenue', 'gross_profit', 'eps', 'total_assets']) AS field, unnest([revenue::DOUBLE, kind::DOUBLE, 12.0::DOUBLE, 7.0::DOUBLE]) AS value FROM filings)
"""


def label_texts(spark, d) -> DataFrame:
    """The first hit of a pattern decides: EPS: 1.2.3 doesn't parse, so the next pattern does."""
    text = F.concat(F.lit("營收　："), F.format_number("revenue", 0), F.lit("\nGROSS PROFIT: "), F.col("kind").cast("string"), F.lit("\nEPS: 1.2.3 EPS: 5\nEarnings per Share：12\n資產總計: 7 淨利 88"))
    return filings(spark, d).select("doc_id", text.alias("text"))


@query(f"WITH {LABEL_VALUES_SQL} SELECT doc_id, field, value FROM label_values")
def filing_labels(spark, d):
    return extract.by_document(label_texts(spark, d))


# The last row of a field wins; parentheses lose the sign; decimals are no numbers in tables.
TABLE_VALUES_SQL = f"""
{FILINGS_SQL}, table_values AS (
  SELECT doc_id, unnest(['total_assets', 'total_equity', 'net_income']) AS field, unnest([revenue * 3.0::DOUBLE, revenue::DOUBLE, kind::DOUBLE]) AS value FROM filings)
"""


def filing_tables_of(spark, d) -> DataFrame:
    s = lambda *cells: F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells])
    none, amount = F.lit(None).cast("string"), F.format_number("revenue", 0)
    rows = F.array(s("資產總計", none, "1,000"), s("權益總計", "-", F.concat(F.lit("("), amount, F.lit(")"))), s("基本每股盈餘", "1.59", none), s(" Total Assets :", "附註", F.format_number(F.col("revenue") * 3, 0)), s("本期淨利(損)", F.col("kind").cast("string"), none))
    return filings(spark, d).select("doc_id", F.lit(1).alias("page"), F.lit(0).alias("table_index"), F.array(F.lit("項目")).alias("headers"), rows.alias("rows"))


@query(f"WITH {TABLE_VALUES_SQL} SELECT doc_id, field, value FROM table_values")
def filing_tables(spark, d):
    return extract.by_table(filing_tables_of(spark, d))


@query(f"WITH {LABEL_VALUES_SQL}, {TABLE_VALUES_SQL.replace(FILINGS_SQL + ',', '')} SELECT doc_id, field, value FROM (SELECT coalesce(t.doc_id, l.doc_id) AS doc_id, coalesce(t.field, l.field) AS field, coalesce(t.value, l.value) AS value FROM label_values l FULL JOIN table_values t ON l.doc_id = t.doc_id AND l.field = t.field) WHERE value <> 0")
def filing_combined(spark, d):
    return extract.combined(extract.by_document(label_texts(spark, d)), extract.by_table(filing_tables_of(spark, d)))


# The strategies' notes.
ENHANCED_SQL = f"""
{FILINGS_SQL}, sorts AS (SELECT *, CAST(CAST(doc_id AS BIGINT) % 6 AS INTEGER) AS sort FROM filings),
pairs AS (
  SELECT doc_id, sort, revenue, list_filter(CASE sort
    WHEN 1 THEN [{{'f': 'net_revenue', 'v': revenue::DOUBLE}}, {{'f': 'eps', 'v': 3.5::DOUBLE}}]
    WHEN 2 THEN [{{'f': 'net_revenue', 'v': CASE WHEN revenue >= 1000 THEN revenue ELSE 5555 END::DOUBLE}}]
    WHEN 4 THEN [{{'f': 'total_assets', 'v': revenue * 3.0::DOUBLE}}, {{'f': 'total_equity', 'v': revenue::DOUBLE}}, {{'f': 'net_income', 'v': kind::DOUBLE}}]
    WHEN 5 THEN [{{'f': 'net_revenue', 'v': 12.0::DOUBLE}}, {{'f': 'total_assets', 'v': revenue * 3.0::DOUBLE}}, {{'f': 'total_equity', 'v': revenue::DOUBLE}}, {{'f': 'net_income', 'v': kind::DOUBLE}}]
    ELSE [] END, lambda p: p.v <> 0) AS found FROM sorts),
enhanced AS (
  SELECT doc_id, found, CASE sort WHEN 0 THEN 'low' WHEN 1 THEN 'high' WHEN 5 THEN 'high' ELSE 'medium' END AS confidence,
    CASE sort WHEN 0 THEN 'Scanned PDF - requires manual review or OCR' WHEN 4 THEN 'Mixed PDF processed with PDF extractor: ' || len(found) || ' fields'
      WHEN 2 THEN 'Text-based PDF processed with smart extraction: 1 fields' WHEN 3 THEN 'Text-based PDF processed with smart extraction: 0 fields' ELSE 'Text-based PDF processed with ' || len(found) || ' financial fields' END AS note FROM pairs)
"""


def enhanced_filings(spark, d) -> DataFrame:
    """Scanned, labelled, plain, empty, mixed and tabled filings of one to four pages in one plan."""
    amount, sort = F.col("revenue").cast("string"), (F.col("doc_id").cast("long") % 6).cast("int")
    page = lambda n, t: F.struct(F.lit(n).alias("page_no"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    filled = lambda n: "字" * n
    pages = (
        F.when(sort == 0, F.array(page(1, F.concat(F.lit("營收：77 "), amount))))
        .when(sort == 1, F.array(page(2, "EPS: 3.5\nEPS: 9"), page(1, F.concat(F.lit("Net Revenue: "), amount, F.lit("\n" + filled(400))))))
        .when(sort == 2, F.array(page(1, filled(700)), page(4, "營業收入 5,555"), page(2, F.concat(F.lit("營業收入淨額 "), amount)), page(3, " \n")))
        .when(sort == 4, F.array(page(1, filled(120))))
        .when(sort == 5, F.array(page(1, "Total Assets: 7\n" + filled(400)), page(2, "Net Revenue：12")))
        .otherwise(F.array(page(1, filled(200))))
    )
    rows = filings(spark, d).select("doc_id", F.inline(pages))
    return enhance.extracted(rows, filing_tables_of(spark, d).filter("cast(doc_id as bigint) % 6 in (4, 5)"))


@query(f"WITH {ENHANCED_SQL} SELECT doc_id, confidence, note, unnest(CASE WHEN len(found) = 0 THEN ['-'] ELSE list_transform(found, lambda p: p.f) END) AS field, unnest(CASE WHEN len(found) = 0 THEN [-1.0::DOUBLE] ELSE list_transform(found, lambda p: p.v) END) AS value FROM enhanced")
def enhance_run(spark, d):
    return enhanced_filings(spark, d).select("doc_id", "confidence", "note", F.coalesce("field", F.lit("-")).alias("field"), F.coalesce("value", F.lit(-1.0)).alias("value"))


@query(f"WITH {ENHANCED_SQL} SELECT doc_id, 'x' AS source, '2024-05-01' AS enhanced_at, 'smart_v2.1' AS processor_version, confidence FROM enhanced")
def enhance_stamps(spark, d):
    """The enhanced records' metadata, the old confidence overwritten."""
    records = filings(spark, d).select("doc_id", F.from_json(F.lit('{"source": "x", "confidence": "none"}'), "map<string,string>").alias("metadata"))
    out = enhance.stamped(records, enhanced_filings(spark, d), "2024-05-01")
    return out.select("doc_id", *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("source", "enhanced_at", "processor_version", "confidence")])


@query(f"""
WITH {LINE_VALUES_SQL}, kept AS (SELECT * FROM line_values WHERE field <> 'equity' OR value >= 1000),
got AS (SELECT doc_id, list(field ORDER BY field) AS fields FROM kept GROUP BY doc_id)
SELECT doc_id, CAST(len(fields) AS BIGINT) AS fields_found, CAST(11 AS BIGINT) AS total_possible_fields, array_to_string(list_transform(fields, lambda f: f || '=1.0'), ',') AS field_confidence, array_to_string(list_transform(fields, lambda f: f || '=text'), ',') AS field_source,
  array_to_string(list_filter(['net_revenue', 'gross_profit', 'operating_income', 'net_income', 'eps', 'cash_and_equivalents', 'accounts_receivable', 'inventory', 'total_assets', 'total_liabilities', 'equity'], lambda f: NOT list_contains(fields, f)), ',') AS missing_fields FROM got
""")
def extraction_summary(spark, d):
    out = extract.extraction_summary(extract.smart_fields(line_texts(spark, d, 100)))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.withColumns({"field_confidence": said("field_confidence"), "field_source": said("field_source"), "missing_fields": F.array_join("missing_fields", ",")})


def backfill_input(spark, d) -> tuple[DataFrame, DataFrame]:
    as_map = lambda c: F.from_json(c, "map<string,string>")
    number = F.col("doc_id").cast("string")
    first = F.concat(F.lit('{"equity": {"value": '), F.col("n_chars").cast("string"), F.lit('}, "currency": "TWD", "eps": '), F.when(F.col("doc_id") % 2 == 0, "null").otherwise(number), F.lit("}"))
    income, last = F.when(F.col("doc_id") % 3 == 0, '{"eps": 2.5}').otherwise("{}"), F.when(F.col("doc_id") % 5 == 0, '{"equity": null}').otherwise("{}")
    page = F.when(F.col("doc_id") % 7 == 0, F.array(as_map(F.lit('{"inventory": 8}')))).otherwise(F.array().cast("array<map<string,string>>"))
    enhanced = read(spark, d, "documents").select(number.alias("stem"), as_map(first).alias("financial_data"), as_map(income).alias("income_statement"), as_map(last).alias("financials"), page.alias("page_data"))
    originals = read(spark, d, "labels").select(number.alias("stem"), as_map(F.lit('{"equity": "1", "inventory": "2"}')).alias("financials"), as_map(F.lit("{}")).alias("income_statement"), as_map(F.lit('{"source": "x"}')).alias("metadata"))
    return enhanced, originals


@query("""
SELECT CAST(d.doc_id AS VARCHAR) AS stem, CASE WHEN d.doc_id % 5 = 0 THEN '1' ELSE CAST(n_chars AS VARCHAR) END AS equity, CASE WHEN d.doc_id % 7 = 0 THEN '8' ELSE '2' END AS inventory,
  CASE WHEN d.doc_id % 3 = 0 THEN '2.5' WHEN d.doc_id % 2 = 0 THEN 'absent' ELSE CAST(d.doc_id AS VARCHAR) END AS eps, 'x' AS source, '2024-05-01' AS last_backfill, 'smart_processor_enhanced' AS backfill_source,
  CAST(1 + CASE WHEN d.doc_id % 5 = 0 THEN 0 ELSE 1 END + CASE WHEN d.doc_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN d.doc_id % 3 = 0 OR d.doc_id % 2 <> 0 THEN 1 ELSE 0 END AS VARCHAR) AS enhanced_fields_count
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
def batch_backfill(spark, d):
    updated, _, _ = enhance.batch_backfill(*backfill_input(spark, d), "2024-05-01")
    get = lambda c, k: F.try_element_at(c, F.lit(k)).alias(k)
    eps = F.when(F.map_contains_key("income_statement", "eps"), F.try_element_at("income_statement", F.lit("eps"))).otherwise("absent").alias("eps")
    return updated.select("stem", get("financials", "equity"), get("financials", "inventory"), eps, *[get("metadata", k) for k in ("source", "last_backfill", "backfill_source", "enhanced_fields_count")])


@query("""
SELECT doc_id || '_enhanced.json' AS enhanced_file, doc_id || '.json' AS original_file, doc_id IN (SELECT doc_id FROM labels) AS success,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '成功回填財務數據' ELSE '找不到原始檔案: ' || doc_id || '.json' END AS message FROM documents
""")
def backfill_results(spark, d):
    return enhance.batch_backfill(*backfill_input(spark, d), "2024-05-01")[1]


@query("""
SELECT c_custkey, array_to_string(list_filter([
    CASE WHEN 2015 + c_nationkey > 2030 THEN '報告年度應在合理範圍內(2000-2030) (值太大: ' || (2015 + c_nationkey) || ')' END, CASE WHEN c_custkey % 3 = 0 THEN '毛利不應大於營收' END, CASE WHEN c_custkey % 4 = 0 THEN '營業利益不應大於毛利' END], lambda x: x IS NOT NULL), ';') AS errors,
  CASE WHEN abs(2020 - (2015 + c_nationkey)) > 2 THEN '報告年度(' || (2015 + c_nationkey) || ')與建立時間(2020)差距過大' ELSE '' END AS time_warning,
  array_to_string(list_filter(['建議重新處理PDF以提取更完整的財務數據', CASE WHEN c_custkey * 40000 > 20000000 THEN 'PDF檔案較大，建議檢查是否包含不必要的圖片或內容' WHEN c_custkey * 40000 < 100000 THEN 'PDF檔案較小，可能內容不完整' END], lambda x: x IS NOT NULL), ';') AS suggestions
FROM customer
""")
def order_checks(spark, d):
    """Gross above revenue, operating above gross, years apart, suggestions."""
    text = lambda c: c.cast("string")
    figures = F.create_map(F.lit("net_revenue"), F.lit("100"), F.lit("gross_profit"), F.when(F.col("c_custkey") % 3 == 0, "101").otherwise("90"), F.lit("operating_income"), F.when(F.col("c_custkey") % 4 == 0, "102").otherwise("5"))
    metadata = F.create_map(F.lit("created_at"), F.lit("2020-03-04T05:06:07Z"), F.lit("file_size"), text(F.col("c_custkey") * 40000))
    rows = read(spark, d, "customer").select(
        "c_custkey", F.lit("2330").alias("stock_code"), F.col("c_name").alias("company_name"), (F.col("c_nationkey") + 2015).alias("report_year"), F.lit("Q1").alias("report_season"), figures.alias("financials"),
        figures.alias("income_statement"), figures.alias("balance_sheet"), metadata.alias("metadata"),
    )
    out = validate.validated(rows)
    apart = F.array_join(F.filter("warnings", lambda m: F.contains(m, F.lit("差距過大"))), ";")
    return out.select("c_custkey", F.array_join("errors", ";").alias("errors"), apart.alias("time_warning"), F.array_join("suggestions", ";").alias("suggestions"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2024Q1' WHEN o_orderkey % 3 = 1 THEN '2023Q4' ELSE '未知' END AS report_period, o_orderkey % 2 + 2 + 9 AS n_keys, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS n_values FROM orders".replace("o_orderkey % 2 + 2 + 9", "CAST(13 AS BIGINT)").replace("CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END", "CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 3 END AS BIGINT)"))
def completed_records(spark, d):
    """Period, currency, unit and the union of the sections."""
    of = lambda fs, eps=None: F.struct(*[(eps if f == "eps" and eps is not None else F.lit(None).cast("double")).alias(f) for f in fs])
    eps = F.when(F.col("o_orderkey") % 2 == 1, F.lit(1.5))
    rows = read(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 2024).alias("report_year"), F.lit("Q1").alias("report_season"), F.when(F.col("o_orderkey") % 3 == 1, "202311_2330_AI1.pdf").otherwise("scan.pdf").alias("file_name"),
        of(FINANCIALS).alias("financials"), of(INCOME_STATEMENT, eps).alias("income_statement"),
    )
    out = merge.complete(rows)
    return out.select("o_orderkey", "report_period", F.size("financial_data").cast("long").alias("n_keys"), merge.non_null_count(F.col("financial_data")).alias("n_values"))


@query("SELECT c_custkey AS id, c_name AS crawled_at FROM customer ORDER BY crawled_at DESC, id")
def catalog_by_crawl(spark, d):
    return catalog.by_crawl(read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("crawled_at")))


@query("SELECT n_name, (SELECT greatest(count(*) - 10, 0) FROM nation) AS n_more FROM nation ORDER BY n_name LIMIT 10")
def display_limit(spark, d):
    return catalog.shown(read(spark, d, "nation").select("n_name"), ["n_name"])


@query("SELECT l_orderkey, l_linenumber, l_quantity * 8 - l_quantity AS remaining FROM lineitem")
def remaining_time(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", catalog.remaining_seconds(F.col("l_quantity"), F.lit(1), F.lit(8)).alias("remaining"))


# JSON made of orders, the same text in both engines.
RECORDS_JSON = """concat('{"a": {"b": ', o_orderkey, ', "x": null, "l": [1,', o_custkey, '], "e": {}, "s": "', o_orderstatus, '"}, "n": ', o_custkey % 100, '.5, "t": true}')"""


@query(f"""
SELECT o_orderkey, path, CASE json_type(j, '$.' || path) WHEN 'NULL' THEN 'null' WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'OBJECT' THEN 'dict' WHEN 'ARRAY' THEN 'list' ELSE 'absent' END AS kind,
  coalesce(CASE WHEN json_type(j, '$.' || path) = 'BOOLEAN' THEN 'True' ELSE json_extract_string(j, '$.' || path) END, '-') AS value
FROM (SELECT o_orderkey, unnest(['a.b', 'a.x', 'a.l', 'a.e', 'a.s', 'n', 't', 'a.z', 'n.b', 'z.b']) AS path, {RECORDS_JSON}::JSON AS j FROM orders)
""")
def record_paths(spark, d):
    """Values and JSON types at paths that are data."""
    rows = read(spark, d, "orders").select("o_orderkey", variant.parsed(F.expr(RECORDS_JSON)).alias("record"))
    found = variant.paths(rows, ["o_orderkey"], ["a.b", "a.x", "a.l", "a.e", "a.s", "n", "t", "a.z", "n.b", "z.b"])
    return found.withColumn("value", F.coalesce("value", F.lit("-")))


# The rules' messages.
@query("""
SELECT c_custkey, array_to_string(list_filter([
    CASE WHEN c_custkey % 9 = 0 THEN '股票代碼為必要欄位' END, CASE WHEN c_custkey % 9 <> 0 AND NOT regexp_full_match(c_custkey::VARCHAR, '[0-9]{4}') THEN '股票代碼應為4位數字 (格式不符: ' || c_custkey || ')' END,
    CASE WHEN c_custkey % 5 = 0 THEN '公司名稱為必要欄位' END,
    CASE c_custkey % 8 WHEN 1 THEN '報告年度應為整數 (實際類型: str)' WHEN 2 THEN '報告年度應為整數 (實際類型: float)' WHEN 5 THEN '報告年度應為整數 (實際類型: dict)' WHEN 6 THEN '報告年度應為整數 (實際類型: list)' END,
    CASE c_custkey % 8 WHEN 0 THEN CASE WHEN c_nationkey * 3 + 1980 < 2000 THEN '報告年度應在合理範圍內(2000-2030) (值太小: ' || (c_nationkey * 3 + 1980) || ')' WHEN c_nationkey * 3 + 1980 > 2030 THEN '報告年度應在合理範圍內(2000-2030) (值太大: ' || (c_nationkey * 3 + 1980) || ')' END
      WHEN 1 THEN '驗證規則執行錯誤: ''<'' not supported between instances of ''str'' and ''int''' WHEN 2 THEN '報告年度應在合理範圍內(2000-2030) (值太大: 2030.5)' WHEN 3 THEN '報告年度應在合理範圍內(2000-2030) (值太小: True)'
      WHEN 5 THEN '驗證規則執行錯誤: ''<'' not supported between instances of ''dict'' and ''int''' WHEN 6 THEN '驗證規則執行錯誤: ''<'' not supported between instances of ''list'' and ''int''' END], lambda x: x IS NOT NULL), ';') AS errors,
  array_to_string(list_filter([CASE c_custkey % 3 WHEN 0 THEN '財務數據欄位為必要' WHEN 1 THEN '財務數據欄位為必要 (欄位為空)' END, '損益表數據為必要', '資產負債表數據為必要',
    CASE WHEN c_custkey % 3 = 2 AND c_custkey * 40 < 10000 THEN '檔案大小異常 (值太小: ' || c_custkey * 40 || ')' END, CASE WHEN c_custkey % 4 = 1 THEN '淨利應為數字 (實際類型: str)' END], lambda x: x IS NOT NULL), ';') AS warnings
FROM customer
""")
def record_rules(spark, d):
    """The rules, and one on a nested figure, by the JSON types of records."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    key = F.col("c_custkey")
    code = F.when(key % 9 == 0, F.when(key % 2 == 0, "null").otherwise(F.lit(None))).otherwise(quoted(key.cast("string")))
    name = F.when(key % 5 == 0, "null").otherwise(quoted(F.col("c_name")))
    year = F.when(key % 8 == 0, (F.col("c_nationkey") * 3 + 1980).cast("string")).when(key % 8 == 1, '"2024"').when(key % 8 == 2, "2030.5").when(key % 8 == 3, "true").when(key % 8 == 4, "null").when(key % 8 == 5, '{"y": 2024}').when(key % 8 == 6, "[2024]")
    figures = F.when(key % 3 == 0, "null").when(key % 3 == 1, "{}").otherwise('{"equity": 5}')
    size = F.when(key % 3 == 2, (key * 40).cast("string"))
    income = F.when(key % 4 == 0, "7.5").when(key % 4 == 1, '"7.5"')
    part = lambda k, v: F.concat(F.lit(f'"{k}": '), v)
    whole = lambda *parts: F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    json = whole(part("stock_code", code), part("company_name", name), part("report_year", year), part("report_season", F.lit('"Q1"')), part("financials", figures), part("metadata", whole(part("file_size", size))), part("cash", whole(part("deep", whole(part("net", income))))))
    rows = read(spark, d, "customer").select("c_custkey", variant.parsed(json).alias("record"))
    rules = (*validate.RULES, validate.Rule("cash.deep.net", "type", "淨利應為數字", "warning", {"type": "float"}))
    return variant.judged(rows, rules).select("c_custkey", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"))


@query(r"""
SELECT o_orderkey, CASE WHEN s IN ('1', '2', '3', '4') THEN 'Q' || s ELSE s END AS season, s IN ('1', '2', '3', '4') AS valid, regexp_full_match(o_custkey::VARCHAR, '[0-9]{4}') AS valid_code,
  CASE WHEN size = 0 THEN '0 B' WHEN size < 1024 THEN size || '.0 B' WHEN size < 1048576 THEN round(size::DECIMAL(20, 6) / 1024, 2)::DOUBLE || ' KB' ELSE round(size::DECIMAL(20, 6) / 1048576, 2)::DOUBLE || ' MB' END AS label
FROM (SELECT o_orderkey, o_custkey, (o_orderkey % 6)::VARCHAR AS s, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS size FROM orders)
""")
def sql_functions(spark, d):
    """The functions in SQL text."""
    session.register(spark)
    return spark.sql(
        """SELECT o_orderkey, normalize_season(s) AS season, validate_season(s) AS valid, validate_stock_code(CAST(o_custkey AS STRING)) AS valid_code, file_size_label(size) AS label
        FROM (SELECT o_orderkey, o_custkey, concat('q', o_orderkey % 6) AS s, CAST(floor(o_totalprice) AS BIGINT) * (o_orderkey % 40) AS size FROM {orders})""",
        orders=read(spark, d, "orders"),
    )


@query("SELECT c_custkey::VARCHAR AS id, c_name AS company_name FROM customer WHERE contains(lower(c_name), 'r#00') AND c_nationkey = 7 AND c_custkey % 5 = 2")
def sql_search(spark, d):
    """The catalog search as a table function."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("stock_code"), F.col("c_name").alias("company_name"), F.col("c_nationkey").alias("year"), F.concat(F.lit("Q"), (F.col("c_custkey") % 5).cast("string")).alias("season"))
    session.register_catalog(spark, rows)
    return spark.sql("SELECT id, company_name FROM search_reports('', 'R#00', 7, 'q2')")


@query("""
WITH log AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'view' THEN 'paths' ELSE 'status' END AS kind, event_type FROM events),
live AS (SELECT log.* FROM log JOIN (SELECT id, max(seq) AS since FROM log WHERE kind = 'create' GROUP BY id) c USING (id) WHERE seq >= since)
SELECT id, coalesce(arg_max(event_type, seq) FILTER (kind = 'status'), 'pending') AS status, coalesce('p' || max(seq) FILTER (kind = 'paths') || '.pdf', '-') AS pdf_path,
  coalesce('j' || max(seq) FILTER (kind = 'paths' AND seq % 2 = 0) || '.json', '-') AS json_path FROM live GROUP BY id
""")
def event_fold_paths(spark, d):
    """Each path is the last one given since the task's last create."""
    kind = F.col("event_type")
    log = read(spark, d, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(kind == "signup", "create").when(kind == "view", "paths").otherwise("status").alias("kind"), kind.alias("status"), F.lit("").alias("error_message"), F.lit(0.0).alias("processing_time"),
        F.when(kind == "view", F.concat(F.lit("p"), F.col("event_id").cast("string"), F.lit(".pdf"))).alias("pdf_path"), F.when((kind == "view") & (F.col("event_id") % 2 == 0), F.concat(F.lit("j"), F.col("event_id").cast("string"), F.lit(".json"))).alias("json_path"),
    )
    return tracking.folded(log).select("id", "status", F.coalesce("pdf_path", F.lit("-")).alias("pdf_path"), F.coalesce("json_path", F.lit("-")).alias("json_path"))


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' ELSE 'processed' END AS status FROM events")
def known_statuses(spark, d):
    kind = F.col("event_type")
    rows = read(spark, d, "events").select("event_id", F.when(kind == "error", "failed").when(kind == "signup", "pending").otherwise("processed").alias("status"))
    return tracking.known_statuses(rows)


@query("SELECT o_orderkey, 'data/' || o_custkey || '/' || o_orderkey || '_AI1.pdf' AS path, o_orderkey || '_AI1.json' AS json_file, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || '.txt' ELSE o_orderkey || '.json' END AS swapped FROM orders")
def path_names(spark, d):
    key, back = F.col("o_orderkey").cast("string"), F.lit("\\")
    path = F.concat(F.lit("data"), back, F.col("o_custkey").cast("string"), F.lit("/"), key, F.lit("_AI1.pdf"))
    mixed = F.concat(key, F.when(F.col("o_orderkey") % 2 == 0, ".txt").otherwise(".pdf"))
    return read(spark, d, "orders").select("o_orderkey", T.forward_slashes(path).alias("path"), T.swap_suffix(F.concat(key, F.lit("_AI1.pdf")), ".pdf", ".json").alias("json_file"), T.swap_suffix(mixed, ".pdf", ".json").alias("swapped"))


@query(r"""
SELECT page_id, position, CASE WHEN regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN u WHEN starts_with(u, '/') THEN 'https://h.example' || u ELSE 'https://h.example/x/' || u END AS url FROM (
  SELECT page_id, CAST(unnest(range(len(l))) AS BIGINT) AS position, unnest(l) AS u FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']*/[^"'']*)["''][^>]*>([^<]*)</a>', 1) AS l FROM pages))
""")
def absolute_links(spark, d):
    found = extract.document_links(read(spark, d, "pages"), "/", "/")
    return found.select("page_id", F.col("position").cast("long").alias("position"), T.absolute_url(F.col("url"), "https://h.example/x/y").alias("url"))


@query("SELECT count(*) AS total_reports, count(DISTINCT code) AS n_codes, array_to_string(list_sort(list(DISTINCT code)), ',') AS codes, max(c_name) AS last_updated FROM (SELECT c_name, CASE WHEN c_custkey % 11 = 0 THEN 'x' || c_custkey % 4 WHEN c_custkey % 7 <> 0 THEN lpad((c_custkey * 37 % 10000)::VARCHAR, 4, '0') END AS code FROM customer)")
def catalog_codes(spark, d):
    """Codes of four digits and others, and missing ones."""
    key = F.col("c_custkey")
    code = F.when(key % 11 == 0, F.concat(F.lit("x"), (key % 4).cast("string"))).when(key % 7 != 0, F.lpad((key * 37 % 10000).cast("string"), 4, "0"))
    return catalog.stats(read(spark, d, "customer").select(code.alias("stock_code"), "c_name"), updated="c_name").withColumn("codes", F.array_join("codes", ","))


@query("SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.net/e')")
def name_search_indexed(spark, d):
    """The search in names by posting lists of trigrams."""
    rows = read(spark, d, "pages").select("page_id", "url")
    return catalog.found_by_index(rows, catalog.name_index(rows, "page_id", "url"), "Example.NET/e", "page_id", "url")
