"""Every registered query of the engine over the driver's tables, with its SQL counterpart where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import issues as I
from .operators import matching, merge, relations, selection, shaping, suggest, summaries, vocabulary
from .plans import layout, records
from .sources import archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with DuckDB SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; Python workers are told where this package lies."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scalars -----------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN lower(x) IN ('', 'n/a', 'na', '-', '.') THEN NULL ELSE sha256(x) END AS clean_hash
FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS x FROM documents)""")
def clean_text_null_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.null_if_empty_like(F.col("text")), 256).alias("clean_hash"))


@query("""SELECT doc_id, e AS email, count(*) AS n FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(lower(text), '\\b[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}\\b')), '[.,;:]+$', '') AS e FROM documents) GROUP BY ALL""")
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter(F.col("text").contains("@"))
    return docs.select("doc_id", F.explode(T.emails_inside(F.col("text"))).alias("email")).groupBy("doc_id", "email").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, p AS phone, CASE WHEN length(d) = 12 AND starts_with(d, '44') THEN regexp_replace(regexp_replace('0' || d[3:], '^(020)([0-9]{4})([0-9]{4})$', '\\1 \\2 \\3'), '^(0[0-9]{4})([0-9]{6})$', '\\1 \\2')
WHEN length(d) = 11 AND starts_with(d, '0') THEN regexp_replace(regexp_replace(d, '^(020)([0-9]{4})([0-9]{4})$', '\\1 \\2 \\3'), '^(0[0-9]{4})([0-9]{6})$', '\\1 \\2') ELSE p END AS shown,
NOT coalesce((length(d) IN (10, 11) AND starts_with(d, '0')) OR (length(d) = 12 AND starts_with(d, '44')), false) AS invalid
FROM (SELECT doc_id, p, regexp_replace(p, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\\+?[0-9][0-9 ()-]{8,16}[0-9]')), ' +', ' ', 'g') AS p FROM documents))""")
def phone_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers inside texts, cleaned as a phone cell would be."""
    found = F.explode(F.transform(F.regexp_extract_all("text", F.lit(r"\+?[0-9][0-9 ()-]{8,16}[0-9]"), 0), lambda p: F.regexp_replace(p, " +", " ")))
    each = read(spark, sf_dir, "documents").select("doc_id", found.alias("phone")).withColumn("c", T.uk_phone(F.col("phone")))
    return each.select("doc_id", "phone", F.col("c.value").alias("shown"), (F.col("c.status") == "invalid").alias("invalid"))


@query("""SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(
  regexp_replace(coalesce(nullif(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '([^/]+)/*$', 1), ''), url), '([a-z0-9])([A-Z])', '\\1-\\2', 'g')),
  '[ _]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), '') AS slug FROM pages""")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("""SELECT doc_id, CASE quality WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS good, CASE toxic WHEN 1 THEN TRUE WHEN 0 THEN FALSE END AS toxic_flag FROM labels""")
def bool_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").select("doc_id", T.yes_no(F.col("quality"))["value"].alias("good"), T.yes_no(F.col("toxic"))["value"].alias("toxic_flag"))


@query("""SELECT event_id, format('{:02d}:{:02d}', hour(ts), minute(ts)) AS at FROM events""")
def time_of_day_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", T.time_parts(F.date_format("ts", "HH"), F.date_format("ts", "mm"))["value"].alias("at"))


@query("""SELECT p_partkey, (i - 1)::INTEGER AS pos, parts[i] AS part FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS parts FROM part), unnest(range(1, len(parts) + 1)) AS u(i)""")
def multiselect_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = T.multiselect(F.replace("p_name", F.lit(" "), F.lit(";")))
    return read(spark, sf_dir, "part").select("p_partkey", F.posexplode(parts).alias("pos", "part"))


@query("""SELECT n_nationkey, 'nation-' || substr(sha256(n_nationkey || '|' || n_name), 1, 16) AS stable_id FROM nation""")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", T.stable_id("nation", F.col("n_nationkey"), F.col("n_name")).alias("stable_id"))


@query("""SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS h FROM nation""")
def canonical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").select("n_nationkey", T.canonical_hash(F.struct("n_nationkey", "n_name")).alias("h"))


@query("""SELECT event_id, (props::JSON->>'$.k')::BIGINT AS k FROM events""")
def json_prop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""SELECT event_type, count(*) AS n, coalesce(round(100.0 * count(*) FILTER (value > 50) / nullif(count(*), 0), 1), 0)::DOUBLE AS share FROM events GROUP BY 1""")
def percentage_1dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    return got.select("event_type", "n", T.percentage(F.col("k").cast("double"), F.col("n").cast("double")).alias("share"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_size // 10 WHEN p_size % 3 = 1 THEN p_size ELSE p_size * 100 END::INTEGER AS cm FROM part
WHERE CASE WHEN p_size % 3 = 0 THEN p_size // 10 WHEN p_size % 3 = 1 THEN p_size ELSE p_size * 100 END >= 1""")
def measurement_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("p_size") % 3 == 0, " mm").when(F.col("p_size") % 3 == 1, "cm").otherwise(" m")
    cm = T.measurement(F.concat(F.col("p_size").cast("string"), unit), T.WIDTH_UNITS)
    return read(spark, sf_dir, "part").select("p_partkey", cm.alias("cm")).filter("cm is not null")


# --- selection ---------------------------------------------------------------

def _newest() -> list:
    return [F.desc_nulls_last("ts"), F.desc("event_id")]


@query("""SELECT event_type, count(*) FILTER (r = 1) AS kept, count(*) FILTER (r > 1) AS superseded
FROM (SELECT event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) GROUP BY 1""")
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return selection.selection_counts(selection.with_selection(events, ["user_id", "event_type"], _newest(), "event_id"), ["event_type"])


@query("""SELECT event_id, superseded_by FROM (SELECT event_id, row_number() OVER w AS r, first(event_id) OVER w AS superseded_by FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC)) WHERE r > 1""")
def superseded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return selection.with_selection(events, ["user_id", "event_type"], _newest(), "event_id").filter("selection_status = 'superseded'").select("event_id", "superseded_by")


@query("""SELECT user_id, event_type, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS event_id FROM events GROUP BY ALL""")
def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return selection.latest_wins(events, ["user_id", "event_type"], _newest()).select("user_id", "event_type", "event_id")


@query("""SELECT sha256(text) AS key, count(*) AS members, min(doc_id) AS first_row, max(doc_id) AS last_row FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), F.sha2("text", 256), "doc_id")


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END AS group_size FROM documents""")
def duplicate_flag_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return selection.with_group_size(docs, "key").select("doc_id", "group_size")


@query("""SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r = 1""")
def stable_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey")
    return selection.first_per_key(customers, F.struct("c_mktsegment", "c_nationkey"), F.col("c_custkey")).select("c_mktsegment", "c_custkey")


@query("""SELECT user_id, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at FROM events GROUP BY 1""")
def shard_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = relations.latest_state(read(spark, sf_dir, "events"), ["user_id"], ["event_type", "ts"], ["ts", "event_id"])
    return got.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


# --- profiles, issues, status ------------------------------------------------

_PROFILED = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (lower(trim({c}::VARCHAR)) NOT IN ('', 'n/a', 'na', '-', '.')) AS non_empty, count(*) - count(*) FILTER (lower(trim({c}::VARCHAR)) NOT IN ('', 'n/a', 'na', '-', '.')) AS empty FROM customer" for c in _PROFILED))
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.column_profile(read(spark, sf_dir, "customer"), T.is_empty_like, _PROFILED)


def _customer_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    owing = I.issue("c_acctbal", "NEGATIVE_BALANCE", "warning", "balance below zero", F.format_string("%.2f", "c_acctbal"))
    rich = I.issue("c_acctbal", "HIGH_BALANCE", "info", "balance above 9000", F.format_string("%.2f", "c_acctbal"))
    segment = I.issue("c_mktsegment", "VOCAB_NO_MATCH", "warning", "segment is not served", F.col("c_mktsegment"))
    nation = I.issue("c_nationkey", "MISSING_COURT_IDENTIFIER", "error", "nation 0 is reserved", F.col("c_nationkey").cast("string"))
    found = I.rules((F.col("c_acctbal") < 0, owing), (F.col("c_acctbal") > 9000, rich), (F.col("c_mktsegment") == "MACHINERY", segment), (F.col("c_nationkey") == 0, nation))
    return read(spark, sf_dir, "customer").select("c_custkey", found.alias("issues"))


_ISSUES_SQL = """issues AS (
SELECT c_custkey, 'c_acctbal' AS field, 'NEGATIVE_BALANCE' AS code, 'warning' AS severity, printf('%.2f', c_acctbal) AS raw_value FROM customer WHERE c_acctbal < 0 UNION ALL
SELECT c_custkey, 'c_acctbal', 'HIGH_BALANCE', 'info', printf('%.2f', c_acctbal) FROM customer WHERE c_acctbal > 9000 UNION ALL
SELECT c_custkey, 'c_mktsegment', 'VOCAB_NO_MATCH', 'warning', c_mktsegment FROM customer WHERE c_mktsegment = 'MACHINERY' UNION ALL
SELECT c_custkey, 'c_nationkey', 'MISSING_COURT_IDENTIFIER', 'error', c_nationkey::VARCHAR FROM customer WHERE c_nationkey = 0)"""


@query(f"WITH {_ISSUES_SQL} SELECT c_custkey, field, code, severity, raw_value FROM issues")
def issue_report_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.report(_customer_issues(spark, sf_dir), "c_custkey").select("c_custkey", "field", "code", "severity", "raw_value")


@query(f"""WITH {_ISSUES_SQL} SELECT c.c_custkey, CASE WHEN coalesce(bool_or(severity = 'error'), false) THEN 'failed' WHEN coalesce(bool_or(code = 'VOCAB_NO_MATCH'), false) THEN 'needs_human_review'
WHEN coalesce(bool_or(severity = 'warning'), false) THEN 'processed_with_warnings' ELSE 'processed' END AS status FROM customer c LEFT JOIN issues i ON c.c_custkey = i.c_custkey GROUP BY 1""")
def status_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_issues(spark, sf_dir).select("c_custkey", I.status(F.col("issues")).alias("status"))


@query(f"WITH {_ISSUES_SQL} SELECT code, severity, count(*) AS n FROM issues GROUP BY ALL")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.counts_by_code(_customer_issues(spark, sf_dir))


@query(f"WITH {_ISSUES_SQL} SELECT c.c_custkey, (count(i.code) FILTER (i.code NOT IN ('VOCAB_NO_MATCH', 'MISSING_COURT_IDENTIFIER')))::INTEGER AS n FROM customer c LEFT JOIN issues i ON c.c_custkey = i.c_custkey GROUP BY 1")
def issues_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = I.add_once(F.col("issues"), F.col("issues"))
    return _customer_issues(spark, sf_dir).select("c_custkey", F.size(I.without_codes(twice)).alias("n"))


@query("""SELECT o_orderstatus, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent,
sum(o_totalprice::DECIMAL(18,2))::DECIMAL(38,2)::VARCHAR AS total FROM orders GROUP BY 1""")
def summary_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").cast("string").alias("total"))


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'not_applicable' WHEN count(l_orderkey) = count(*) FILTER (l_linestatus = 'F') THEN 'ready' WHEN count(*) FILTER (l_linestatus = 'F') > 0 THEN 'partially_ready' ELSE 'pending' END AS readiness
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def readiness_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("r"))
    both = read(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.select("o_orderkey", summaries.readiness(F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))).alias("readiness"))


# --- vocabularies and joins --------------------------------------------------

# An ordered vocabulary with an alias that two entries share and one entry without an id.
PRIORITIES = [(0, "urgent", "1-URGENT", "p1", ["top"]), (1, "high", "2-HIGH", "p2", ["top"]), (2, "medium", "3-MEDIUM", None, ["mid"]), (3, "low", "5-LOW", "p5", [])]


def _priorities(spark: SparkSession) -> DataFrame:
    rows = [("priority", *p) for p in PRIORITIES]
    return spark.createDataFrame(rows, "vocabulary string, position int, code string, name string, api_id string, aliases array<string>")


_VOCAB_SQL = "(VALUES (0, 'urgent', '1-urgent', 'p1'), (1, 'high', '2-high', 'p2'), (2, 'medium', '3-medium', NULL), (3, 'low', '5-low', 'p5')) AS v(position, code, term, api_id)"


@query(f"SELECT o_orderkey, v.code, v.api_id FROM orders LEFT JOIN {_VOCAB_SQL} ON lower(o_orderpriority) = v.term")
def vocab_match_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return vocabulary.match(orders, F.col("o_orderpriority"), _priorities(spark), "priority").select("o_orderkey", "code", "api_id")


@query(f"SELECT o_orderpriority, count(*) AS n FROM orders WHERE lower(o_orderpriority) NOT IN (SELECT term FROM {_VOCAB_SQL}) GROUP BY 1")
def vocab_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderpriority")
    return vocabulary.unmatched(orders, F.col("o_orderpriority"), _priorities(spark), "priority").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""SELECT o_custkey, string_agg(coalesce(v.api_id, '?'), ',' ORDER BY o_orderkey) AS ids, coalesce(arg_min(CASE WHEN v.code IS NULL THEN 'not in vocabulary: ' || o_orderpriority WHEN v.api_id IS NULL THEN 'no id: ' || o_orderpriority END, o_orderkey) , '') AS reason
FROM orders LEFT JOIN {_VOCAB_SQL} ON lower(o_orderpriority) = v.term GROUP BY 1""")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("values"))
    got = vocabulary.ids_of(listed, "o_custkey", "values", _priorities(spark), "priority")
    return got.select("o_custkey", F.array_join("ids", ",", "?").alias("ids"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("""SELECT 'kept' AS side, count(*) AS n, coalesce(sum(c_custkey), 0)::BIGINT AS keys FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT 'excluded', count(*), coalesce(sum(c_custkey), 0)::BIGINT FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def semi_anti_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    having = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    kept, gone = relations.excluded(read(spark, sf_dir, "customer").select("c_custkey"), having, "c_custkey")
    total = lambda df, name: df.agg(F.count("*").alias("n"), F.coalesce(F.sum("c_custkey"), F.lit(0)).alias("keys")).select(F.lit(name).alias("side"), "n", "keys")
    return total(kept, "kept").unionByName(total(gone, "excluded"))


@query("""SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def lookup_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    named = relations.looked_up(s, read(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey")
    return relations.looked_up(named, read(spark, sf_dir, "region"), "n_regionkey", "r_regionkey").select("s_suppkey", "n_name", "r_name")


@query("""WITH paths AS (SELECT DISTINCT 'corpus.' || source || '.text' AS path FROM documents), wanted(w) AS (VALUES ('corpus.src1'), ('corpus.src2.text'), ('corpus.src3.text[1]'), ('corpus.src'))
SELECT path, w AS wanted FROM paths, wanted WHERE path = w OR starts_with(path, w || '.') OR starts_with(path, w || '[') OR starts_with(w, path || '.') OR starts_with(w, path || '[')""")
def path_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = read(spark, sf_dir, "documents").select(F.concat(F.lit("corpus."), "source", F.lit(".text")).alias("path")).filter("path is not null").distinct()
    wanted = spark.createDataFrame([("corpus.src1",), ("corpus.src2.text",), ("corpus.src3.text[1]",), ("corpus.src",)], "wanted string")
    # Two paths overlap when one is among the other's ancestors: two equi-joins instead of a test of all pairs.
    down = paths.withColumn("a", F.explode(relations.ancestors(F.col("path")))).join(wanted, F.col("a") == F.col("wanted")).select("path", "wanted")
    up = wanted.withColumn("a", F.explode(relations.ancestors(F.col("wanted")))).join(paths, F.col("a") == F.col("path")).select("path", "wanted")
    return down.unionByName(up).distinct()


# --- shaping -----------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, (i - 1 + 1)::INTEGER AS index, v AS amount FROM (SELECT l_orderkey, l_linenumber, [l_discount, l_tax, CASE WHEN l_quantity > 25 THEN l_quantity END] AS a FROM lineitem), unnest(range(1, 4)) AS u(i), unnest([a[i]]) AS w(v) WHERE v IS NOT NULL""")
def wide_to_array_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = [{"amount": F.col("l_discount")}, {"amount": F.col("l_tax")}, {"amount": F.when(F.col("l_quantity") > 25, F.col("l_quantity"))}]
    folded = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", shaping.fold_groups(groups, ["amount"]).alias("g"))
    return folded.select("l_orderkey", "l_linenumber", F.explode("g").alias("x")).select("l_orderkey", "l_linenumber", "x.index", "x.amount")


@query("""SELECT l_orderkey, l_linenumber, day, value FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS MONDAY, l_linestatus AS TUESDAY FROM lineitem) UNPIVOT (value FOR day IN (MONDAY, TUESDAY))""")
def day_rows_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shaping.day_rows(read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], {"MONDAY": "l_returnflag", "TUESDAY": "l_linestatus"})


@query("""SELECT conv_id, count(*) AS parts, sha256(string_agg(coalesce(text, ''), chr(10) ORDER BY turn)) AS joined FROM conversations GROUP BY 1""")
def repeated_fields_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shaping.regroup(read(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", "\n")
    return got.withColumn("joined", F.sha2("joined", 256))


@query("""SELECT user_id, arg_min(event_type, event_id) AS first_type, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events WHERE event_type IS NOT NULL GROUP BY 1""")
def first_non_null_and_sorted_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").filter("event_type is not null").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("types"))


# --- matching ----------------------------------------------------------------


@query("""WITH pairs AS (SELECT s_suppkey, n_nationkey, 1000 - abs((s_suppkey * 37) % 100 - n_nationkey * 4) AS score FROM supplier JOIN nation ON s_nationkey % 5 = n_regionkey),
ranked AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS nxt FROM pairs WINDOW w AS (PARTITION BY s_suppkey ORDER BY score DESC, n_nationkey))
SELECT s_suppkey, n_nationkey, score::BIGINT AS score, (score - coalesce(nxt, 0))::DOUBLE AS margin, score >= 990 AND (nxt IS NULL OR score - nxt >= 2) AS accepted FROM ranked WHERE r = 1""")
def score_margin_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    pairs = s.join(n, F.col("s_nationkey") % 5 == F.col("n_regionkey")).withColumn("score", 1000 - F.abs((F.col("s_suppkey") * 37) % 100 - F.col("n_nationkey") * 4))
    got = matching.best_with_margin(pairs, ["s_suppkey"], "score", [F.col("n_nationkey")], 990, 2)
    return got.select("s_suppkey", "n_nationkey", "score", F.col("margin").cast("double").alias("margin"), "accepted")


@query("""SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey)::INTEGER AS rank FROM part) WHERE rank <= 10""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.top_candidates(read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], "p_retailprice", [F.col("p_partkey")], 10).select("p_brand", "p_partkey", "rank")


@query()
def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best known name, its margin and whether both suffice, for every part's misspelt name; sequence similarity has no SQL form, so it is tested against difflib.

    Each distinct spelling is scored once against the names there are, all of them: names are a short list, joined by the grams that alike names share.
    """
    part = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("name"))
    typed = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("z"), F.substr("name", F.lit(2)))).otherwise(F.concat(F.substring("name", 1, 3), F.lit("x"), F.substr("name", F.lit(5))))
    asked = part.select("p_partkey", typed.alias("typed"))
    best = matching.best_with_margin(suggest.scored_names(asked.select("typed").distinct(), part.select("name").distinct(), "typed", "name"), ["typed"], "score", [F.col("name")], 0.8, 0.05)
    return asked.join(best, "typed").select("p_partkey", F.col("name").alias("suggested"), "score", "accepted")


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS ws FROM benchmark)
SELECT a.item_id AS item, b.item_id AS other, round(len(list_intersect(a.ws, b.ws))::DOUBLE / nullif(len(a.ws), 0), 6) AS coverage FROM w a JOIN w b ON a.item_id <> b.item_id AND len(list_intersect(a.ws, b.ws)) > 0""")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of an item's words in every other item that shares any: an equi-join on words."""
    return matching.covered_pairs(read(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t")), "item_id", "t").select(F.col("item_id").alias("item"), "other", F.round("coverage", 6).alias("coverage"))


# --- merge, difference, approval ---------------------------------------------


def _submitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Live customers, and a submission that changes some, leaves some out, repeats one in fifty and adds new ones."""
    live = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.round("c_acctbal", 2).alias("c_acctbal"))
    some = live.filter("c_custkey % 3 <> 0")
    changed = some.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 == 0, F.lit("CHANGED")).otherwise(F.col("c_mktsegment")))
    again = changed.filter("c_custkey % 50 = 1")
    new = live.filter("c_custkey % 40 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    return live, changed.unionByName(again).unionByName(new)


_SUBMITTED_SQL = """live AS (SELECT c_custkey, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer),
changed AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM live WHERE c_custkey % 3 <> 0),
submitted AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE c_custkey % 50 = 1 UNION ALL SELECT c_custkey + 10000000, c_mktsegment, c_acctbal FROM live WHERE c_custkey % 40 = 0),
sides AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, a.n AS n_current, b.n AS n_submitted, a.s AS current_segment, b.s AS submitted_segment, a.b AS cb, b.b AS sb FROM
(SELECT c_custkey, count(*) AS n, min(c_mktsegment) AS s, min(c_acctbal) AS b FROM live GROUP BY 1) a FULL JOIN (SELECT c_custkey, count(*) AS n, min(c_mktsegment) AS s, min(c_acctbal) AS b FROM submitted GROUP BY 1) b ON a.c_custkey = b.c_custkey),
ops AS (SELECT *, CASE WHEN coalesce(n_current, 0) > 1 OR coalesce(n_submitted, 0) > 1 THEN 'conflict' WHEN n_submitted IS NULL THEN 'preserve' WHEN n_current IS NULL THEN 'create'
WHEN current_segment IS NOT DISTINCT FROM submitted_segment AND cb IS NOT DISTINCT FROM sb THEN 'no_change' ELSE 'update' END AS operation FROM sides)"""


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    live, new = _submitted(spark, sf_dir)
    return merge.operations(live, new, ["c_custkey"], ["c_mktsegment", "c_acctbal"])


@query(f"WITH {_SUBMITTED_SQL} SELECT c_custkey, operation, CASE WHEN operation = 'conflict' THEN current_segment ELSE coalesce(submitted_segment, current_segment) END AS c_mktsegment FROM ops")
def keyed_merge_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged(_operations(spark, sf_dir), ["c_custkey"], ["c_mktsegment"])


@query(f"WITH {_SUBMITTED_SQL} SELECT operation, count(*) AS n FROM ops GROUP BY 1")
def merge_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operations(spark, sf_dir).groupBy("operation").agg(F.count("*").alias("n"))


@query(f"WITH {_SUBMITTED_SQL} SELECT c_custkey, n_submitted FROM ops WHERE operation = 'conflict'")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _operations(spark, sf_dir).filter("operation = 'conflict'").select("c_custkey", "n_submitted")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'NEW' END, c_mktsegment, 'FALLBACK') END AS segment FROM customer""")
def deep_merge_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    leaf = merge.overlay(F.col("c_mktsegment"), F.when(key % 2 == 0, "NEW"), F.lit("FALLBACK"), key % 7 == 0)
    return read(spark, sf_dir, "customer").select("c_custkey", leaf.alias("segment"))


@query("""SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS before, 'CHANGED' AS after FROM customer WHERE c_custkey % 5 = 0 AND c_mktsegment IS DISTINCT FROM 'CHANGED'
UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR FROM customer WHERE c_custkey % 4 = 0 AND c_nationkey IS NOT NULL""")
def path_value_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    key = F.col("c_custkey")
    proposed = live.select("c_custkey", F.when(key % 5 == 0, "CHANGED").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(key % 4 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).alias("c_nationkey"))
    return merge.path_differences(live, proposed, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


@query("""SELECT o_orderkey AS change_id, o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' AS approved FROM orders""")
def hash_bound_approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("change_id"), "o_orderstatus", F.sha2("o_orderstatus", 256).alias("current_hash"), F.sha2("o_orderpriority", 256).alias("proposed_hash"))
    stale = F.when(F.col("o_orderstatus") == "P", "stale").otherwise(F.col("current_hash"))
    given = now.filter("change_id % 3 <> 0").select("change_id", stale.alias("current_hash"), "proposed_hash")
    return merge.valid_approvals(now.drop("o_orderstatus"), given).select("change_id", "approved")


@query("""SELECT o_custkey, count(*) AS items, count(DISTINCT nullif(o_orderpriority, '')) > 1 OR count(DISTINCT nullif(o_orderstatus, '')) > 1 AS conflict, min(nullif(o_orderpriority, '')) AS o_orderpriority, min(nullif(o_orderstatus, '')) AS o_orderstatus FROM orders GROUP BY 1""")
def coalesce_complementary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.coalesce_complementary(read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"])


# --- holds, themes, sets, paging ---------------------------------------------

_ACTION_SQL = """acts AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderkey % 11 = 0 THEN 'blocked' WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 200000 THEN 'awaiting_approval' ELSE 'planned' END AS status FROM orders)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderkey") % 11 == 0, "blocked").when(F.col("o_orderkey") % 2 == 0, "awaiting_approval")
    status = summaries.effective_status(stored, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 200000)
    return read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", status.alias("status"))


@query(f"WITH {_ACTION_SQL} SELECT status, count(*) AS n FROM acts GROUP BY 1")
def hold_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""WITH {_ACTION_SQL} SELECT o_custkey, count(*) AS actions, CASE WHEN bool_and(status = 'succeeded') THEN 'completed' WHEN bool_or(status = 'blocked') THEN 'attention_required' WHEN bool_or(status = 'awaiting_approval') THEN 'awaiting_approval'
WHEN bool_or(status <> 'planned') THEN 'in_progress' ELSE 'not_started' END AS group_status FROM acts GROUP BY 1""")
def court_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.group_status(_actions(spark, sf_dir), ["o_custkey"], "status")


@query("""WITH e AS (SELECT event_type, CASE WHEN value > 80 THEN 'high' WHEN value > 20 THEN 'mid' ELSE 'low' END AS bucket, user_id FROM events),
d AS (SELECT event_type, bucket, user_id, row_number() OVER (PARTITION BY event_type, bucket ORDER BY user_id) AS k FROM (SELECT DISTINCT * FROM e))
SELECT event_type, bucket, n, examples_total, examples FROM (SELECT event_type, bucket, count(*) AS n, count(DISTINCT user_id) AS examples_total FROM e GROUP BY ALL) JOIN (SELECT event_type, bucket, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS examples FROM d WHERE k <= 5 GROUP BY ALL) USING (event_type, bucket)""")
def attention_nested_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.when(F.col("value") > 80, "high").when(F.col("value") > 20, "mid").otherwise("low")
    events = read(spark, sf_dir, "events").select("event_type", bucket.alias("bucket"), "user_id")
    return summaries.nested_groups(events, ["event_type"], ["bucket"], "user_id")


# Themes in order of precedence.
THEMES = [("contact", ["@", "http"]), ("licence", ["icens"]), ("code", ["token", "password"])]


@query("""SELECT theme, count(*) AS n FROM (SELECT CASE WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' WHEN contains(text, 'icens') THEN 'licence' WHEN contains(text, 'token') OR contains(text, 'password') THEN 'code' ELSE 'other' END AS theme FROM documents) GROUP BY 1""")
def error_theme_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(summaries.first_theme(F.col("text"), THEMES, "other").alias("theme")).groupBy("theme").agg(F.count("*").alias("n"))


@query("""SELECT v AS event_type, coalesce(n, 0) AS n FROM (VALUES ('click'), ('view'), ('purchase'), ('never')) AS l(v) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON v = event_type""")
def zero_filled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.zero_filled(read(spark, sf_dir, "events").select("event_type"), "event_type", ["click", "view", "purchase", "never"])


@query("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def set_algebra_outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    owing = read(spark, sf_dir, "customer").filter("c_acctbal < 0").select("c_custkey")
    open_ = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return relations.set_counts(owing, open_, "c_custkey")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return relations.page(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("""SELECT o_custkey, o_orderkey, coalesce(lead(o_orderkey) OVER w, first(o_orderkey) OVER w) AS next_item FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def next_in_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relations.next_in_queue(orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderkey").select("o_custkey", "o_orderkey", "next_item")


@query("""SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '12') OR c_custkey::VARCHAR = '12'""")
def record_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.search(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), " 12", ["c_name"], ["c_custkey"])


# --- forms and plans over a sheet made of customers ---------------------------


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per customer: key, one yes/no answer, an address, a contact and opening hours, some of them unreadable."""
    key = F.col("c_custkey")
    answers = {
        ("metadata", "completion_time", 0): F.lit("2024-01-01T00:00:00"),
        ("scalar", "court_slug_raw", 0): F.concat(F.lit("https://x.org/courts/"), F.replace("c_name", F.lit("#"), F.lit("-"))),
        ("scalar", "wifi_available", 0): F.when(key % 3 == 0, "Yes").when(key % 3 == 1, "no").otherwise("perhaps"),
        ("address", "address_type", 1): F.lit("visit us"), ("address", "line_1", 1): F.lit("1 Road"), ("address", "town_or_city", 1): F.lit("Town"),
        ("address", "postcode", 1): F.when(key % 4 == 0, "bad").otherwise("bs1 1aa"),
        ("contact", "description", 1): F.lit("Enquiries"), ("contact", "phone", 1): F.when(key % 5 == 0, "12").otherwise("01632960001"),
        ("opening_hours", "type", 1): F.lit("Court open"), ("opening_hours", "monday_opening_hour", 1): F.lit("9:00"), ("opening_hours", "monday_closing_hour", 1): F.lit("17:00"),
    }
    at = {layout.column_of(s, n, k): v for (s, n, k), v in answers.items()}
    cells = F.array(*[at.get(f.column, F.lit(None).cast("string")) for f in layout.LAYOUT])
    return read(spark, sf_dir, "customer").select((key + 1).cast("int").alias("row"), cells.alias("cells"))


@query("""SELECT c_custkey + 1 AS source_row_number, lower(replace(c_name, '#', '-')) AS court_slug,
CASE WHEN c_custkey % 4 = 0 THEN 'needs_human_review' ELSE 'processed_with_warnings' END AS status,
(1 + (c_custkey % 3 = 2)::INT + (c_custkey % 4 = 0)::INT + (c_custkey % 5 = 0)::INT)::INTEGER AS issues FROM customer WHERE c_custkey > 0""")
def form_records_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = records.build_records(_sheet(spark, sf_dir))
    return got.select(F.col("source_row_number").cast("long").alias("source_row_number"), "court_slug", "status", F.size("issues").alias("issues"))


@query("""SELECT field, code, count(*) AS n FROM (SELECT 'court_slug_raw' AS field, 'COURT_SLUG_NORMALISED' AS code FROM customer WHERE c_custkey > 0
UNION ALL SELECT 'wifi_available', 'UNKNOWN_BOOLEAN' FROM customer WHERE c_custkey > 0 AND c_custkey % 3 = 2 UNION ALL SELECT 'addresses[1].postcode', 'INVALID_POSTCODE' FROM customer WHERE c_custkey > 0 AND c_custkey % 4 = 0
UNION ALL SELECT 'contacts[1].phone', 'INVALID_PHONE' FROM customer WHERE c_custkey > 0 AND c_custkey % 5 = 0) GROUP BY ALL""")
def form_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.report(records.build_records(_sheet(spark, sf_dir))).groupBy("field", "code").agg(F.count("*").alias("n"))


@query()
def archive_manifest_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, bytes and hash of every file of all tables; files have no SQL form, so they are tested against hashlib."""
    files = archive.manifest(spark, f"{sf_dir}/*.parquet")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes", "sha256")
