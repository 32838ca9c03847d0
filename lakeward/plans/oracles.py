"""DuckDB oracle SQL for the registered queries (run on the same parquet
tables, registered as views under their table names).

The SQL restates each operator's semantics independently with window
functions and joins; column names match the Spark results exactly.
"""

from __future__ import annotations

_M = """m AS (SELECT s_suppkey AS model_id, s_name AS name, n_name AS space_name
            FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_E = """e AS (SELECT d.l_suppkey AS model_id, d.l_partkey AS view_id, p.p_name AS view_name
            FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d
            JOIN part p ON p.p_partkey = d.l_partkey)"""
_V = """v AS (SELECT p_partkey AS view_id, min(p_brand) AS view_space
            FROM part WHERE p_size <= 40 GROUP BY p_partkey)"""
_R = """r AS (SELECT s_name AS modelname, n_name AS space FROM supplier JOIN nation ON s_nationkey = n_nationkey
            UNION ALL
            SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000
            UNION ALL
            SELECT s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
                 JOIN region ON n_regionkey = r_regionkey)"""
_RM = """rm AS (SELECT model_id, name, space_name FROM m
             WHERE EXISTS (SELECT 1 FROM r WHERE r.modelname = m.name AND r.space = m.space_name)
             QUALIFY row_number() OVER (PARTITION BY name, space_name ORDER BY model_id) = 1)"""
_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS space, ts, event_id,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) >= 20 AS success,
                     CAST(round(value * 1000) AS BIGINT) AS run_time_ms
              FROM events)"""
_T = """t AS (SELECT CAST(c_custkey AS VARCHAR) AS entity, space
            FROM customer, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS types(space))"""
_O = """o AS (SELECT * FROM log
            QUALIFY row_number() OVER (PARTITION BY entity, space ORDER BY ts DESC, event_id DESC) = 1)"""
_KEYJOIN = "t.entity IS NOT DISTINCT FROM o.entity AND t.space IS NOT DISTINCT FROM o.space"


def _secs(ms: str) -> str:
    return f"CAST(round_even({ms} / 1000.0, 0) AS BIGINT)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLES: dict[str, str] = {}

ORACLES["export_models_long"] = _with(_M, _E, _V) + """
SELECT m.model_id, m.name AS model_name, m.space_name AS model_space, e.view_id, e.view_name, v.view_space
FROM m LEFT JOIN e ON e.model_id = m.model_id LEFT JOIN v ON v.view_id = e.view_id"""

ORACLES["export_models_dedup"] = _with(_M, _E) + """
SELECT e.model_id, e.view_id, e.view_name FROM e JOIN m ON m.model_id = e.model_id
QUALIFY row_number() OVER (PARTITION BY e.view_id ORDER BY e.model_id) = 1"""

ORACLES["export_models_dedup_all"] = _with(_M, _E, _V, """d AS (SELECT e.model_id, e.view_id FROM e JOIN m ON m.model_id = e.model_id
    QUALIFY row_number() OVER (PARTITION BY e.view_id ORDER BY e.model_id) = 1)""") + """
SELECT m.model_id, m.name AS model_name, m.space_name AS model_space,
       count(d.view_id) AS n_views, count(v.view_space) AS n_resolved
FROM m LEFT JOIN d ON d.model_id = m.model_id LEFT JOIN v ON v.view_id = d.view_id
GROUP BY m.model_id, m.name, m.space_name"""

ORACLES["models_in_space"] = _with(_M, _E, _V, """ms AS (SELECT * FROM m WHERE space_name = 'NATION_1')""",
                                   """d AS (SELECT e.* FROM e JOIN ms ON ms.model_id = e.model_id
    QUALIFY row_number() OVER (PARTITION BY e.view_id ORDER BY e.model_id) = 1)""") + """
SELECT ms.model_id, ms.name AS model_name, ms.space_name AS model_space, d.view_id, d.view_name, v.view_space
FROM ms LEFT JOIN d ON d.model_id = ms.model_id LEFT JOIN v ON v.view_id = d.view_id"""

ORACLES["resolve_models"] = _with(_M, _R, _RM) + "SELECT model_id, name, space_name FROM rm"

ORACLES["unresolved_models"] = _with(_M, _R) + """
SELECT modelname, space, count(*) AS n_requests FROM r
WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.name = r.modelname AND m.space_name = r.space)
GROUP BY modelname, space"""

ORACLES["persist_worklist"] = _with(_M, _E, _V, _R, _RM) + """
SELECT DISTINCT e.model_id, e.view_id, v.view_space, e.view_name
FROM e JOIN rm ON rm.model_id = e.model_id LEFT JOIN v ON v.view_id = e.view_id"""

ORACLES["best_candidates"] = """
SELECT l_orderkey AS view_id, CAST(l_partkey AS VARCHAR) AS entity, CAST(l_suppkey AS VARCHAR) AS space,
       l_returnflag || l_linestatus AS businessName, l_linestatus = 'F' AS isPersisted
FROM lineitem WHERE coalesce(l_quantity, 0) = 10
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_partkey NULLS FIRST,
    l_suppkey NULLS FIRST, l_quantity NULLS FIRST, l_extendedprice NULLS FIRST, l_discount NULLS FIRST,
    l_tax NULLS FIRST, l_returnflag NULLS FIRST, l_linestatus NULLS FIRST, l_shipdate NULLS FIRST) = 1"""

ORACLES["attributes_containing"] = """
SELECT entity, space, businessName, attribute FROM (
    SELECT CAST(doc_id AS VARCHAR) AS entity, lang AS space, source AS businessName,
           unnest(string_split(text, ' ')) AS attribute
    FROM documents)
WHERE contains(lower(attribute), lower('the'))"""

ORACLES["report_persist"] = _with(_LOG, _T, _O) + f"""
SELECT t.entity, t.space, coalesce(o.success, false) AS isPersisted,
       CASE WHEN o.success AND {_secs('coalesce(o.run_time_ms, 0)')} > 0
            THEN {_secs('coalesce(o.run_time_ms, 0)')} END AS runtime
FROM t LEFT JOIN o ON {_KEYJOIN}"""

ORACLES["report_unpersist"] = _with(_LOG, _T, _O) + f"""
SELECT t.entity, t.space, coalesce(o.success, false) AS isRemoved
FROM t LEFT JOIN o ON {_KEYJOIN}"""

ORACLES["report_task_chains"] = _with(_LOG, _T, _O) + f"""
SELECT t.entity, t.space, coalesce(o.success, false) AS isCompleted,
       CASE WHEN o.success THEN {_secs('coalesce(o.run_time_ms, 0)')} END AS runtime
FROM t LEFT JOIN o ON {_KEYJOIN}"""

ORACLES["report_partition_create"] = _with(_LOG, _T, _O) + f"""
SELECT t.entity, t.space, 'ts' AS attribute,
       coalesce((CASE WHEN o.k < 30 THEN 'created' WHEN o.k < 60 THEN 'exists' ELSE 'failed' END)
                IN ('created', 'exists'), false) AS createdPartition
FROM t JOIN o ON {_KEYJOIN}"""

ORACLES["report_partition_delete"] = _with(_LOG, _T, _O) + f"""
SELECT t.entity, t.space, coalesce(o.success, false) AS removedPartition
FROM t JOIN o ON {_KEYJOIN}"""

ORACLES["report_lock"] = _with(_LOG, _T, _O, """w AS (SELECT o.*, CASE WHEN k < 40 THEN 'locked' WHEN k < 70 THEN 'no_partitions'
    ELSE 'error' END AS outcome FROM o)""") + f"""
SELECT t.entity, t.space, coalesce(w.outcome = 'locked', false) AS lockedPartitions
FROM t JOIN w ON t.entity IS NOT DISTINCT FROM w.entity AND t.space IS NOT DISTINCT FROM w.space
WHERE w.outcome IS DISTINCT FROM 'no_partitions'"""

ORACLES["report_unlock"] = _with(_LOG, _T, _O, """w AS (SELECT o.*, CASE WHEN k < 40 THEN 'unlocked' WHEN k < 70 THEN 'no_partitions'
    ELSE 'error' END AS outcome FROM o)""") + f"""
SELECT t.entity, t.space, coalesce(w.outcome = 'unlocked', false) AS unlockedPartitions
FROM t JOIN w ON t.entity IS NOT DISTINCT FROM w.entity AND t.space IS NOT DISTINCT FROM w.space
WHERE w.outcome IS DISTINCT FROM 'no_partitions'"""

ORACLES["upsert_results"] = _with(_LOG, _T,
    """o AS (SELECT * FROM log WHERE ts < TIMESTAMP '2024-01-08 00:00:00'
            QUALIFY row_number() OVER (PARTITION BY entity, space ORDER BY ts DESC, event_id DESC) = 1)""",
    f"""res AS (SELECT t.entity, t.space, coalesce(o.success, false) AS isCompleted,
           CASE WHEN o.success THEN {_secs('coalesce(o.run_time_ms, 0)')} END AS runtime
    FROM t LEFT JOIN o ON {_KEYJOIN} WHERE t.space <> 'error')""",
    f"""lat AS (SELECT entity, space, success AS isCompleted,
           CASE WHEN success THEN {_secs('run_time_ms')} END AS runtime
    FROM log WHERE ts >= TIMESTAMP '2024-01-08 00:00:00'
    QUALIFY row_number() OVER (PARTITION BY entity, space ORDER BY ts DESC, event_id DESC) = 1)""") + """
SELECT res.entity, res.space,
       CASE WHEN lat.entity IS NOT NULL THEN lat.isCompleted ELSE res.isCompleted END AS isCompleted,
       CASE WHEN lat.entity IS NOT NULL THEN lat.runtime ELSE res.runtime END AS runtime
FROM res LEFT JOIN lat ON res.entity IS NOT DISTINCT FROM lat.entity AND res.space IS NOT DISTINCT FROM lat.space"""

ORACLES["runtime_report"] = _with(_M, _E, _V, _R, _RM,
    """w AS (SELECT DISTINCT e.model_id, rm.name AS model_name, e.view_id, e.view_name, v.view_space
    FROM e JOIN rm ON rm.model_id = e.model_id LEFT JOIN v ON v.view_id = e.view_id)""",
    """pr AS (SELECT p_name AS name, p_brand AS space, p_partkey, p_type <> 'SMALL' AS success,
           CASE WHEN p_type = 'PROMO' THEN NULL ELSE CAST((p_size - 10) * 100 AS BIGINT) END AS run_time_ms,
           p_size <= 45 AS usucc, p_type FROM part)""",
    "a AS (SELECT DISTINCT name, space FROM pr WHERE p_type = 'ECONOMY')",
    """lp AS (SELECT name, space, success, run_time_ms FROM pr
    QUALIFY row_number() OVER (PARTITION BY name, space ORDER BY p_partkey DESC) = 1)""",
    """lu AS (SELECT name, space, usucc FROM pr
    QUALIFY row_number() OVER (PARTITION BY name, space ORDER BY p_partkey DESC) = 1)""") + f"""
SELECT w.model_id, w.model_name, w.view_id, w.view_space, w.view_name,
       CASE WHEN lp.success AND {_secs('coalesce(lp.run_time_ms, -1000)')} > 0
            THEN {_secs('coalesce(lp.run_time_ms, -1000)')} END AS runtime,
       a.name IS NOT NULL AS alreadyPersisted,
       coalesce(lp.success, false) AND a.name IS NULL AND coalesce(lu.usucc, false) AS removedPersistence
FROM w
LEFT JOIN a ON a.name = w.view_name AND a.space = w.view_space
LEFT JOIN lp ON lp.name = w.view_name AND lp.space = w.view_space
LEFT JOIN lu ON lu.name = w.view_name AND lu.space = w.view_space"""

# --- statistics ------------------------------------------------------------------

_CATALOG = """cat AS (SELECT 'T' || CAST(p_partkey AS VARCHAR) AS table_name, p_size <= 45 AS statistics_supported,
       CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN NULL WHEN p_type = 'SMALL' THEN 'SIMPLE'
            WHEN p_type = 'LARGE' THEN 'RECORD_COUNT' ELSE 'HISTOGRAM' END AS statistics_type
    FROM part)"""

ORACLES["plan_statistics"] = _with(_CATALOG) + """
SELECT table_name, statistics_supported, statistics_type,
       CASE WHEN NOT coalesce(statistics_supported, false) THEN 'skip'
            WHEN statistics_type IS NOT DISTINCT FROM 'HISTOGRAM' THEN 'skip'
            WHEN statistics_type IS NULL THEN 'create' ELSE 'update' END AS action
FROM cat"""

ORACLES["plan_refresh"] = _with(_CATALOG) + """
SELECT table_name, statistics_type FROM cat
WHERE coalesce(statistics_supported, false) AND statistics_type IS NOT NULL"""

ORACLES["profile_record_count"] = """
SELECT 'lineitem' AS table_name, count(*) AS record_count FROM lineitem
UNION ALL SELECT 'orders', count(*) FROM orders
UNION ALL SELECT 'customer', count(*) FROM customer"""

# Columns of the profiled tables, with the floating ones marked.
_PROFILED = {
    "lineitem": [("l_orderkey", 0), ("l_partkey", 0), ("l_suppkey", 0), ("l_linenumber", 0), ("l_quantity", 1),
                 ("l_extendedprice", 1), ("l_discount", 1), ("l_tax", 1), ("l_returnflag", 0),
                 ("l_linestatus", 0), ("l_shipdate", 0)],
    "orders": [("o_orderkey", 0), ("o_custkey", 0), ("o_orderstatus", 0), ("o_totalprice", 1),
               ("o_orderdate", 0), ("o_orderpriority", 0)],
    "customer": [("c_custkey", 0), ("c_name", 0), ("c_nationkey", 0), ("c_acctbal", 1), ("c_mktsegment", 0)],
}


def _simple_sql(table: str, with_table: bool) -> str:
    parts = []
    for c, floating in _PROFILED[table]:
        z = " + 0.0" if floating else ""
        tn = f"'{table}' AS table_name, " if with_table else ""
        parts.append(f"SELECT {tn}'{c}' AS column_name, count({c}) AS row_count, count(*) - count({c}) AS null_count, "
                     f"count(DISTINCT {c}) AS distinct_count, CAST(min({c}){z} AS VARCHAR) AS min_value, "
                     f"CAST(max({c}){z} AS VARCHAR) AS max_value FROM {table}")
    return "\nUNION ALL ".join(parts)


ORACLES["profile_simple"] = _simple_sql("lineitem", False)
ORACLES["refresh_profiles"] = "\nUNION ALL ".join(_simple_sql(t, True) for t in ("lineitem", "orders", "customer"))


def _histogram_sql(cols, bins: int) -> str:
    parts = []
    for c in cols:
        parts.append(f"""(WITH mm AS (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem),
      g AS (SELECT CAST(b AS INTEGER) AS bin FROM range({bins}) t(b)),
      c AS (SELECT CASE WHEN hi = lo THEN 0
                        ELSE least({bins - 1}, CAST(floor(({c} - lo) / (hi - lo) * {bins}) AS INTEGER)) END AS bin,
                   count(*) AS n
            FROM lineitem, mm WHERE {c} IS NOT NULL GROUP BY 1)
 SELECT '{c}' AS column_name, g.bin, lo + (hi - lo) * g.bin / {float(bins)} AS lower,
        lo + (hi - lo) * (g.bin + 1) / {float(bins)} AS upper, coalesce(c.n, 0) AS row_count
 FROM g CROSS JOIN mm LEFT JOIN c ON c.bin = g.bin)""")
    return "\nUNION ALL ".join(parts)


ORACLES["profile_histogram"] = _histogram_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 10)

# --- yearly partitions and persistence ---------------------------------------------------

_YEARS = """yr AS (SELECT unnest(range(lo, hi + 1)) AS y
    FROM (SELECT min(year(l_shipdate)) AS lo, max(year(l_shipdate)) AS hi FROM lineitem))"""

ORACLES["year_ranges"] = _with(_YEARS) + """
SELECT CAST(y AS VARCHAR) AS "partition", CAST(y AS VARCHAR) AS lower, CAST(y + 1 AS VARCHAR) AS upper FROM yr"""

ORACLES["lock_partitions"] = _with(_YEARS) + """
SELECT CAST(y AS VARCHAR) AS "partition", CAST(y AS VARCHAR) AS lower, CAST(y + 1 AS VARCHAR) AS upper,
       y <= 1997 AS locked FROM yr"""

ORACLES["unlock_partitions"] = _with(_YEARS) + """
SELECT CAST(y AS VARCHAR) AS "partition", CAST(y AS VARCHAR) AS lower, CAST(y + 1 AS VARCHAR) AS upper,
       false AS locked FROM yr"""

_BYRANGE = """li AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS ship_year, l_quantity, l_linestatus FROM lineitem),
rg AS (SELECT CAST(b AS VARCHAR) AS lower, CAST(b + 1 AS VARCHAR) AS upper FROM range(1993, 2002) t(b)),
tagged AS (SELECT coalesce(rg.lower, 'rest') AS p, li.* FROM li
           LEFT JOIN rg ON li.ship_year >= rg.lower AND li.ship_year < rg.upper)"""

ORACLES["partition_summary"] = _with(_BYRANGE, "cnt AS (SELECT p, count(*) AS n FROM tagged GROUP BY p)",
                                     "allp AS (SELECT lower AS p, lower, upper FROM rg UNION ALL "
                                     "SELECT 'rest', NULL, NULL)") + """
SELECT allp.p AS "partition", allp.lower, allp.upper, coalesce(cnt.n, 0) AS row_count
FROM allp LEFT JOIN cnt ON cnt.p = allp.p"""

ORACLES["partition_by_year"] = _with(_BYRANGE) + """
SELECT p AS "partition", count(*) AS n_rows, sum(l_quantity) AS sum_qty FROM tagged GROUP BY p"""

ORACLES["unpartition"] = """
SELECT CAST(year(l_shipdate) AS VARCHAR) AS "partition", count(*) AS n_rows, sum(l_quantity) AS sum_qty
FROM lineitem GROUP BY 1"""

ORACLES["repersist"] = _with(_BYRANGE) + """
SELECT p AS "partition", count(*) AS n_rows, sum(l_quantity) AS sum_qty FROM tagged
WHERE (p <> 'rest' AND CAST(p AS INTEGER) <= 1997) OR l_linestatus = 'O'
GROUP BY p"""

ORACLES["persist_view"] = """
SELECT o_orderstatus, o_orderpriority, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_price
FROM orders GROUP BY 1, 2"""

# --- sources, sinks and streaming ---------------------------------------------------------

ORACLES["scan_tasks"] = _with(_T) + "SELECT entity, space FROM t"
ORACLES["results_roundtrip"] = ORACLES["report_persist"]
ORACLES["export_roundtrip"] = _with(_M, _E, _V) + """
SELECT m.model_id, m.name AS model_name, e.view_id, e.view_name, v.view_space
FROM m JOIN e ON e.model_id = m.model_id LEFT JOIN v ON v.view_id = e.view_id"""
ORACLES["stream_upsert"] = ORACLES["upsert_results"]

ORACLES["export_by_space_roundtrip"] = _with(_M, _E, _V, """d AS (SELECT e.* FROM e JOIN m ON m.model_id = e.model_id
    QUALIFY row_number() OVER (PARTITION BY e.view_id ORDER BY e.model_id) = 1)""") + """
SELECT m.model_id, m.space_name AS model_space, d.view_id, d.view_name, v.view_space
FROM m JOIN d ON d.model_id = m.model_id LEFT JOIN v ON v.view_id = d.view_id"""

ORACLES["persisted_flag"] = """
SELECT DISTINCT 'orders_' || o_orderstatus AS entity, 'SALES' AS space,
       o_orderstatus IN ('O', 'P') AS isPersisted
FROM orders"""

ORACLES["create_statistics"] = """
SELECT 'lineitem' AS table_name, 'create' AS action, 'created' AS status, (SELECT count(*) FROM lineitem) AS record_count
UNION ALL SELECT 'orders', 'update', 'updated', (SELECT count(*) FROM orders)
UNION ALL SELECT 'customer', 'skip', 'skipped', CAST(NULL AS BIGINT)"""

ORACLES["catalog_edges_roundtrip"] = _with(_E) + "SELECT model_id, view_id, view_name FROM e"


# the nested forms are compared as rows
ORACLES["export_models_nested"] = ORACLES["export_models_long"]
ORACLES["runtime_report_nested"] = ORACLES["runtime_report"]

ORACLES["stream_upsert_folded"] = ORACLES["stream_upsert"]

# the long forms of the export action
ORACLES["export_rows_roundtrip"] = ORACLES["export_models_long"]
ORACLES["export_space_rows_roundtrip"] = ORACLES["models_in_space"]

# --- actions -------------------------------------------------------------------------------

_OV = """ov AS (SELECT 'orders_' || o_orderstatus AS entity, CAST(year(o_orderdate) AS VARCHAR) AS order_year,
              o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_orderstatus IN ('O', 'F', 'P')),
n AS (SELECT entity, order_year, count(*) AS n_rows FROM ov GROUP BY 1, 2),
k AS (SELECT entity, 'SALES' AS space FROM (VALUES ('orders_O'), ('orders_F'), ('orders_P'), ('orders_missing')) AS x(entity))"""

ORACLES["action_persist_views"] = _with(_OV) + """
SELECT k.entity, k.space, k.entity <> 'orders_missing' AS isPersisted, n.order_year, n.n_rows FROM k LEFT JOIN n ON n.entity = k.entity"""
ORACLES["action_unpersist_views"] = _with(_OV) + """
SELECT k.entity, k.space, k.entity IN ('orders_O', 'orders_F') AS isRemoved,
       (SELECT nullif(count(*), 0) FROM ov WHERE ov.entity = k.entity) AS n_rows, false AS isPersisted FROM k"""
ORACLES["action_create_partitioning"] = _with(_OV) + """
SELECT k.entity, k.space, 'order_year' AS attribute, k.entity <> 'orders_missing' AS createdPartition, n.order_year, n.n_rows
FROM k LEFT JOIN n ON n.entity = k.entity"""
ORACLES["action_remove_partitioning"] = _with(_OV) + """
SELECT k.entity, k.space, n.entity IS NOT NULL AS removedPartition, n.order_year, n.n_rows
FROM k LEFT JOIN n ON n.entity = k.entity AND n.entity IN ('orders_O', 'orders_F')"""
ORACLES["action_lock_partitions"] = _with(_OV) + """
SELECT entity, 'SALES' AS space, true AS lockedPartitions, order_year, count(*) AS n_rows FROM ov
WHERE entity IN ('orders_O', 'orders_F') AND (urgent OR CAST(order_year AS INTEGER) BETWEEN 1993 AND 1997) GROUP BY 1, 2, 3, 4"""
ORACLES["action_unlock_partitions"] = _with(_OV) + """
SELECT entity, 'SALES' AS space, true AS unlockedPartitions, order_year, count(*) AS n_rows FROM ov
WHERE entity IN ('orders_O', 'orders_F') AND urgent GROUP BY 1, 2, 3, 4"""

ORACLES["action_check_runtimes"] = """
WITH e AS (SELECT DISTINCT n_regionkey AS model_id, o_orderstatus AS view_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
n AS (SELECT o_orderstatus AS view_id, count(*) AS n_rows FROM orders GROUP BY 1)
SELECT CAST(e.model_id AS BIGINT) AS model_id, r_name AS model_name, e.view_id, 'orders_' || e.view_id AS view_name,
       CASE WHEN e.view_id <> 'P' THEN 'SALES' END AS view_space, e.view_id = 'F' AS alreadyPersisted, e.view_id = 'O' AS removedPersistence,
       CASE WHEN e.view_id <> 'P' THEN 1 END::BIGINT AS n_runs, CASE WHEN e.view_id <> 'P' THEN n.n_rows END AS n_rows, e.view_id = 'F' AS isPersisted
FROM e JOIN region ON r_regionkey = e.model_id JOIN n ON n.view_id = e.view_id"""

# --- catalogue scans -------------------------------------------------------------------------

ORACLES["catalog_models"] = _with(_M) + "SELECT CAST(model_id AS VARCHAR) AS model_id, name, space_name, CAST(model_id AS BIGINT) AS position FROM m"
ORACLES["catalog_views"] = """
SELECT CAST(p_partkey AS VARCHAR) AS view_id, p_name AS name, p_brand AS space_name, p_type AS business_name,
       CAST(p_partkey AS BIGINT) AS position FROM part"""
ORACLES["catalog_view_attributes"] = """
SELECT CAST(doc_id AS VARCHAR) AS view_id, CAST(doc_id AS VARCHAR) AS name, lang AS space_name, source AS business_name,
       text AS attributes, CAST(doc_id AS BIGINT) AS position FROM documents"""
ORACLES["catalog_analyser_stats"] = """
SELECT CAST(l_orderkey AS VARCHAR) AS view_id, CAST(l_linenumber AS BIGINT) AS position, CAST(l_partkey AS VARCHAR) AS entity,
       CAST(l_suppkey AS VARCHAR) AS space, l_returnflag || l_linestatus AS businessName, l_linestatus = 'F' AS isPersisted,
       CAST(trunc(l_quantity) AS INTEGER) AS persistencyCandidateScore FROM lineitem"""
ORACLES["catalog_tables"] = """
SELECT 'T' || CAST(p_partkey AS VARCHAR) AS table_name, p_size <= 45 AS statistics_supported,
       CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN NULL WHEN p_type = 'SMALL' THEN 'SIMPLE'
            WHEN p_type = 'LARGE' THEN 'RECORD_COUNT' ELSE 'HISTOGRAM' END AS statistics_type FROM part"""
ORACLES["catalog_positions"] = """
SELECT CAST(p_partkey AS VARCHAR) AS view_id, CASE WHEN CAST(p_partkey AS VARCHAR) LIKE '%00' THEN p_brand ELSE 'FIRST' END AS view_space FROM part"""
