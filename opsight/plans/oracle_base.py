"""The test-table mapping of FIXTURES.md section C, stated in DuckDB SQL.

`with_(...)` builds a WITH clause holding the named model tables (and what they
depend on), so each oracle statement is written against model names, from the
operator's definition, independently of the Spark plan.
"""

from __future__ import annotations

ASOF = "(SELECT max(CAST(ts AS TIMESTAMP)) FROM events)"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, "
           "CAST(((user_id % 25) * (user_id % 25) * (user_id % 25)) // 625 AS INTEGER) AS app FROM events", ()),
    "applications": ("SELECT n.n_nationkey AS application_id, n.n_name AS application_name, "
                     "r.r_name AS datacenter_id, r.r_name AS infrastructure_group, 1 AS is_active "
                     "FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", ()),
    "error_logs": ("SELECT event_id AS error_id, app AS entity_id, app AS application_id, ts AS recorded_at "
                   "FROM ev WHERE event_type = 'error'", ("ev",)),
    "host_error_logs": ("SELECT user_id AS host_id, 'host-' || CAST(user_id AS VARCHAR) AS host_name, "
                        "app AS application_id, ts AS recorded_at FROM ev WHERE event_type = 'error'", ("ev",)),
    "metrics_long": ("SELECT e.event_id AS row_id, e.app AS entity_id, a.application_name AS entity_name, "
                     "'application' AS entity_type, e.event_type AS metric_name, e.value AS metric_value, "
                     "e.ts AS recorded_at FROM ev e JOIN applications a ON a.application_id = e.app "
                     "WHERE e.event_type <> 'error'", ("ev", "applications")),
    "threshold_config": ("SELECT DISTINCT entity_id, metric_name, 60.0::DOUBLE AS threshold_value FROM metrics_long",
                         ("metrics_long",)),
    "metrics_wide": ("SELECT w.*, a.application_name, w.error_count * 100.0 / w.request_count AS error_rate, "
                     "100.0 - w.error_count * 100.0 / w.request_count AS success_rate FROM ("
                     "SELECT app AS application_id, date_trunc('hour', ts) AS recorded_at, count(*) AS request_count, "
                     "count(*) FILTER (WHERE event_type = 'error') AS error_count, avg(value) AS response_time_ms "
                     "FROM ev GROUP BY 1, 2) w JOIN applications a USING (application_id)", ("ev", "applications")),
    "synthetic_metrics": ("SELECT application_id, success_rate, recorded_at FROM metrics_wide", ("metrics_wide",)),
    "host_metrics": ("SELECT user_id AS host_id, app AS application_id, date_trunc('hour', ts) AS recorded_at, "
                     "CASE WHEN count(*) FILTER (WHERE event_type = 'error') > 0 THEN 'UNHEALTHY' ELSE 'HEALTHY' END "
                     "AS health_status FROM ev GROUP BY 1, 2, 3", ("ev",)),
    "alerts": ("SELECT event_id AS alert_id, app AS application_id, 'ACTIVE' AS status, ts AS created_at "
               "FROM ev WHERE event_type = 'error' AND value > 100", ("ev",)),
    "maintenance_windows": (
        "SELECT CAST(r_regionkey + 1 AS BIGINT) AS maintenance_id, CAST(NULL AS INTEGER) AS application_id, "
        "r_name AS infrastructure_group, 'GROUP' AS scope, 'PLANNED' AS maintenance_type, "
        f"{ASOF} + to_hours((r_regionkey - 2) * 4 - 5) AS start_time, "
        f"{ASOF} + to_hours((r_regionkey - 2) * 4 - 5) + INTERVAL 10 HOUR AS end_time FROM region "
        "UNION ALL SELECT 100, NULL, NULL, 'ALL', 'PLANNED', "
        f"{ASOF} - INTERVAL 110 HOUR, {ASOF} - INTERVAL 100 HOUR", ()),
    "calls": ("SELECT l.l_orderkey * 10 + l.l_linenumber AS call_id, l.l_suppkey AS agent_id, "
              "CAST(s.s_nationkey % 5 AS INTEGER) AS vendor_id, r.r_name AS region, l.l_quantity AS duration_min, "
              "5.0 - 20.0 * l.l_discount AS mos, l.l_returnflag AS queue, CAST(l.l_shipdate AS TIMESTAMP) AS call_time, "
              "l.l_tax * 1000.0 AS wait_sec, l.l_linestatus AS line_status FROM lineitem l "
              "JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation n ON s.s_nationkey = n.n_nationkey "
              "JOIN region r ON n.n_regionkey = r.r_regionkey", ()),
    "incidents": ("SELECT o.o_orderkey AS incident_id, CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS priority, "
                  "CASE WHEN o.o_orderstatus = 'F' THEN 'Resolved' WHEN o.o_orderstatus = 'O' THEN 'Open' "
                  "ELSE 'In Progress' END AS state, CAST(o.o_orderdate AS TIMESTAMP) AS opened_at, "
                  "c.c_mktsegment AS assignment_group, o.o_totalprice AS impact_value "
                  "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", ()),
    "contacts": ("SELECT event_id AS contact_id, user_id AS customer_id, event_type AS category, event_type AS channel, "
                 "ts AS contact_time, value FROM ev", ("ev",)),
    "numstat": ("SELECT l.l_returnflag AS repo, l.l_linestatus AS branch, CAST(l.l_orderkey AS VARCHAR) AS commit, "
                "'author-' || CAST(o.o_custkey % 20 AS VARCHAR) AS author, CAST(l.l_shipdate AS TIMESTAMP) AS committed_at, "
                "'src/part-' || CAST(l.l_partkey AS VARCHAR) AS path, CAST(CAST(l.l_quantity AS BIGINT) AS VARCHAR) AS added, "
                "CAST(l.l_linenumber AS VARCHAR) AS deleted FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey", ()),
}


def with_(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause for the named model tables in dependency order, then `extra` CTEs."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0]})" for n in order]
    parts += [f"{n} AS ({q})" for n, q in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


def since(col: str, seconds: int) -> str:
    return f"{col} >= {ASOF} - to_seconds({int(seconds)})"


def bucket(col: str, unit_s: int) -> str:
    return f"CAST(floor(epoch_us({col}) / {unit_s * 1_000_000}) AS BIGINT)"


def tstext(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def rnd(expr: str, digits: int = 4) -> str:
    """Round as the Spark side does: snap to 9 places, then round to `digits`."""
    return f"(round(round(CAST({expr} AS DOUBLE), 9), {digits}) + 0.0)"


def r4(expr: str) -> str:
    return rnd(expr, 4)
