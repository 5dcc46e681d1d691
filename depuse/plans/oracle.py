"""Independent DuckDB SQL for every named query (``oracle_sql()``).

Written from the semantics, not from the Spark plans: sessions use the
classic per-client ``lag`` window, reachability uses ``WITH RECURSIVE``.
Tables ``events``, ``part`` and ``nation`` are views over the same parquet.
"""

from __future__ import annotations

from depuse.plans import catalog as C
from depuse.functions.time import parse_bound

M = C.MAX_IDLE_MS

LOGS = """logs AS (
  SELECT CAST(user_id AS INTEGER) AS clientId,
         CAST(epoch_us(ts) // 1000 AS BIGINT) AS timestamp,
         event_type AS agent,
         'artifacts/' || json_extract_string(props, '$.k') || '.pom' AS path,
         event_id
  FROM events)"""

_PART_DEPS = """CASE WHEN p_partkey // 2 = p_partkey // 3 THEN ['org.part:p' || (p_partkey // 2)]
              ELSE ['org.part:p' || (p_partkey // 2), 'org.part:p' || (p_partkey // 3)] END"""

RECORDS = f"""records AS (
  SELECT 'artifacts/' || (p_partkey + 10) || '.pom' AS path,
         'org.part:p' || p_partkey AS gav,
         CASE WHEN p_partkey % 10 = 0 THEN ['NO_DEPS'] ELSE {_PART_DEPS} END AS dependencies,
         p_partkey, p_size, p_name
  FROM part)"""

LOG_LINES = """log_lines AS (
  SELECT concat_ws(' ', clientId, timestamp, agent, path) AS base, event_id % 97 = 0 AS bad, *
  FROM logs)"""

RECORD_LINES = """record_lines AS (
  SELECT concat_ws(' ', p_size, path, gav, array_to_string(dependencies, ',')) AS base, p_partkey % 97 = 0 AS bad, *
  FROM records)"""

GAV_LOGS = """gav_logs AS (
  SELECT l.clientId, l.timestamp, l.agent, r.gav, r.dependencies, l.event_id
  FROM logs l JOIN records r ON l.path = r.path)"""

FLAGS = f"""flags AS (
  SELECT *, timestamp - prev AS diff,
         CASE WHEN timestamp - prev > {M} THEN 1 ELSE 0 END AS isNewSession
  FROM (SELECT clientId, timestamp, event_id, gav,
               lag(timestamp) OVER (PARTITION BY clientId ORDER BY timestamp, event_id) AS prev
        FROM gav_logs)),
sflags AS (
  SELECT *, CAST(sum(isNewSession) OVER (PARTITION BY clientId ORDER BY timestamp, event_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS sessionId
  FROM flags)"""

SESSIONS = """sessions AS (
  SELECT clientId, sessionId, min(timestamp) AS startTime, max(timestamp) AS endTime,
         list_sort(list_distinct(list(gav))) AS gavs
  FROM sflags GROUP BY clientId, sessionId)"""

RANGE = f"""rsessions AS (
  SELECT * FROM sessions WHERE startTime >= {parse_bound(C.REPORT_START)} AND startTime < {parse_bound(C.REPORT_END)})"""

SG = """sg AS (SELECT clientId, sessionId, unnest(gavs) AS gav FROM rsessions)"""

SEEDS = """seeds AS (SELECT DISTINCT gav FROM sg)"""

_SENT = "('UNKNOWN_DEPS', 'NO_DEPS')"

RETAINED = f"""retained AS (
  SELECT path, gav, list_filter(list_distinct(dependencies), lambda d: d NOT IN {_SENT}) AS deps
  FROM records
  WHERE NOT (len(list_distinct(dependencies)) = 1 AND list_distinct(dependencies)[1] IN {_SENT}))"""

EDGES = """edges AS (SELECT DISTINCT src, dst FROM (SELECT gav AS src, unnest(deps) AS dst FROM retained))"""

NODES = """nodes AS (SELECT DISTINCT id FROM (
  SELECT gav AS id FROM retained UNION ALL SELECT unnest(deps) AS id FROM retained))"""

CLOSURE = """closure(src, dst) AS (
  SELECT src, dst FROM edges
  UNION
  SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)"""


def _reach(name: str, seeds_sql: str | None, bound: str | None) -> str:
    where = f"WHERE src IN ({seeds_sql})" if seeds_sql else ""
    limit = f"WHERE r.hops < {bound}" if bound else ""
    return f"""{name}(src, dst, hops) AS (
  SELECT src, dst, 1 FROM edges {where}
  UNION
  SELECT r.src, e.dst, r.hops + 1 FROM {name} r JOIN edges e ON r.dst = e.src {limit})"""


def _sql(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def _sorted(col: str) -> str:
    return f"array_to_string(list_sort({col}), ',')"


def _deps_from(reach: str) -> str:
    return f"""deps AS (
  SELECT DISTINCT a.clientId, a.sessionId, r.dst AS dependency
  FROM sg a JOIN {reach} r ON a.gav = r.src
  JOIN sg b ON b.clientId = a.clientId AND b.sessionId = a.sessionId AND b.gav = r.dst)"""


PIPE = (LOGS, RECORDS, GAV_LOGS, FLAGS, SESSIONS)
DEPS40 = PIPE + (RANGE, SG, SEEDS, RETAINED, EDGES, _reach("reach", "SELECT gav FROM seeds", str(C.DEEP_HOPS)), _deps_from("reach"))
DEPS = PIPE + (RANGE, SG, SEEDS, RETAINED, EDGES, CLOSURE, _deps_from("closure"))

ENHANCED = DEPS + ("""enhanced AS (
  SELECT s.*, coalesce(d.dependencies, []) AS dependencies
  FROM rsessions s LEFT JOIN (
    SELECT clientId, sessionId, list_sort(list(dependency)) AS dependencies FROM deps GROUP BY ALL) d
  USING (clientId, sessionId))""",
    """split AS (
  SELECT *, list_filter(gavs, lambda g: NOT list_contains(dependencies, g)) AS direct, dependencies AS indirect
  FROM enhanced)""",
    """direct_rep AS (
  SELECT gav, count(DISTINCT clientId) AS clients FROM (SELECT clientId, unnest(direct) AS gav FROM split) GROUP BY gav)""",
    """indirect_rep AS (
  SELECT gav, count(DISTINCT clientId) AS clients FROM (SELECT clientId, unnest(indirect) AS gav FROM split) GROUP BY gav)""",
)

_DAY = "strftime(DATE '1970-01-01' + CAST(floor(startTime / 86400000) AS INTEGER), '%Y-%m-%d')"
_USAGE_OF_DAYS = f"""
        SELECT kind, gav, count(DISTINCT clientId) AS clients FROM (
          SELECT 'direct' AS kind, {_DAY} AS day, clientId, unnest(direct) AS gav FROM split
          UNION ALL SELECT 'indirect' AS kind, {_DAY} AS day, clientId, unnest(indirect) AS gav FROM split)
        WHERE day BETWEEN '{C.WINDOW_DAYS[0]}' AND '{C.WINDOW_DAYS[1]}' GROUP BY kind, gav"""

_lo, _hi, _step, _n = C.SAMPLE_GRID
SAMPLE = """sample AS (
  SELECT * FROM (
    SELECT *, CAST(len(gavs) AS INTEGER) AS gavsSize,
           row_number() OVER (PARTITION BY len(gavs) ORDER BY clientId, sessionId) AS rk
    FROM sessions)
  WHERE gavsSize BETWEEN {lo} AND {hi} AND (gavsSize - {lo}) % {step} = 0 AND rk <= {n})""".format(
    lo=_lo, hi=_hi, step=_step, n=_n
)

SESSION_COLS = f"clientId, sessionId, startTime, endTime, {_sorted('gavs')} AS gavs, CAST(len(gavs) AS INTEGER) AS n_gavs"

CYCLIC_EDGES = """edges AS (
  SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS src, CAST(unnest(CASE WHEN p_partkey % 25 = 0 AND p_partkey >= 25
           THEN [p_partkey + 3, p_partkey // 25 // 2 * 25 + 1]
           ELSE [p_partkey - p_partkey % 25 + (p_partkey % 25 * 7 + 3) % 25] END) AS VARCHAR) AS dst
  FROM part)"""

ORACLE: dict[str, str] = {
    "parse_repository_logs": _sql(LOGS, body="SELECT clientId, timestamp, agent, path FROM logs WHERE event_id % 97 <> 0"),
    "parse_dependency_records": _sql(RECORDS, body=f"""SELECT path, gav, {_sorted('list_distinct(dependencies)')} AS dependencies,
        CAST(len(list_distinct(dependencies)) AS INTEGER) AS n_dependencies FROM records WHERE p_partkey % 97 <> 0"""),
    "rejected_lines": _sql(LOGS, RECORDS, LOG_LINES, RECORD_LINES, body="""
        SELECT 'log' AS kind, base || ' extra' AS line FROM log_lines WHERE bad
        UNION ALL
        SELECT 'record' AS kind, base || ' extra' AS line FROM record_lines WHERE bad"""),
    "duplicate_paths": _sql(RECORDS, body="""
        SELECT 'names/' || replace(p_name, ' ', '-') || '.pom' AS path, count(*) AS n
        FROM records GROUP BY 1 HAVING count(*) > 1"""),
    "unresolved_logs": _sql(LOGS, RECORDS, body="""
        SELECT clientId, timestamp, agent, path FROM logs WHERE path NOT IN (SELECT path FROM records)"""),
    "resolve_gavs": _sql(LOGS, RECORDS, GAV_LOGS, body=f"""
        SELECT clientId, timestamp, agent, gav, {_sorted('list_distinct(dependencies)')} AS dependencies FROM gav_logs"""),
    "report_bounds": _sql("x AS (SELECT 1)", body="""
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%MZ') AS bound_text,
               CAST(epoch_ms(date_trunc('minute', ts)) AS BIGINT) AS bound_ms,
               CAST(epoch_ms(date_trunc('minute', ts)) AS BIGINT) AS bound_ms_colon
        FROM events"""),
    "report_bounds_offsets": _sql("zones(k, zone, minutes) AS (VALUES " + ", ".join(
        f"({k}, '{z}', {m})" for k, (z, m) in enumerate(C.OFFSETS.items())) + ")", """bounds AS (
          SELECT event_id, ts, zone, CAST(epoch_ms(date_trunc('minute', ts)) - 60000 * minutes AS BIGINT) AS bound_ms
          FROM events JOIN zones ON event_id % (SELECT count(*) FROM zones) = k)""", body="""
        SELECT event_id, strftime(ts, '%Y-%m-%dT%H-%M') || zone AS bound_text, bound_ms, bound_ms AS bound_ms_colon
        FROM bounds"""),
    "session_flags": _sql(LOGS, RECORDS, GAV_LOGS, FLAGS, body="""
        SELECT clientId, timestamp, event_id, gav, coalesce(prev, -1) AS prev, coalesce(diff, -1) AS diff,
               isNewSession, sessionId FROM sflags"""),
    "sessions": _sql(*PIPE, body=f"SELECT {SESSION_COLS} FROM sessions"),
    "sessions_in_range": _sql(*PIPE, body=f"""SELECT {SESSION_COLS} FROM sessions
        WHERE startTime >= {parse_bound(C.WINDOW_START)} AND startTime < {parse_bound(C.WINDOW_END)}"""),
    "sentinel_filter": _sql(RECORDS, f"""srecords AS (
          SELECT path, gav, CASE WHEN p_partkey % 10 = 3 THEN ['NO_DEPS', 'UNKNOWN_DEPS']
                                 WHEN p_partkey % 10 = 5 THEN list_concat(dependencies, ['UNKNOWN_DEPS'])
                                 ELSE dependencies END AS dependencies
          FROM records)""", RETAINED.replace("FROM records", "FROM srecords"), body=f"""
        SELECT path, gav, {_sorted('deps')} AS dependencies, CAST(len(deps) AS INTEGER) AS n_dependencies FROM retained"""),
    "graph_nodes": _sql(RECORDS, RETAINED, NODES, body="SELECT id FROM nodes"),
    "graph_edges": _sql(RECORDS, RETAINED, EDGES, body="SELECT src, dst FROM edges"),
    "graph_edges_valid": _sql(RECORDS, RETAINED, NODES, f"""cand AS (
          SELECT DISTINCT src, dst FROM (
            SELECT 'org.part:p' || p_partkey AS src, unnest({_PART_DEPS}) AS dst FROM part))""",
        body="""SELECT src, dst FROM cand WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)"""),
    "adjacency_edges": _sql(f"""adj AS (
          SELECT DISTINCT src, dst FROM (
            SELECT 'org.part:p' || p_partkey AS src, unnest({_PART_DEPS}) AS dst FROM part WHERE p_partkey % 5 <> 4))""",
        body="SELECT src, dst FROM adj"),
    "adjacency_stats": _sql(f"""adj AS (
          SELECT DISTINCT src, dst FROM (
            SELECT 'org.part:p' || p_partkey AS src, unnest({_PART_DEPS}) AS dst FROM part WHERE p_partkey % 5 <> 4))""",
        """adj_nodes AS (SELECT DISTINCT id FROM (
          SELECT 'org.part:p' || p_partkey AS id FROM part UNION ALL SELECT dst AS id FROM adj))""",
        body="""SELECT (SELECT count(*) FROM adj_nodes) AS nodes, (SELECT count(*) FROM adj) AS edges"""),
    "graph_stats": _sql(RECORDS, RETAINED, NODES, EDGES, body="""
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"""),
    "khop_reach": _sql(LOGS, RECORDS, GAV_LOGS, RETAINED, EDGES,
        _reach("reach", "SELECT gav FROM gav_logs", str(C.KHOP_DEPTH)),
        body="SELECT src, dst, min(hops) AS hops FROM reach GROUP BY src, dst"),
    "cyclic_reach": _sql(CYCLIC_EDGES,
        _reach("reach", None, "100"),  # no two parts are further apart
        body="SELECT src, dst, min(hops) AS hops FROM reach GROUP BY src, dst"),
    "transitive_closure": _sql(RECORDS, RETAINED, EDGES, CLOSURE, body="SELECT src, dst FROM closure"),
    "session_dependencies_closure": _sql(*PIPE, RANGE, SG, RETAINED, EDGES, CLOSURE, _deps_from("closure"),
        body="SELECT clientId, sessionId, dependency FROM deps"),
    "session_dependencies_hops": _sql(*PIPE, RANGE, SG, SEEDS, RETAINED, EDGES,
        _reach("reach", "SELECT gav FROM seeds", str(C.SESSION_HOPS)), _deps_from("reach"),
        body="SELECT clientId, sessionId, dependency FROM deps"),
    "session_dependencies_unbounded": _sql(*PIPE, RANGE, SG, SEEDS, RETAINED, EDGES, CLOSURE, _deps_from("closure"),
        body="SELECT clientId, sessionId, dependency FROM deps"),
    "session_dependencies_depth40": _sql(*DEPS40, body="SELECT clientId, sessionId, dependency FROM deps"),
    "enhanced_sessions": _sql(*ENHANCED, body=f"""
        SELECT {SESSION_COLS}, {_sorted('dependencies')} AS dependencies, CAST(len(dependencies) AS INTEGER) AS n_dependencies,
               CAST(-1 AS BIGINT) AS execMillis, CAST(NULL AS VARCHAR) AS errorDeps
        FROM enhanced"""),
    "top_level_gavs": _sql(*ENHANCED, body=f"""
        SELECT clientId, sessionId, {_sorted('direct')} AS direct, CAST(len(direct) AS INTEGER) AS n_direct FROM split"""),
    "sessions_with_dependencies": _sql(*ENHANCED, body="""
        SELECT clientId, sessionId, CAST(len(gavs) AS INTEGER) AS n_gavs, CAST(len(direct) AS INTEGER) AS n_direct,
               CAST(len(indirect) AS INTEGER) AS n_indirect
        FROM split WHERE len(gavs) <> len(direct)"""),
    "direct_usage": _sql(*ENHANCED, body="SELECT gav, clients FROM direct_rep"),
    "indirect_usage": _sql(*ENHANCED, body="SELECT gav, clients FROM indirect_rep"),
    "direct_usage_by_day": _sql(*ENHANCED, body=f"""
        SELECT day, gav, count(DISTINCT clientId) AS clients
        FROM (SELECT {_DAY} AS day, clientId, unnest(direct) AS gav FROM split) GROUP BY day, gav"""),
    "indirect_usage_by_day": _sql(*ENHANCED, body=f"""
        SELECT day, gav, count(DISTINCT clientId) AS clients
        FROM (SELECT {_DAY} AS day, clientId, unnest(indirect) AS gav FROM split) GROUP BY day, gav"""),
    "usage_of_days": _sql(*ENHANCED, body=_USAGE_OF_DAYS),
    "top10_direct": _sql(*ENHANCED, body="SELECT gav, clients FROM direct_rep ORDER BY clients DESC, gav LIMIT 10"),
    "top10_indirect": _sql(*ENHANCED, body="SELECT gav, clients FROM indirect_rep ORDER BY clients DESC, gav LIMIT 10"),
    "session_size_histogram": _sql(*PIPE, body="""
        SELECT CAST(len(gavs) AS INTEGER) AS gavsSize, count(*) AS "count" FROM sessions GROUP BY 1"""),
    "sample_by_size": _sql(*PIPE, SAMPLE, body=f"SELECT {SESSION_COLS}, gavsSize FROM sample"),
    "depth_sweep": _sql(*PIPE, SAMPLE, "sg AS (SELECT clientId, sessionId, unnest(gavs) AS gav FROM sample)",
        SEEDS, RETAINED, EDGES, _reach("reach", "SELECT gav FROM seeds", None),
        """nearest AS (
          SELECT a.clientId, a.sessionId, r.dst, min(r.hops) AS hops
          FROM sg a JOIN reach r ON a.gav = r.src
          JOIN sg b ON b.clientId = a.clientId AND b.sessionId = a.sessionId AND b.gav = r.dst
          GROUP BY ALL)""",
        "grid AS (SELECT clientId, sessionId, unnest([{}]) AS depth FROM sample)".format(
            ", ".join(str(d) for d in C.SWEEP_DEPTHS)),
        body="""SELECT g.depth, g.clientId, g.sessionId,
               CAST(count(n.dst) FILTER (WHERE g.depth <= 1 OR n.hops <= g.depth) AS BIGINT) AS n_dependencies,
               coalesce(array_to_string(list_sort(list(n.dst) FILTER (WHERE n.dst IS NOT NULL AND (g.depth <= 1 OR n.hops <= g.depth))), ','), '') AS dependencies
        FROM grid g LEFT JOIN nearest n USING (clientId, sessionId)
        GROUP BY g.depth, g.clientId, g.sessionId"""),
    "traversal_work": _sql(*PIPE, RANGE, SG, SEEDS, RETAINED, EDGES, """paths(seed, node, len) AS (
          SELECT src, dst, 1 FROM edges WHERE src IN (SELECT gav FROM seeds)
          UNION ALL
          SELECT p.seed, e.dst, p.len + 1 FROM paths p JOIN edges e ON p.node = e.src)""",
        "per_gav AS (SELECT seed AS gav, count(*) AS n_paths, sum(len) AS work FROM paths GROUP BY seed)",
        body="""SELECT s.clientId, s.sessionId,
               CAST(coalesce(sum(p.n_paths), 0) AS BIGINT) AS n_paths,
               CAST(coalesce(sum(p.work), 0) AS BIGINT) AS work
        FROM sg s LEFT JOIN per_gav p USING (gav) GROUP BY s.clientId, s.sessionId"""),
    "session_traversal_work": _sql(*PIPE, RANGE, SG, SEEDS, RETAINED, EDGES, """paths(seed, node, len) AS (
          SELECT src, dst, 1 FROM edges WHERE src IN (SELECT gav FROM seeds)
          UNION ALL
          SELECT p.seed, e.dst, p.len + 1 FROM paths p JOIN edges e ON p.node = e.src)""",
        """per_pair AS (SELECT seed, node, count(*) AS n_paths, sum(len) AS work FROM paths GROUP BY seed, node),
        inside AS (
          SELECT a.clientId, a.sessionId, sum(p.n_paths) AS n_paths, sum(p.work) AS work
          FROM sg a JOIN per_pair p ON p.seed = a.gav
          JOIN sg b ON b.clientId = a.clientId AND b.sessionId = a.sessionId AND b.gav = p.node
          GROUP BY a.clientId, a.sessionId)""",
        body="""SELECT s.clientId, s.sessionId, CAST(coalesce(n_paths, 0) AS BIGINT) AS n_paths, CAST(coalesce(work, 0) AS BIGINT) AS work
        FROM (SELECT DISTINCT clientId, sessionId FROM sg) s LEFT JOIN inside USING (clientId, sessionId)"""),
    "file_rejected_line_numbers": _sql(RECORDS, RECORD_LINES, body="""
        SELECT folder, line_number, line FROM (
          SELECT CAST(p_partkey // 1000 AS INTEGER) AS folder, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) AS line_number,
                 base || ' extra' AS line, bad
          FROM record_lines)
        WHERE bad"""),
    "cyclic_traversal_work": _sql(CYCLIC_EDGES,
        f"""trails(seed, node, len, used) AS (
          SELECT src, dst, 1, [src || '>' || dst] FROM edges
          UNION ALL
          SELECT t.seed, e.dst, t.len + 1, list_append(t.used, e.src || '>' || e.dst)
          FROM trails t JOIN edges e ON t.node = e.src
          WHERE NOT list_contains(t.used, e.src || '>' || e.dst) AND t.len < {C.TRAIL_DEPTH})""",
        body="""SELECT seed AS id, CAST(count(*) AS BIGINT) AS n_paths, CAST(sum(len) AS BIGINT) AS work
        FROM trails GROUP BY seed"""),
    "cyclic_traversal_unbounded": _sql(CYCLIC_EDGES,
        """trails(seed, node, len, used) AS (
          SELECT src, dst, 1, [src || '>' || dst] FROM edges
          UNION ALL
          SELECT t.seed, e.dst, t.len + 1, list_append(t.used, e.src || '>' || e.dst)
          FROM trails t JOIN edges e ON t.node = e.src
          WHERE NOT list_contains(t.used, e.src || '>' || e.dst))""",
        body="""SELECT seed AS id, CAST(count(*) AS BIGINT) AS n_paths, CAST(sum(len) AS BIGINT) AS work
        FROM trails GROUP BY seed"""),
}

ORDER_LOGS = """logs AS (
  SELECT CAST(o_custkey AS INTEGER) AS clientId, CAST(epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) AS timestamp,
         'order' AS agent, 'artifacts/' || (l_partkey + 10) || '.pom' AS path, row_number() OVER () AS event_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_ALL = "rsessions AS (SELECT * FROM sessions)"
_ORDERS = tuple({LOGS: ORDER_LOGS, RANGE: _ALL}.get(c, c) for c in ENHANCED)

ORACLE |= {
    "order_sessions": _sql(ORDER_LOGS, *PIPE[1:], body=f"SELECT {SESSION_COLS} FROM sessions"),
    "order_session_dependencies": _sql(*_ORDERS, body="SELECT clientId, sessionId, dependency FROM deps"),
    "order_direct_usage": _sql(*_ORDERS, body="SELECT gav, clients FROM direct_rep"),
}

_RECORD_COLUMNS = f"path, gav, {_sorted('list_distinct(dependencies)')} AS dependencies, CAST(len(list_distinct(dependencies)) AS INTEGER) AS n_dependencies"
_LOGS = "SELECT clientId, timestamp, agent, path FROM logs"
# lines with an extra field do not reach the jobs
_GOOD_LOGS = LOGS.replace("FROM events)", "FROM events WHERE event_id % 97 <> 0)")
_GOOD_RECORDS = RECORDS.replace("FROM part)", "FROM part WHERE p_partkey % 97 <> 0)")
_JOB_PIPE = (_GOOD_LOGS, _GOOD_RECORDS, GAV_LOGS, FLAGS, SESSIONS)


def _on_good_lines(*ctes: str) -> tuple[str, ...]:
    swap = {LOGS: _GOOD_LOGS, RECORDS: _GOOD_RECORDS}
    return tuple(swap.get(c, c) for c in ctes)


_WINDOW = RANGE.replace(str(parse_bound(C.REPORT_START)), str(parse_bound(C.WINDOW_START))).replace(
    str(parse_bound(C.REPORT_END)), str(parse_bound(C.WINDOW_END)))

ORACLE |= {
    "file_repository_logs": ORACLE["parse_repository_logs"],
    "file_dependency_records": ORACLE["parse_dependency_records"],
    "file_graph_records": _sql(RECORDS, f"""named AS (
          SELECT 'names/' || replace(p_name, ' ', '-') || '.pom' AS path, gav, dependencies FROM records)""",
        body=f"SELECT {_RECORD_COLUMNS} FROM named"),
    "file_parquet_table": _sql(LOGS, body=_LOGS),
    "file_create_only": _sql(LOGS, body=_LOGS),
    "file_read_or_create": _sql(LOGS, body=_LOGS),
    "file_reused_table": _sql(LOGS, """per AS (SELECT clientId, count(*) AS n FROM logs WHERE event_id % 97 <> 0 GROUP BY 1)""",
        f"""steps(step, times, least) AS (VALUES (0, 1, {C.REUSE_LEAST[0]}), (1, 1, {C.REUSE_LEAST[0]}),
          (2, 1, {C.REUSE_LEAST[1]}), (3, 2, {C.REUSE_LEAST[1]}))""", body="""
        SELECT step, clientId, n * times AS downloads FROM per, steps WHERE n * times >= least"""),
    "file_graph_nodes": _sql(RECORDS, RETAINED, NODES, body="SELECT id, 'GAV' AS label, true AS sorted FROM nodes"),
    "file_graph_edges": _sql(RECORDS, RETAINED, EDGES, CLOSURE, body="""
        SELECT src, dst, 'D_DEPENDS_ON' AS type FROM edges
        UNION ALL SELECT src, dst, 'T_DEPENDS_ON' AS type FROM closure"""),
    "file_usage_report": _sql(*ENHANCED, body="""
        SELECT gav, clients, 'direct' AS kind FROM direct_rep
        UNION ALL SELECT gav, clients, 'indirect' AS kind FROM indirect_rep"""),
    "file_adjacency": _sql(f"""adj AS (
          SELECT DISTINCT src, dst FROM (
            SELECT 'org.part:p' || p_partkey AS src, unnest({_PART_DEPS}) AS dst FROM part WHERE p_partkey % 5 <> 4))""",
        body="SELECT DISTINCT id FROM (SELECT 'org.part:p' || p_partkey AS id FROM part UNION ALL SELECT dst AS id FROM adj)"),
    "job_build_graph": _sql(_GOOD_RECORDS, RETAINED, NODES, EDGES, CLOSURE, body="""
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges,
               (SELECT count(*) FROM closure) AS closure,
               (SELECT count(*) FROM part WHERE p_partkey % 97 = 0) AS rejected"""),
    "job_resolve": _sql(_GOOD_LOGS, _GOOD_RECORDS, GAV_LOGS, body="""
        SELECT clientId, timestamp, agent, gav, true AS sorted FROM gav_logs"""),
    "job_sessionise": _sql(*_JOB_PIPE, body=f"SELECT {SESSION_COLS}, {_DAY} AS day FROM sessions"),
    "job_dependencies": _sql(*[_WINDOW if c == RANGE else c for c in _on_good_lines(*ENHANCED)], body=f"""
        SELECT clientId, sessionId, {_sorted('dependencies')} AS dependencies, CAST(len(dependencies) AS INTEGER) AS n_dependencies
        FROM enhanced"""),
    "job_dependencies_hops": _sql(*_JOB_PIPE, RANGE, SG, SEEDS, RETAINED, EDGES,
        _reach("reach", "SELECT gav FROM seeds", str(C.SESSION_HOPS)), _deps_from("reach"),
        body="SELECT clientId, sessionId, dependency FROM deps"),
    "job_report": _sql(*_on_good_lines(*ENHANCED), body="SELECT gav, clients FROM direct_rep"),
    "job_daily_report": _sql(*_on_good_lines(*ENHANCED), body=f"""
        SELECT kind, day, gav, count(DISTINCT clientId) AS clients FROM (
          SELECT 'direct' AS kind, {_DAY} AS day, clientId, unnest(direct) AS gav FROM split
          UNION ALL SELECT 'indirect' AS kind, {_DAY} AS day, clientId, unnest(indirect) AS gav FROM split)
        GROUP BY kind, day, gav"""),
    "job_report_days": _sql(*_on_good_lines(*ENHANCED), body=_USAGE_OF_DAYS),
    "job_depth_sweep": ORACLE["depth_sweep"].replace(LOGS, _GOOD_LOGS).replace(RECORDS, _GOOD_RECORDS),
}
