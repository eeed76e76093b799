"""SQL common table expressions shared by the comparison queries."""

NOW = 1706659200000000000
START = 1703980800000000000
WEEK = 604800000000000

LOG_CTES = """
ev AS (
  SELECT event_id, epoch_us(ts) * 1000 AS timestamp_ns, ts, user_id, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
shaped AS (
  SELECT *, 'log-' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS log_id,
    'tr-' || user_id || '-' || strftime(ts, '%Y%m%d') AS trace_id,
    event_type IN ('error', 'purchase') AS is_tool,
    event_type = 'purchase' AND k % 4 = 0 AS is_patch,
    CASE k % 5 WHEN 0 THEN 'pytest' WHEN 1 THEN 'ruff' WHEN 2 THEN 'rg' WHEN 3 THEN 'sed'
      ELSE 'git' END AS exe,
    'src/m' || (k % 3) || '.py' AS file,
    CASE WHEN dayofmonth(ts) % 5 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'th-' || user_id
      WHEN user_id % 3 = 2 THEN 'th-' || user_id || '-' || (dayofmonth(ts) % 2) END AS thread,
    CASE WHEN user_id % 7 <> 0 THEN '/work/p' || (user_id % 6) || '/src' END AS cwd,
    timestamp_ns // 1800000000000 * 1800 AS ts_bucket_start,
    CASE WHEN event_id % 50 = 49 THEN 'other' ELSE 'codex_cli_rs' END AS service
  FROM ev),
scanned AS (
  SELECT event_id, k, event_type, timestamp_ns, log_id, trace_id, is_patch, exe, file, value,
    CASE WHEN is_tool THEN 'codex.tool_result' WHEN event_type = 'click' THEN 'codex.api_request'
      WHEN event_type = 'view' THEN 'codex.tool_decision' ELSE 'codex.sandbox_outcome' END
      AS event_name,
    CASE WHEN user_id % 4 <> 0 THEN 'cv-' || user_id END AS conversation_id,
    CASE WHEN is_tool THEN 'call-' || lpad(CAST(event_id AS VARCHAR), 10, '0') END AS call_id,
    CASE WHEN is_patch THEN 'apply_patch' WHEN is_tool THEN 'exec_command' END AS tool_name,
    CASE event_type WHEN 'error' THEN 'false' WHEN 'purchase' THEN 'true' END AS success_string,
    CASE WHEN event_type = 'click' THEN CASE WHEN k < 10 THEN false WHEN k < 60 THEN true END END
      AS success_bool,
    CASE k WHEN 1 THEN '01' WHEN 2 THEN '1e3' WHEN 3 THEN '10ms' ELSE CAST(value AS VARCHAR) END
      AS duration_text,
    CAST(CASE WHEN event_type = 'click' THEN CASE WHEN k >= 90 THEN 503 WHEN k >= 80 THEN 429
      WHEN k >= 60 THEN 200 END END AS BIGINT) AS status_code,
    CASE WHEN event_type = 'view' THEN CASE WHEN k < 50 THEN 'approved' ELSE 'denied' END END
      AS decision,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'user' ELSE 'config' END END
      AS decision_source,
    CASE WHEN event_type = 'click' THEN k END AS prompt_length,
    CASE WHEN event_type = 'signup' AND k < 30 THEN 'denied' END AS raw_outcome,
    CAST(CASE WHEN event_type = 'error' THEN 1 WHEN event_type = 'purchase' AND NOT is_patch
      THEN 0 END AS BIGINT) AS exit_code,
    CASE WHEN is_patch THEN '{"path":"' || file || '"}'
      WHEN is_tool THEN '{"cmd":["' || exe || '",' || CASE exe WHEN 'ruff' THEN '"check",'
        WHEN 'git' THEN '"status",' ELSE '' END || '"' || file || '"]}' END AS arguments,
    CASE WHEN event_type = 'error' THEN 'failed token=abc' || k || ' end' END AS output
  FROM shaped
  WHERE service = 'codex_cli_rs' AND timestamp_ns > 1703980800000000000
    AND timestamp_ns <= 1706659200000000000),
logs AS (SELECT * FROM scanned WHERE k NOT IN (1, 2, 3)),
traces AS (
  SELECT trace_id, min_by('turn-' || event_id, (timestamp_ns, 'turn-' || event_id)) AS turn_id,
    min(thread) AS thread_id, min(cwd) AS cwd,
    min(timestamp_ns) AS started_at_ns, max(timestamp_ns) AS ended_at_ns,
    CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN floor(value * 100) END), 0)
      AS BIGINT) AS total_tokens,
    count(CASE WHEN event_type = 'error' THEN 1 END) AS tool_calls
  FROM shaped GROUP BY trace_id),
"""

EVENT_CTES = LOG_CTES + """
placed AS (
  SELECT *, CASE WHEN cwd IS NOT NULL THEN 'git:' || sha256(encode('git') || '\\x00'::BLOB
    || encode(regexp_replace(cwd, '/src$', ''))) END AS project FROM traces),
threads AS (
  SELECT conversation_id, min(t.thread_id) AS thread_id
  FROM logs l JOIN traces t USING (trace_id)
  WHERE conversation_id IS NOT NULL AND t.thread_id IS NOT NULL
  GROUP BY conversation_id HAVING count(DISTINCT t.thread_id) = 1),
linked AS (
  SELECT l.*, t.thread_id, t.project, m.thread_id AS mapped,
    coalesce(t.thread_id, l.conversation_id, l.trace_id) AS hint
  FROM logs l LEFT JOIN placed t USING (trace_id)
  LEFT JOIN threads m USING (conversation_id)),
hydrated AS (
  SELECT *, success_string = 'false' OR (event_name = 'codex.api_request'
      AND (success_bool = false OR status_code >= 400))
    OR event_name IN ('codex.sandbox_outcome', 'codex.tool_decision')
    OR (tool_name IS NOT NULL AND count(*) OVER (PARTITION BY hint, tool_name) >= 2)
    AS listed
  FROM linked),
detector_events AS (
  SELECT log_id AS event_id, timestamp_ns,
    coalesce(project, 'unresolved:' || task_id) AS project_id, task_id,
    NOT starts_with(task_id, 'episode:') AS counts_as_distinct_task,
    CASE WHEN decision_source = 'user' THEN 'turn/steer' ELSE event_name END AS event_name,
    CASE WHEN op THEN CASE WHEN is_patch THEN 'tool' ELSE 'shell' END END AS op_kind,
    CASE WHEN op THEN CASE WHEN is_patch THEN 'apply_patch' ELSE exe END END AS op_executable,
    CASE WHEN op AND NOT is_patch THEN CASE exe WHEN 'ruff' THEN 'check' WHEN 'git' THEN 'status'
      END END AS op_subcommand,
    CASE WHEN op THEN file END AS op_target,
    CASE WHEN op THEN exit_code END AS op_exit_code,
    CASE WHEN op THEN CASE WHEN is_patch THEN 'patch|' ELSE exe || '|' END || file END AS op_key,
    success_string, success_bool, status_code,
    CASE WHEN decision_source = 'user' THEN decision WHEN listed THEN raw_outcome END AS outcome,
    coalesce(tool_name = 'apply_patch', false) AS is_mutation,
    CAST(NULL AS BIGINT) AS token_count,
    CASE WHEN k % 20 = 0 THEN 'review' END AS skill_required,
    CASE WHEN k % 20 = 0 AND k <> 0 THEN k < 50 END AS skill_used
  FROM (SELECT *, listed AND tool_name IS NOT NULL AS op,
      coalesce('thread:' || thread_id, 'thread:' || mapped, 'conversation:' || conversation_id,
        'episode:' || trace_id) AS task_id FROM hydrated)
  UNION ALL
  SELECT 'trace:' || trace_id, ended_at_ns, coalesce(project, 'unresolved:' || task_id), task_id,
    thread_id IS NOT NULL, 'trace.episode', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
    NULL, false, total_tokens, NULL, NULL
  FROM (SELECT *, coalesce('thread:' || thread_id, 'episode:' || trace_id) AS task_id
        FROM placed WHERE total_tokens > 0)),
fields AS (
  SELECT *, coalesce(op_kind, 'event') AS operation_kind,
    CASE WHEN op_kind IS NULL THEN 'none' ELSE 'path' END AS target_kind,
    CASE WHEN op_kind IS NULL THEN event_name ELSE op_target END AS normalized_target
  FROM detector_events),
"""


def members(detector: str, rows: str, group: str = "event_id", ordinal: str = "1",
            count: str = "1") -> str:
    """Member rows of one detector from ``rows`` (which carries failure_class)."""
    return f"""
  SELECT '{detector}' AS detector_id, {group} AS grp, CAST({ordinal} AS BIGINT) AS ordinal,
    CAST({count} AS BIGINT) AS member_count, event_id, timestamp_ns, project_id, task_id,
    operation_kind, target_kind, normalized_target, failure_class, explanation
  FROM ({rows})"""


_FAILURE = """SELECT *, CASE
    WHEN event_name = 'codex.tool_result' AND success_string = 'false' THEN 'tool_result_false'
    WHEN event_name = 'codex.api_request' AND success_bool = false THEN 'transport_success_false'
    WHEN event_name = 'codex.api_request' AND status_code >= 400
      THEN 'http_' || (status_code // 100) || 'xx' END AS failure_class FROM fields"""
_ORDER = "ORDER BY timestamp_ns, event_id"

DETECTOR_SQL = {
    "tool_failure": members("tool_failure", f"""
      SELECT *, event_name || ' satisfies the explicit ' || failure_class || ' predicate'
        AS explanation FROM ({_FAILURE}) WHERE failure_class IS NOT NULL"""),
    "transport_instability": members("transport_instability", f"""
      SELECT *, 'API or WebSocket telemetry records an explicit transport failure'
        AS explanation FROM ({_FAILURE}) WHERE event_name = 'codex.api_request'
        AND (success_bool = false OR status_code >= 400)"""),
    "sandbox_friction": members("sandbox_friction", """
      SELECT *, coalesce(outcome, 'sandbox_outcome') AS failure_class,
        'event is an observed codex.sandbox_outcome' AS explanation
      FROM fields WHERE event_name = 'codex.sandbox_outcome'"""),
    "turn_correction": members("turn_correction", """
      SELECT *, event_name AS failure_class, 'trace contains ' || event_name AS explanation
      FROM fields WHERE event_name = 'turn/steer'"""),
    "skill_adherence": members("skill_adherence", """
      SELECT *, 'required_skill_not_used' AS failure_class,
        'required skill ''' || skill_required || ''' was explicitly not used' AS explanation
      FROM fields WHERE skill_required IS NOT NULL AND skill_used = false"""),
    "repeated_attempt": members("repeated_attempt", f"""
      SELECT *, 'same_normalized_operation' AS failure_class,
        'the same normalized operation occurred ' || n || ' times in one task' AS explanation
      FROM (SELECT *, count(*) OVER (PARTITION BY project_id, task_id, op_key) AS n,
          row_number() OVER (PARTITION BY project_id, task_id, op_key {_ORDER}) AS nth
        FROM fields WHERE op_key IS NOT NULL) WHERE n >= 2""",
        "project_id || task_id || op_key", "nth", "n"),
    "command_churn": members("command_churn", f"""
      SELECT *, 'three_distinct_commands_same_target' AS failure_class, kinds ||
        ' distinct normalized shell commands targeted the same path' AS explanation
      FROM (SELECT f.*, g.kinds, count(*) OVER w AS n, row_number() OVER (w {_ORDER}) AS nth
        FROM fields f JOIN (SELECT project_id, task_id, op_target, count(DISTINCT op_key) AS kinds
            FROM fields WHERE op_kind = 'shell' GROUP BY ALL) g
          USING (project_id, task_id, op_target)
        WHERE op_kind = 'shell' WINDOW w AS (PARTITION BY project_id, task_id, op_target))
      WHERE kinds >= 3""", "project_id || task_id || op_target", "nth", "n"),
    "scope_recurrence": members("scope_recurrence", f"""
      SELECT *, 'same_scope_multiple_canonical_tasks' AS failure_class,
        'the normalized target recurred across ' || tasks || ' canonical tasks' AS explanation
      FROM (SELECT f.*, g.tasks, count(*) OVER w AS n, row_number() OVER (w {_ORDER}) AS nth
        FROM fields f JOIN (SELECT project_id, op_target,
              count(DISTINCT CASE WHEN counts_as_distinct_task THEN task_id END) AS tasks
            FROM fields WHERE op_target IS NOT NULL GROUP BY ALL) g
          USING (project_id, op_target)
        WINDOW w AS (PARTITION BY project_id, op_target))
      WHERE tasks >= 2""", "project_id || op_target", "nth", "n"),
    "quality_gate_bypass": members("quality_gate_bypass", f"""
      SELECT m.*, h.gate_id, h.n, 'mutation_between_failed_and_passing_gate' AS failure_class,
        'a failed quality command was followed by mutation before same normalized command passed'
          AS explanation,
        row_number() OVER (PARTITION BY h.gate_id ORDER BY m.timestamp_ns, m.event_id) AS nth
      FROM (SELECT *, (SELECT count(*) FROM stamped s WHERE s.is_mutation AND NOT s.gate
              AND s.project_id = g.project_id AND s.task_id = g.task_id
              AND s.pos > g.prev_pos AND s.pos < g.pos) + 2 AS n
        FROM (SELECT event_id AS gate_id, project_id, task_id, pos, op_exit_code,
            lag(op_exit_code) OVER w AS prev_exit, lag(pos) OVER w AS prev_pos
          FROM stamped WHERE gate
          WINDOW w AS (PARTITION BY project_id, task_id, op_key ORDER BY pos)) g
        WHERE op_exit_code = 0 AND prev_exit <> 0) h
      JOIN stamped m ON m.project_id = h.project_id AND m.task_id = h.task_id
        AND m.pos BETWEEN h.prev_pos AND h.pos
        AND (m.pos IN (h.prev_pos, h.pos) OR (m.is_mutation AND NOT m.gate))
      WHERE h.n > 2""", "gate_id", "nth", "n"),
    "token_outlier": members("token_outlier", """
      SELECT *, 'token_above_project_p95' AS failure_class,
        'token count ' || token_count || ' exceeds p95 ' || p95 || ' from ' || n_values
          || ' comparable episodes' AS explanation
      FROM fields JOIN baselines USING (project_id)
      WHERE token_count IS NOT NULL AND n_values >= 20 AND token_count > p95""",
        "event_id || ':token'"),
}

DETECT_CTES = EVENT_CTES + f"""
stamped AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, task_id {_ORDER}) AS pos,
    coalesce(op_kind = 'shell' AND op_executable IN ('pytest', 'ruff')
      AND op_exit_code IS NOT NULL, false) AS gate FROM fields),
baselines AS (
  SELECT project_id, min(token_count) AS p95, min(n) AS n_values FROM (
    SELECT project_id, token_count, count(*) OVER (PARTITION BY project_id) AS n,
      row_number() OVER (PARTITION BY project_id ORDER BY token_count) AS r
    FROM fields WHERE token_count IS NOT NULL)
  WHERE r >= ceil(0.95::DOUBLE * n) GROUP BY project_id),
keyed AS (
  SELECT *, row_number() OVER (PARTITION BY project_id, task_id {_ORDER}) AS op_pos
  FROM fields WHERE op_key IS NOT NULL),
same AS (
  SELECT project_id, task_id, lag, op_pos,
    op_pos - row_number() OVER (PARTITION BY project_id, task_id, lag ORDER BY op_pos) AS island
  FROM (SELECT a.project_id, a.task_id, a.op_pos, b.op_pos - a.op_pos AS lag
    FROM keyed a JOIN keyed b ON b.project_id = a.project_id AND b.task_id = a.task_id
      AND b.op_key = a.op_key AND b.op_pos > a.op_pos)),
loops AS (
  SELECT project_id, task_id, first_pos, total FROM (
    SELECT *, row_number() OVER (PARTITION BY project_id, task_id
      ORDER BY total DESC, first_pos) AS r
    FROM (SELECT project_id, task_id, lag, min(op_pos) AS first_pos,
        ((count(*) // lag) + 1) * lag AS total, count(*) AS run
      FROM same GROUP BY project_id, task_id, lag, island)
    WHERE run >= lag AND ((lag = 1 AND total >= 3) OR (lag > 1 AND total >= 4)))
  WHERE r = 1),
"""

DETECTOR_SQL["tool_loop"] = members("tool_loop", """
      SELECT k.*, k.op_pos - l.first_pos + 1 AS nth, l.total AS n,
        'repeating_contiguous_operation_cycle' AS failure_class,
        'contiguous normalized operations form a repeated cycle' AS explanation
      FROM keyed k JOIN loops l USING (project_id, task_id)
      WHERE k.op_pos BETWEEN l.first_pos AND l.first_pos + l.total - 1""",
    "project_id || task_id", "nth", "n")

# The literal rule takes the second repetition for granted: every start and cycle length.
TOOL_LOOP_LITERAL = members("tool_loop", """
      SELECT k.*, k.op_pos - l.first_pos + 1 AS nth, l.total AS n,
        'repeating_contiguous_operation_cycle' AS failure_class,
        'contiguous normalized operations form a repeated cycle' AS explanation
      FROM keyed k JOIN (
        SELECT project_id, task_id, first_pos, total FROM (
          SELECT *, row_number() OVER (PARTITION BY project_id, task_id
            ORDER BY total DESC, first_pos) AS r
          FROM (SELECT *, 2 * lag + ((coalesce(stop, n + 1) - first_pos - 2 * lag) // lag) * lag
                AS total FROM (
            SELECT c.project_id, c.task_id, c.n, c.first_pos, c.lag,
              min(CASE WHEN a.op_key <> b.op_key THEN a.op_pos END) AS stop
            FROM (SELECT *, unnest(range(1, (n - first_pos + 1) // 2 + 1)) AS lag
                FROM (SELECT *, unnest(range(1, n)) AS first_pos
                  FROM (SELECT project_id, task_id, max(op_pos) AS n FROM keyed GROUP BY ALL))) c
              LEFT JOIN keyed a ON a.project_id = c.project_id AND a.task_id = c.task_id
                AND a.op_pos >= c.first_pos + 2 * c.lag
              LEFT JOIN keyed b ON b.project_id = c.project_id AND b.task_id = c.task_id
                AND b.op_pos = c.first_pos + (a.op_pos - c.first_pos) % c.lag
            GROUP BY ALL))
          WHERE (lag = 1 AND total >= 3) OR (lag > 1 AND total >= 4))
        WHERE r = 1) l USING (project_id, task_id)
      WHERE k.op_pos BETWEEN l.first_pos AND l.first_pos + l.total - 1""",
    "project_id || task_id", "nth", "n")

RECORD_CTES = DETECT_CTES + "members AS (" + "\n  UNION ALL".join(DETECTOR_SQL.values()) + """),
printed AS (
  SELECT *, sha256(CAST(to_json({category: detector_id, detector_version: 1,
    normalized_failure_class: failure_class, normalized_target: normalized_target,
    operation_kind: operation_kind, project_identity: project_id, target_kind: target_kind})
    AS VARCHAR)) AS fingerprint
  FROM members WHERE ordinal = 1),
lists AS (
  SELECT detector_id, grp, CASE count(*) WHEN 1 THEN min(ids)
      ELSE sha256(string_agg(ids, chr(31) ORDER BY top)) END AS ids
  FROM (SELECT detector_id, grp, node // 100 AS top, CASE WHEN max(member_count) <= 100
      THEN min(ids) ELSE sha256(string_agg(ids, chr(31) ORDER BY node)) END AS ids
    FROM (SELECT detector_id, grp, (ordinal - 1) // 100 AS node, max(member_count) AS member_count,
        sha256(string_agg(event_id, chr(31) ORDER BY ordinal)) AS ids
      FROM members GROUP BY ALL)
    GROUP BY ALL)
  GROUP BY detector_id, grp),
records AS (
  SELECT sha256(p.fingerprint || chr(31) || l.ids) AS observation_id, p.detector_id,
    CASE WHEN NOT starts_with(project_id, 'unresolved:') THEN project_id END
      AS project_identity_id,
    task_id AS task_identity, timestamp_ns AS occurred_at_ns, fingerprint, operation_kind,
    target_kind, normalized_target, failure_class AS normalized_failure_class,
    explanation AS membership_explanation, member_count, event_id AS first_event_id,
    p.detector_id || chr(31) || p.grp AS grp_key
  FROM printed p JOIN lists l USING (detector_id, grp)),
member_rows AS (
  SELECT r.observation_id, m.ordinal, m.event_id, m.timestamp_ns
  FROM members m JOIN records r ON r.grp_key = m.detector_id || chr(31) || m.grp),
"""


REDACT = """regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
  '(?i)\\b(api[_-]?key|token|password|secret)\\b\\s*[:=]\\s*[''"]?([^\\s''"]+)',
  '\\1=[REDACTED]', 'g'), '\\bsk-[A-Za-z0-9_-]{{16,}}\\b', '[REDACTED]', 'g'),
  '\\bgh[oprsu]_[A-Za-z0-9]{{20,}}\\b', '[REDACTED]', 'g'),
  '\\bAKIA[A-Z0-9]{{16}}\\b', '[REDACTED]', 'g')"""


def sql(body: str, ctes: str = LOG_CTES) -> str:
    return "WITH " + ctes.strip().rstrip(",") + "\n" + body
