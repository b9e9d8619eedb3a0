"""SQL building blocks for checking the queries with another engine.

Each block is one common table expression over the driver's tables; ``sql`` puts the ones
a statement needs in front of it.
"""

from __future__ import annotations

import re

from ..constants import FEATURE_COLUMNS

_LINE = (r'^\s*(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+) '
         r'"([^"]*)" "([^"]*)"')
_COMMON = r'^\s*(\S+) - (\S+) \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\d+)'
_NAMES = ("ip", "remote_user", "time_local", "method", "url", "protocol", "status",
          "size", "referer", "agent")


def _names(count):
    return "[" + ",".join(f"'{n}'" for n in _NAMES[:count]) + "]"


def logs_select(pattern: str, groups: int, lines: str = "lines") -> str:
    """Typed rows of ``lines`` (log_id, source, value); ``ok`` tells which parsed."""
    referer = "nullif(g.referer, '-')" if groups == 10 else "'-'"
    agent = "g.agent" if groups == 10 else "'-'"
    last = "list_last(string_split_regex(trim(value), '\\s+'))"
    return f"""
      SELECT log_id, source, value AS raw_line, ok,
        CASE WHEN ok THEN g.ip END AS ip,
        CASE WHEN ok THEN nullif(g.remote_user, '-') END AS remote_user,
        CASE WHEN ok THEN time_utc END AS timestamp,
        CASE WHEN ok THEN g.method END AS method,
        CASE WHEN ok THEN g.url END AS url,
        CASE WHEN ok THEN split_part(g.url, '?', 1) END AS url_path,
        CASE WHEN ok THEN g.protocol END AS protocol,
        CASE WHEN ok THEN try_cast(g.status AS INTEGER) END AS status_code,
        CASE WHEN ok THEN try_cast(g.size AS BIGINT) END AS body_bytes_sent,
        CASE WHEN ok THEN {referer} END AS http_referer,
        CASE WHEN ok THEN {agent} END AS user_agent,
        CASE WHEN ok AND len(string_split_regex(trim(value), '\\s+')) > 10
              AND regexp_full_match({last}, '[0-9.]+')
             THEN try_cast({last} AS DOUBLE) END AS response_time
      FROM (SELECT *, regexp_matches(value, '{pattern}') AND time_utc IS NOT NULL AS ok
            FROM (SELECT *, try_strptime(substr(g.time_local, 1, 20), '%d/%b/%Y:%H:%M:%S')
                         AS time_utc
                  FROM (SELECT *, regexp_extract(value, '{pattern}', {_names(groups)}) AS g
                        FROM {lines})))"""


BLOCKS: dict[str, str] = {
    "lines": """
      SELECT event_id AS log_id, 'site' || (user_id % 3) AS source,
        '10.0.' || (user_id // 256) || '.' || (user_id % 256) || ' - - ['
        || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "'
        || CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END
        || ' /' || event_type || '/' || (k % 10) || '?k=' || k || ' HTTP/1.1" '
        || CASE WHEN event_type = 'error' THEN
             CASE WHEN k < 50 THEN 500 WHEN k < 75 THEN 404 WHEN k < 90 THEN 503 ELSE 400 END
           WHEN event_type = 'signup' THEN 201 ELSE 200 END
        || ' ' || CASE WHEN event_id % 97 = 0 THEN '-'
                  ELSE CAST(100 + (event_id * 37) % 5000 AS VARCHAR) END
        || ' "-" "Mozilla/5.0 (X11)" ' || value AS value
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "parsed": logs_select(_LINE, 10),
    "logs": "SELECT * EXCLUDE (ok) FROM parsed WHERE ok",
    "anchored": """
      SELECT l.*, a.t0, (epoch_us(l.timestamp) - epoch_us(a.t0)) // 3600000000 AS window_id
      FROM logs l JOIN (SELECT source, min(timestamp) AS t0 FROM logs GROUP BY source) a
        USING (source)""",
    "totals": """
      SELECT source, window_id, min(t0) + to_seconds(CAST(window_id AS BIGINT) * 3600) AS timestamp,
        count(*) AS total_requests, count(*) / 60.0 AS rps,
        count(*) FILTER (status_code >= 500) * 100.0 / count(*) AS error_rate_5xx,
        count(*) FILTER (status_code BETWEEN 400 AND 499) * 100.0 / count(*) AS error_rate_4xx,
        count(*) FILTER (status_code = 404) * 100.0 / count(*) AS error_rate_404,
        coalesce(avg(response_time), 0) AS avg_response_time,
        coalesce(max(response_time), 0) AS max_response_time,
        coalesce(min(response_time), 0) AS min_response_time,
        CASE WHEN count(response_time) = 0 THEN 0 ELSE stddev_samp(response_time) END
          AS std_response_time,
        count(DISTINCT ip) AS unique_ips, count(DISTINCT url_path) AS unique_paths,
        count(*) FILTER (method = 'GET') / count(*) AS get_ratio,
        count(*) FILTER (method = 'POST') / count(*) AS post_ratio
      FROM anchored GROUP BY source, window_id""",
    "top_ips": """
      SELECT source, window_id, max(c) AS top_ip_count
      FROM (SELECT source, window_id, ip, count(*) AS c FROM anchored GROUP BY ALL)
      GROUP BY source, window_id""",
    "top_paths": """
      SELECT source, window_id, max(c) AS top_path_count
      FROM (SELECT source, window_id, url_path, count(*) AS c FROM anchored GROUP BY ALL)
      GROUP BY source, window_id""",
    "features": """
      SELECT *, top_path_count / total_requests AS top_path_ratio,
        CASE WHEN lag(rps) OVER w > 0
          THEN (rps - lag(rps) OVER w) / lag(rps) OVER w * 100 ELSE 0 END AS rps_change,
        CASE WHEN lag(error_rate_5xx) OVER w > 0
          THEN (error_rate_5xx - lag(error_rate_5xx) OVER w) / lag(error_rate_5xx) OVER w * 100
          ELSE 0 END AS error_rate_5xx_change,
        CASE WHEN lag(error_rate_404) OVER w > 0
          THEN (error_rate_404 - lag(error_rate_404) OVER w) / lag(error_rate_404) OVER w * 100
          ELSE 0 END AS error_rate_404_change,
        CASE WHEN lag(avg_response_time) OVER w > 0
          THEN (avg_response_time - lag(avg_response_time) OVER w)
            / lag(avg_response_time) OVER w * 100
          ELSE 0 END AS avg_response_time_change
      FROM totals JOIN top_ips USING (source, window_id) JOIN top_paths USING (source, window_id)
      WINDOW w AS (PARTITION BY source ORDER BY window_id)""",
    # Stand-in scores, so that everything behind a model can be checked by value.
    "scored": """
      SELECT source, window_id, timestamp, timestamp AS window_start, error_rate_5xx,
        avg_response_time, round(top_path_ratio, 6) AS anomaly_score,
        error_rate_5xx > 20 AS is_anomaly
      FROM features""",
    "rounded_scores": """
      SELECT *, round(error_rate_5xx, 9) AS shown_rate,
             round(avg_response_time, 9) AS shown_time FROM scored""",
    "alerts": """
      SELECT source, timestamp, 'error_rate' AS alert_type, 'high' AS severity,
        '5xx 에러 비율이 ' || printf('%.2f', shown_rate) || '%로 임계값을 초과했습니다.'
          AS message, window_id, shown_rate AS value
      FROM rounded_scores WHERE error_rate_5xx > 5.0
      UNION ALL
      SELECT source, timestamp, 'response_time', 'medium',
        '평균 응답 시간이 ' || printf('%.2f', shown_time) || 'ms로 임계값을 초과했습니다.',
        window_id, shown_time
      FROM rounded_scores WHERE avg_response_time > 50
      UNION ALL
      SELECT source, timestamp, 'anomaly', 'high',
        '이상 패턴이 감지되었습니다. (점수: ' || printf('%.4f', anomaly_score) || ')',
        window_id, anomaly_score
      FROM rounded_scores WHERE is_anomaly OR anomaly_score > 0.75""",
    "vectors": "SELECT source, window_id, timestamp, ["
               + ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0)" for c in FEATURE_COLUMNS)
               + "] AS features FROM features",
}


def _needed(text: str, blocks: dict[str, str], found: list[str]) -> None:
    for name, body in blocks.items():
        if name not in found and re.search(rf"\b(FROM|JOIN)\s*\(*\s*{name}\b", text):
            _needed(body, blocks, found)
            if name not in found:
                found.append(name)


def sql(statement: str, **extra: str) -> str:
    """``statement`` with the blocks it uses, and ``extra`` ones, in front."""
    blocks = {**BLOCKS, **extra}
    found: list[str] = []
    _needed(statement, blocks, found)
    if not found:
        return statement
    ctes = ",\n".join(f"{name} AS ({blocks[name]})" for name in found)
    return f"WITH {ctes}\n{statement}"


def rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in columns)


COMBINED, COMMON = _LINE, _COMMON
