"""DuckDB text of the derived tables (the oracle side of ``clickspark.sources.fixtures``).

Only the driver tables are registered in the oracle, so every oracle query inlines the
derived tables it needs as common table expressions.
"""

from __future__ import annotations

VIEW_SQL = {
    "click_events": """
SELECT CAST(e.event_id AS VARCHAR) AS event_id,
  concat('c', lpad(regexp_extract(e.props, '([0-9]+)', 1), 2, '0')) AS short_code,
  CAST(date_trunc('millisecond', e.ts) AS TIMESTAMP) AS clicked_at,
  CAST(e.ts AS DATE) AS clicked_date,
  CASE WHEN e.user_id % 10 = 0 THEN concat('10.0.0.', CAST(e.user_id % 256 AS VARCHAR))
       WHEN e.user_id % 10 = 1 THEN 'not-an-ip'
       WHEN e.user_id % 10 = 2 THEN '127.0.0.1'
       ELSE concat('203.0.113.', CAST(e.user_id % 256 AS VARCHAR)) END AS ip_address,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE n.n_name END AS country,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE concat('N', lpad(CAST(n.n_nationkey AS VARCHAR), 2, '0')) END AS country_code,
  CASE WHEN e.user_id % 7 = 0 THEN '' ELSE concat('city', CAST(e.user_id % 40 AS VARCHAR)) END AS city,
  CASE e.event_id % 4 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' WHEN 2 THEN 'bot' ELSE 'tablet' END AS device_type,
  CASE e.event_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' ELSE 'Firefox' END AS browser,
  CASE e.user_id % 3 WHEN 0 THEN 'Windows' WHEN 1 THEN 'Linux' ELSE 'Android' END AS os,
  CASE e.event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'https://search.example.com'
       WHEN 2 THEN 'https://news.example.org' WHEN 3 THEN 'direct' ELSE CAST(NULL AS VARCHAR) END AS referer
FROM events e JOIN nation n ON n.n_nationkey = CAST(e.user_id % 25 AS INT)""",
    "raw_click": """
SELECT concat('c', lpad(regexp_extract(props, '([0-9]+)', 1), 2, '0')) AS short_code,
  CASE WHEN event_id % 50 = 0 THEN CAST(NULL AS VARCHAR) WHEN event_id % 50 = 1 THEN 'bad'
       ELSE CAST(1704067200 + event_id * 60 AS VARCHAR) END AS "timestamp",
  CASE WHEN user_id % 10 = 1 THEN CAST(NULL AS VARCHAR) WHEN user_id % 10 = 2 THEN '::1'
       WHEN user_id % 10 = 3 THEN '192.168.1.7'
       WHEN user_id % 10 = 4 THEN ['12:34', 'fc00:1', ':::', '1:2:3:4:5:6:7:8', 'fe80::1', '::ffff:10.0.0.1', 'fd12:3456::1', 'fc::1',
                                   '::ffff:8.8.8.8', '0:0::0:1', '1::2::3'][event_id % 11 + 1]
       ELSE concat('203.0.113.', CAST(user_id % 256 AS VARCHAR)) END AS ip,
  CASE event_id % 6
    WHEN 0 THEN 'Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36'
    WHEN 1 THEN 'Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1'
    WHEN 2 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1; +http://www.google.com/bot.html)'
    WHEN 3 THEN 'Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0'
    WHEN 4 THEN 'Mozilla/5.0 (Linux; Android 14; Pixel 8) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Mobile Safari/537.36'
    ELSE 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Safari/605.1.15' END AS user_agent,
  CAST(NULL AS VARCHAR) AS original_url,
  CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS VARCHAR) ELSE 'https://news.example.org' END AS referer,
  concat('k=', regexp_extract(props, '([0-9]+)', 1)) AS query_params
FROM events""",
    "urls": """
SELECT printf('c%02d', page_id) AS short_code, url AS long_url, CAST(0 AS BIGINT) AS clicks,
  CAST(TIMESTAMP '2023-12-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS TIMESTAMP) AS created_at,
  CASE WHEN page_id % 3 = 0 THEN CAST(NULL AS TIMESTAMP)
       ELSE CAST(TIMESTAMP '2024-01-10 00:00:00' + page_id * INTERVAL '6' HOUR AS TIMESTAMP) END AS expires_at,
  CASE WHEN page_id % 5 = 0 THEN CAST(NULL AS VARCHAR)
       ELSE CAST(CAST(floor(page_id / 3) AS BIGINT) * 20 AS VARCHAR) END AS user_id
FROM pages""",
    "users": """
SELECT CAST(c_custkey AS VARCHAR) AS id,
  CASE WHEN c_custkey % 11 = 0 THEN 'broken-at-example' ELSE concat('u', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
  c_name AS name, CAST(TIMESTAMP '2023-11-01 00:00:00' AS TIMESTAMP) AS created_at
FROM customer""",
    "log_lines": """
SELECT event_id AS line_no,
  CASE WHEN event_id % 97 = 0 THEN 'not json' ELSE concat('{"level":"', CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END,
  '","msg":"', event_type, '","timestamp":"', substr(CAST(ts AS VARCHAR), 1, 10), 'T', substr(CAST(ts AS VARCHAR), 12, 8),
  'Z","service":"svc', CAST(user_id % 3 AS VARCHAR), '","user":', CAST(user_id AS VARCHAR), '}') END AS line
FROM events""",
    "requests": """
SELECT event_id, concat('203.0.113.', CAST(user_id % 256 AS VARCHAR)) AS ip, CAST(ts AS TIMESTAMP) AS requested_at,
  value AS duration_ms, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status
FROM events""",
    "aliases": """
SELECT CASE p_partkey % 8 WHEN 0 THEN 'ab' WHEN 1 THEN concat('link-', CAST(p_partkey AS VARCHAR)) WHEN 2 THEN 'Admin'
  WHEN 3 THEN 'my link' WHEN 4 THEN repeat('x', 51) WHEN 5 THEN concat('casino', CAST(p_partkey AS VARCHAR))
  WHEN 6 THEN concat('c', lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')) ELSE replace(lower(p_name), ' ', '_') END AS alias,
  p_partkey AS request_id
FROM part""",
    "access_log": """
SELECT event_id,
  CASE event_id % 4 WHEN 0 THEN '203.0.113.195, 70.41.3.18' WHEN 1 THEN '  203.0.113.9  , 10.0.0.1' WHEN 2 THEN CASE event_id % 12 WHEN 2 THEN 'garbage' WHEN 6 THEN '12:34, 1.2.3.4' ELSE ':::' END ELSE '' END AS x_forwarded_for,
  CASE WHEN event_id % 3 = 0 THEN '192.168.1.100' WHEN event_id % 7 = 0 THEN '::ffff:10.0.0.1' WHEN event_id % 7 = 1 THEN 'fc00:1' ELSE '' END AS x_real_ip,
  CASE event_id % 3 WHEN 0 THEN '192.168.1.50:12345' WHEN 1 THEN '[::1]:12345' ELSE '192.168.1.51' END AS remote_addr
FROM events""",
}


VIEW_SQL["click_history"] = f"""
SELECT * REPLACE (clicked_at - INTERVAL 1 DAY * (CAST(event_id AS BIGINT) % 300) AS clicked_at,
                  CAST(clicked_at - INTERVAL 1 DAY * (CAST(event_id AS BIGINT) % 300) AS DATE) AS clicked_date)
FROM ({VIEW_SQL["click_events"]}) h"""


def with_views(views: list[str], body: str, ctes: list[tuple[str, str]] = ()) -> str:
    """Prefix ``body`` with the derived-table CTEs it reads plus optional extra CTEs."""
    parts = [f"{name} AS ({VIEW_SQL[name]}\n)" for name in views]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body
