"""DuckDB text of the adapter views (the oracle side of ``sources.adapters``).

Each oracle query is ``WITH <views> <body>``; DuckDB drops unused CTEs.
"""

EV = """ev AS (
  SELECT event_id AS row_id, ts, user_id, event_type AS attack_type,
         CAST(event_type = 'error' AS INTEGER) AS label, value,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(hour(ts) AS INTEGER) AS hour_of_day,
         CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS protocol_type
  FROM events)"""

EVG = """evg AS (
  SELECT *, CASE WHEN k % 5 = 0 THEN NULL ELSE value END AS value_gap,
         CASE WHEN k % 7 = 0 THEN NULL ELSE k % 7 END AS k7,
         CASE WHEN k % 9 = 0 THEN NULL ELSE attack_type END AS attack_gap
  FROM ev)"""

SC = """sc AS (
  SELECT *, least(value / 82.0::DOUBLE, 1.0::DOUBLE) AS score, label AS y_true,
         CAST(value / 82.0::DOUBLE >= 0.5::DOUBLE AS INTEGER) AS y_pred
  FROM ev)"""

_SEV = """CASE WHEN conf >= 0.98 THEN 'CRITICAL' WHEN conf >= 0.92 THEN 'HIGH'
              WHEN conf >= 0.80 THEN 'MEDIUM' ELSE 'LOW' END"""

_ACTION = """CASE severity
      WHEN 'CRITICAL' THEN 'Block source IP immediately. Escalate to Tier-2 SOC.'
      WHEN 'HIGH' THEN 'Isolate affected host. Capture network packets for forensics.'
      WHEN 'MEDIUM' THEN 'Monitor closely. Apply rate limiting. Alert network team.'
      WHEN 'LOW' THEN 'Log for review. No immediate action required.' END"""

_THREAT = """CASE raw WHEN 'DoS' THEN 'Denial of Service'
      WHEN 'PortScan' THEN 'Port Scan / Reconnaissance'
      WHEN 'BruteForce' THEN 'Brute Force / Credential Attack'
      WHEN 'DataExfil' THEN 'Data Exfiltration'
      WHEN 'Botnet' THEN 'Botnet / C&C Communication'
      WHEN 'Unknown' THEN 'Unknown Threat / Zero-Day' ELSE raw END"""

_PROTO = """CASE CAST(protocol_type AS INTEGER) WHEN 0 THEN 'TCP' WHEN 1 THEN 'UDP'
      WHEN 2 THEN 'ICMP' ELSE 'TCP' END"""

AL = f"""al0 AS (
  SELECT *, {_SEV} AS severity
  FROM (SELECT *, greatest(least(coalesce(score, 0.5), 1.0::DOUBLE), 0.5::DOUBLE) AS conf,
               coalesce(attack_type, 'Unknown') AS raw
        FROM sc WHERE y_pred = 1)),
al AS (
  SELECT CAST(row_id AS BIGINT) AS row_id,
         upper(substr(md5(CAST(row_id AS VARCHAR)), 1, 8)) AS alert_id,
         ts AS "timestamp", CAST(user_id AS VARCHAR) AS source_ip,
         CAST(NULL AS VARCHAR) AS destination_ip, CAST(NULL AS INTEGER) AS port,
         {_PROTO} AS protocol, {_THREAT} AS threat_type, raw AS raw_attack_type,
         round(conf * 100.0::DOUBLE, 2) AS confidence_score, severity,
         {_ACTION} AS action_required, 'OPEN' AS status, '' AS analyst_notes
  FROM al0)"""

LI = """li AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""

ALL = ",\n".join([EV, EVG, SC, AL, LI])


def with_views(body: str) -> str:
    b = body.strip()
    if b[:5].upper() == "WITH ":
        return f"WITH {ALL},\n{b[5:]}"
    return f"WITH {ALL}\n{b}"


THREAT_CASE = _THREAT
PROTO_CASE = _PROTO
SEV_CASE = _SEV
ACTION_CASE = _ACTION
