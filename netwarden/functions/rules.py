"""The dashboard's rule-based threat score as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netwarden.functions.scalar import col_or

# Fixed rule points (must equal the dashboard's): condition -> points.
#   serror_rate > 0.5      +40
#   diff_srv_rate > 0.6    +30
#   count > 200            +20
#   same_srv_rate < 0.3    +15
#   num_failed_logins >= 3 +25
#   rerror_rate > 0.5      +20
# Score capped at 100; >= 70 THREAT, >= 35 SUSPICIOUS, else NORMAL.


def rule_threat_score(serror="serror_rate", diff_srv="diff_srv_rate", count="count",
                      same_srv="same_srv_rate", failed="num_failed_logins",
                      rerror="rerror_rate") -> Column:
    def pts(cond, p):
        return F.when(cond, F.lit(p)).otherwise(F.lit(0))
    total = (pts(col_or(serror) > 0.5, 40) + pts(col_or(diff_srv) > 0.6, 30)
             + pts(col_or(count) > 200, 20) + pts(col_or(same_srv) < 0.3, 15)
             + pts(col_or(failed) >= 3, 25) + pts(col_or(rerror) > 0.5, 20))
    return F.least(total, F.lit(100))


def rule_verdict(score) -> Column:
    s = col_or(score)
    return F.when(s >= 70, "THREAT").when(s >= 35, "SUSPICIOUS").otherwise("NORMAL")


def rule_threat_type(score, serror="serror_rate", diff_srv="diff_srv_rate", count="count",
                     failed="num_failed_logins") -> Column:
    s = col_or(score)
    threat = (F.when((col_or(serror) > 0.5) & (col_or(count) > 200), "DoS / DDoS Attack")
              .when(col_or(failed) >= 3, "Brute Force / Credential Attack")
              .when(col_or(diff_srv) > 0.6, "Port Scan / Reconnaissance")
              .otherwise("Suspicious Activity"))
    return (F.when(s >= 70, threat).when(s >= 35, "Anomalous Traffic Pattern")
            .otherwise("Benign Connection"))
