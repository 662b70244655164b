"""Column expressions (JVM-side, codegen-friendly)."""
from netwarden.functions.scalar import *  # noqa: F401,F403
from netwarden.functions.rules import rule_threat_score, rule_verdict, rule_threat_type  # noqa: F401
