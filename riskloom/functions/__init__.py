"""Column-level helpers. All of them build JVM-side expressions (no Python UDFs)."""

from riskloom.functions.dates import lookback_start, parse_sqldate, week_of
from riskloom.functions.codes import ROOT_CODES, root_code_in
from riskloom.functions.budget import RISK_APPETITE, risk_budget
from riskloom.functions.vectors import sq_distance, euclid

__all__ = [
    "parse_sqldate", "week_of", "lookback_start", "ROOT_CODES", "root_code_in",
    "RISK_APPETITE", "risk_budget", "sq_distance", "euclid",
]
