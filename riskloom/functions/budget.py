"""Risk appetite word to total-risk budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): appetite word -> budget, and the default
# for any other word. The lookup is case-sensitive.
RISK_APPETITE = {"Low": 0.75, "Medium": 0.5, "High": 0.25}
DEFAULT_BUDGET = 0.5


def risk_budget(word) -> Column:
    """Budget for an appetite word; unknown, NULL or differently-cased words get 0.5."""
    col = F.col(word) if isinstance(word, str) else word
    lookup = F.create_map(*[x for k, v in RISK_APPETITE.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.coalesce(F.try_element_at(lookup, col), F.lit(DEFAULT_BUDGET)).cast("double")
