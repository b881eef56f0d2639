"""Event root-code predicate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference): the event root codes that count as unrest.
ROOT_CODES = ("6", "7", "13", "14", "15", "16", "17", "18", "19", "20")


def root_code_in(c, codes=ROOT_CODES, strict: bool = False) -> Column:
    """Keep events whose root code is one of ``codes``.

    Default compares numerically, so a padded ``'06'`` matches ``'6'``.
    ``strict=True`` compares the text as is (the literal behaviour).
    """
    col = F.col(c) if isinstance(c, str) else c
    if strict:
        return col.isin(*[str(x) for x in codes])
    return col.try_cast("int").isin(*[int(x) for x in codes])
