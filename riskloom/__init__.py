"""riskloom: country-risk analytics and sourcing decisions on Spark.

Operator families (each takes and returns DataFrames):

- ``riskloom.sources``   ingest: link harvest, listings, archives, TSV loads,
  manifests, appends, table refresh, JSON requests, codebook storage
- ``riskloom.operators`` weekly metrics, forecasts, self-organising map,
  country risk, sourcing selection
- ``riskloom.functions`` column-level helpers (dates, codes, budgets, vectors)
- ``riskloom.streaming`` incremental loads and weekly totals on streams
- ``riskloom.plans``     fixtures over the test tables, the end-to-end
  pipeline and the query registry used by ``__spark_entry__``
"""

__version__ = "0.1.0"

import sys as _sys

try:
    # Functions shipped to Python workers (grouped maps, partition maps) are pickled by
    # value, so executors need neither this package installed nor on their path.
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass
