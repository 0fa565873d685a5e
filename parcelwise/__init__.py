"""parcelwise — property-compliance analytics as Spark jobs.

Every operator is a DataFrame transformation built from native column
expressions; Catalyst plans the joins and shuffles.  The package layout:

* ``sources``   — table loaders, adapter views over the driver's tables, feed readers
* ``functions`` — fixed rule constants and column-expression builders
* ``operators`` — filters, joins, aggregates, windows, scoring, peers, sinks
* ``streaming`` — Structured Streaming jobs (with batch twins in ``operators``)
* ``plans``     — the query registry used by ``__spark_entry__`` and ``bench.py``
"""

from parcelwise.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
