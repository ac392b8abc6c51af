"""tensio — Spark-native analytics for short social-media posts about stress.

Every operator is a ``DataFrame -> DataFrame`` function (or a ``Column`` expression)
built from Spark SQL expressions, aggregates, windows and size-checked broadcast
joins.  Sub-packages:

* ``functions``  – column expressions and the fixed dictionaries
* ``operators``  – DataFrame transforms (cleaning, corpus, sampling, encoding, …)
* ``sources``    – CSV readers, source adapters and sinks
* ``plans``      – composite flows, the file-to-file study (``plans.study``) and the query
  catalogue used by the driver
* ``streaming``  – the stateless cleaning/scoring flow over a file stream

``python -m tensio {clean,sentiment,combine,topics}`` runs the study from the shell.
"""

__version__ = "0.1.0"
