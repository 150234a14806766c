"""wellspring: Spark-native corpus, topic and check-in analytics.

Every operator is a ``DataFrame -> DataFrame`` transformation (use it with
``df.transform(...)``), built on Spark SQL expressions, MLlib and Structured
Streaming. Sub-packages:

* ``sources``   - readers, the fixed dimension tables, derived test views, sinks
* ``functions`` - column-expression helpers (text, ids, time, vectors)
* ``operators`` - relational operators (filters, dedup, sampling, scoring, ...)
* ``plans``     - end-to-end jobs composed from operators
* ``streaming`` - Structured Streaming versions of the check-in jobs
"""

__version__ = "0.1.0"
