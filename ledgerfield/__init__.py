"""Portfolio analytics for pay-as-you-go equipment finance, as Spark DataFrame functions.

``functions``  Column -> Column helpers (dates, buckets, scores, keys).
``operators``  DataFrame -> DataFrame building blocks (joins, aggregates, ranks, quality checks).
``sources``    readers, sinks, catalog and audit helpers.
``plans``      the star schema, marts, customer features, models and named queries.
``streaming``  windowed monitoring that runs on batch and on streaming frames.
"""

__version__ = "0.1.0"
