"""clickspark: link-click analytics as Spark DataFrame / SQL / Structured Streaming jobs.

Layout
------
``sources``    readers for click, URL, user, log and request tables (batch and stream)
``functions``  Column-expression builders (base62, user-agent rules, geo class, client IP, validation)
``operators``  DataFrame-in / DataFrame-out jobs: reports, rollups, joins, listing, search,
               rate limits, ids, data quality, table maintenance, log normalisation
``plans``      named query catalogue used by the driver, bench and tests
``streaming``  Structured Streaming pipelines built from the batch operators
"""

from clickspark.session import build_session, ensure_session_defaults

__all__ = ["build_session", "ensure_session_defaults"]
__version__ = "0.1.0"
