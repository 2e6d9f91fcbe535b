"""kontor: ledger analytics as Spark jobs.

Every operator is a function from DataFrame(s) to a DataFrame, keyed by
account, built on Spark SQL expressions, windows, joins and aggregates.
Only the Isolation Forest (fit and score) drops to Arrow-batched pandas code,
because MLlib has no such estimator.
"""

__all__ = ["session"]
