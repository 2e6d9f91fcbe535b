"""Composed plans and the query registry.

Importing this package registers every query module.
"""

from kontor.plans import registry  # noqa: F401
from kontor.plans import q_reports  # noqa: F401
from kontor.plans import q_features  # noqa: F401
from kontor.plans import q_anomaly  # noqa: F401
from kontor.plans import q_models  # noqa: F401
from kontor.plans import q_forest  # noqa: F401
from kontor.plans import q_ingest  # noqa: F401
from kontor.plans import q_store  # noqa: F401
from kontor.plans import q_advice  # noqa: F401
from kontor.plans import q_ledger  # noqa: F401
from kontor.plans import q_stream  # noqa: F401
