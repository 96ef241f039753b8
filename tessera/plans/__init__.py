"""Registered queries: each pairs a Spark plan with its DuckDB twin."""

from tessera.plans import (q_filters, q_labels, q_models, q_profile, q_rows, q_scoring, q_text,  # noqa: F401
                           q_trends, q_vectors)
from tessera.plans import q_stream  # noqa: F401  (uses twins registered above)
