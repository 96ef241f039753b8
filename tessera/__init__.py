"""tessera: DataFrame operators for article-corpus analytics on Spark.

Operators are plain functions ``DataFrame, params -> DataFrame`` (or
``Column -> Column``).  Column names, keyword lists, models and thresholds
are arguments; nothing is read from globals at run time.
"""

from tessera.session import checkpoint_dir, get_session, stage_table

__all__ = ["checkpoint_dir", "get_session", "stage_table"]
