"""lotwise: lot inventory, FEFO load planning and demand models on Spark.

The package is organised by layer:

* ``lotwise.sources``   - canonical schemas, readers/writers, driver-table derivation
* ``lotwise.functions`` - column-expression builders (status, calendar rules, labels)
* ``lotwise.operators`` - DataFrame -> DataFrame operators (inventory, allocation, models, checks)
* ``lotwise.plans``     - query registry (``queries()``) and the DuckDB oracle SQL
"""

from lotwise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
