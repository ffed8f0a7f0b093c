"""provend: procurement and inventory analytics as Spark DataFrame jobs.

Every operator is a function ``DataFrame -> DataFrame`` whose work runs on
Spark: cleaning, order/receipt linking, demand aggregation, ABC ranking,
forecasting, supplier risk tiers, outlier scoring and name similarity.
"""

from provend.config import Config

__all__ = ["Config"]
__version__ = "0.3"
