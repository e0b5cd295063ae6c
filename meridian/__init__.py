"""meridian: sales analytics over a region / rep / account / order / web-event star, on Spark.

Every analysis is a lazy ``Star -> DataFrame`` function (see :mod:`meridian.operators`);
nothing is collected inside the library.
"""

from meridian.sources.star import Star
from meridian.plans.scope import scope_region

__all__ = ["Star", "scope_region"]
