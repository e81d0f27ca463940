"""Vector scalar functions (SC1) as Spark SQL expressions.

Spark 4.1 has no built-in vector function, so the dot product is a fold over
``zip_with``. Arithmetic is in double so results agree with other engines to
well below the rounding used in reports. Zero-norm or wrong-length vectors give
a null distance (``try_divide``) and drop out of rankings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    a, b = _c(a), _c(b)
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    a = _c(a)
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a, b, a_norm=None, b_norm=None) -> Column:
    """1 - cos(a, b); null when lengths differ or either vector is zero.

    Pass precomputed norms (e.g. a stored ``norm`` column) to avoid recomputing
    them per pair.
    """
    a, b = _c(a), _c(b)
    na = l2_norm(a) if a_norm is None else _c(a_norm)
    nb = l2_norm(b) if b_norm is None else _c(b_norm)
    same_len = F.size(a) == F.size(b)
    cos = F.try_divide(dot(a, b), na * nb)
    return F.when(same_len & (na > 0) & (nb > 0), F.lit(1.0) - cos)
