"""Vector arithmetic as Spark column expressions.

Embeddings are ``array<float>``; every product is taken in double. The dot
product and norms are higher-order ``zip_with``/``aggregate`` expressions:
one pass over the array per term, evaluated JVM-side. (Unrolling the sum over
``getItem`` was measured 5x slower end to end: the optimizer and code
generator pay for every one of the thousands of nodes.)
"""

from __future__ import annotations

from collections.abc import Sequence
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_vector(q: Sequence[float]) -> Column:
    """A constant array<double> (folded into one literal by the optimizer)."""
    return F.array(*[F.lit(float(x)) for x in q])


def dot_literal(vec: Column | str, q: Sequence[float]) -> Column:
    """<vec, q> for a constant query vector q."""
    return dot_cols(vec, literal_vector(q))


def norm_expr(vec: Column | str) -> Column:
    """Euclidean norm of an array column."""
    return F.sqrt(F.aggregate(_col(vec), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot_cols(a: Column | str, b: Column | str) -> Column:
    """<a, b> of two array columns (higher-order functions)."""
    return F.aggregate(
        F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x)


def cosine_literal(vec: Column | str, q: Sequence[float],
                   norm: Column | str | None = None) -> Column:
    """1 - cosine distance against a constant vector.

    A zero-norm row yields NULL instead of NaN, so callers can drop it;
    the reference would sort such a NaN above every real similarity.
    ``norm``: a stored per-row norm column, which saves one pass per row.
    """
    qn = math.sqrt(sum(float(x) * float(x) for x in q))
    vn = _col(norm) if norm is not None else norm_expr(vec)
    if qn == 0.0:
        return F.lit(None).cast("double")
    return F.when(vn > 0, dot_literal(vec, q) / (vn * F.lit(qn)))


def cosine_cols(a: Column | str, b: Column | str) -> Column:
    """1 - cosine distance of two array columns; NULL when a norm is zero."""
    na, nb = norm_expr(a), norm_expr(b)
    return F.when((na > 0) & (nb > 0), dot_cols(a, b) / (na * nb))


def unit_vector(vec: Column | str) -> Column:
    """vec / |vec| as array<double> (NULL for the zero vector)."""
    n = norm_expr(vec)
    return F.when(n > 0, F.transform(_col(vec), lambda x: x.cast("double") / n))
