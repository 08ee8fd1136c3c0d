"""Vector expressions: the hash embedding, cosine, means."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 64


def hash_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """byte(sha256(text), i mod 32) / 128 - 1, scaled to length 1, as doubles."""

    def read(digest: Column) -> Column:
        digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(digest, at, 1)) - 1
        return F.array(*((digit(2 * i + 1) * 16 + digit(2 * i + 2)).cast("double") / 128 - 1 for i in range(min(32, dimensions))))

    # Arrays of one element name what would else be written out, and computed, again for each use.
    values = F.transform(F.array(F.sha2(text, 256)), read)[0]
    whole, rest = divmod(dimensions, 32)
    if whole:
        values = F.concat(*[values] * whole, *([F.slice(values, 1, rest)] if rest else [])) if whole > 1 or rest else values
    with_norm = F.transform(F.array(values), lambda v: F.struct(v.alias("v"), norm(v).alias("n")))
    return F.transform(with_norm, lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def embed_text(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """hash_embedding of one text on the driver."""
    digest = hashlib.sha256(text.encode()).digest()
    values = [digest[i % 32] / 128 - 1 for i in range(dimensions)]
    length = math.sqrt(sum(v * v for v in values))
    return [v / length for v in values]


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def similarity(a: Column, b: Column) -> Column:
    """Cosine, in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def similarity_to(column: str, vector: Sequence[float]) -> Column:
    """Cosine of a column's vectors with a fixed vector; for another length than that of the column's, null.

    One text of SQL, as many calls into the JVM as the vector is long would take longer than most searches; and a loop
    over the components, as written out for each they make a method that is too large to be compiled to machine code.
    """
    length = math.sqrt(sum(float(v) ** 2 for v in vector))
    a = "`" + column.replace("`", "``") + "`"
    number = lambda v: f"CAST('{float(v)!r}' AS DOUBLE)"
    fixed = f"array({', '.join(map(number, vector))})" if len(vector) else "CAST(array() AS ARRAY<DOUBLE>)"
    product = f"aggregate(zip_with({a}, {fixed}, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
    square = f"aggregate({a}, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE))"
    return F.expr(f"CASE WHEN size({a}) = {len(vector)} THEN try_divide({product}, sqrt({square}) * {number(length)}) END")


def mean_vector(vector: Column) -> Column:
    """An aggregate: the component-wise mean of vectors of one length, with a map-side part."""
    return vector_to_array(Summarizer.mean(array_to_vector(vector.cast("array<double>"))))


def mean_vectors(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, vector): the component-wise mean of each key's vectors, not scaled again.

    Components are averaged with a map-side part, so a key of any size is never gathered.
    """
    parts = rows.select(key, F.posexplode(vector).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(key, F.transform("v", lambda p: p["x"]).alias(vector))
