"""Whitening of vectors by exact integer covariances from bit slices.

Trace records carry no dense vectors, so this operator is general: it takes any table with an id and a vector column.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

#: Integers are sums of limbs of so many bits; a limb column of a task stays below 2^42, so 2^21 tasks add up in a bigint.
LIMB_BITS, LIMBS = 40, 5
LARGEST = 2.0**61


def usable(vector: Column) -> Column:
    """True for vectors without null and non-finite entries that have an entry at all."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def integer_entries(vector: Column, scale: int, offset: int) -> Column:
    """Scaled and floored entries as integers; beyond the 62-bit range they count as its end."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-LARGEST)), F.lit(LARGEST))).cast("bigint") + offset)


def matrix_of(column: pa.Array, dimensions: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def bit_planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """``[bits, dimensions, words]``: plane b of a dimension holds bit b of its value in every row, 64 rows a word."""
    rows, dimensions = shifted.shape
    words = -(-rows // 64)
    planes = np.zeros((bits, dimensions, words * 8), np.uint8)
    columns = np.ascontiguousarray(shifted.T)
    for b in range(bits):
        packed = np.packbits(((columns >> b) & 1).astype(np.uint8), axis=1)
        planes[b, :, :packed.shape[1]] = packed
    return planes.view(np.uint64)


def plane_products(planes: np.ndarray) -> np.ndarray:
    """``[weights, dimensions, dimensions]``: AND-popcounts of all planes i, j, summed by their weight 2^(i + j)."""
    bits, dimensions, _ = planes.shape
    sums = np.zeros((2 * bits - 1, dimensions, dimensions), np.int64)
    for a in range(bits):
        for d in range(dimensions):
            common = np.bitwise_count(planes[a, d] & planes)  # bits x dimensions x words
            sums[a:a + bits, d] += common.sum(axis=2, dtype=np.int64)
    return sums


def limbs_of(value: int) -> list[int]:
    """Base 2^LIMB_BITS, lowest first; the last limb takes the rest and the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB_BITS) - 1))
        value >>= LIMB_BITS
    return [*out, value]


def scatter(integers: DataFrame, least: list[int], bits: int) -> dict[tuple[int, int], int]:
    """Exact sums of products of all pairs of dimensions (i <= j), of values shifted by ``least``.

    A task keeps one popcount matrix per weight and adds its batches to it; what is exchanged is one row per task and pair.
    """
    dimensions = len(least)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((max(2 * bits - 1, 1), dimensions, dimensions), np.int64)
        for batch in batches:
            if batch.num_rows and bits:
                shifted = matrix_of(batch.column(0), dimensions) - np.array(least, np.int64)
                total += plane_products(bit_planes(shifted, bits))
        rows = [(i, j, *limbs_of(sum(int(c) << w for w, c in enumerate(total[:, i, j]))))
                for i in range(dimensions) for j in range(i, dimensions)]
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                                          *[pa.array(c, pa.int64()) for c in columns[2:]]], names=names)

    names = ["i", "j", *[f"l{k}" for k in range(LIMBS)]]
    schema = "i int, j int, " + ", ".join(f"l{k} bigint" for k in range(LIMBS))
    sums = integers.select("x").mapInArrow(products, schema).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    return {(r["i"], r["j"]): sum(r[f"l{k}"] << (LIMB_BITS * k) for k in range(LIMBS)) for r in sums.toLocalIterator()}


def whitening_basis(n: int, sums: list[int], products: dict[tuple[int, int], int], components: int):
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue, of values whose integer sums and products are given.

    The matrix n * product - sum * sum is exact; each entry is rounded once, by the division by n * n.
    """
    dimensions = len(sums)
    covariance = np.empty((dimensions, dimensions))
    for (i, j), p in products.items():
        covariance[i, j] = covariance[j, i] = (n * p - sums[i] * sums[j]) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    return values[order], vectors[:, order], float(np.trace(covariance))


def whiten(vectors: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding",
           scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """Vectors on their leading principal components, scaled to unit variance.

    Entries become integers x = floor(scale * c) + offset.  Every dimension is shifted to start at zero, its bits are packed
    across rows into words, and AND-popcounts of all pairs of planes, weighted by powers of two, give the sums of products
    exactly; they are centred as integers before the eigendecomposition.

    Returns one row per usable vector and component: ``<id_column>, component`` (from 1), ``n`` (vectors fitted on),
    ``deviation`` (decimal, exact: sum over dimensions of (n * x - S)^2), ``whitened``, ``explained`` (share of the
    variance), ``identity_error`` (largest absolute entry of the whitened covariance minus the identity, measured on the
    result).  There are min(components, dimensions) of them.

    Vectors that are null, empty, or hold null or non-finite entries are left out, as are vectors of another length than
    most have (ties: the longer).  Repeated rows count as often as they occur; a null id is an id; scaled entries beyond 2^61 count as that.  A direction without
    variance has null ``whitened`` and takes no part in ``identity_error``; without any variance ``explained`` is null.
    An empty table gives an empty result.  Other columns are ignored, whatever their names are.  Only sums reach the driver:
    a few numbers per dimension and one per pair of dimensions.
    """
    column = F.col(vector_column)
    chosen = vectors.select(F.col(id_column).alias("id"), column.alias("v")).where(usable(F.col("v")))
    lengths = chosen.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    spark = vectors.sparkSession
    id_type = vectors.schema[id_column].dataType.simpleString()
    schema = f"{id_column} {id_type}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    dimensions, n = lengths["d"], lengths["n"]
    integers = settle(chosen.where(F.size("v") == dimensions).select("id", integer_entries(F.col("v"), scale, offset).alias("x")), "entries")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per task and dimension: least and largest value and the sum in limbs."""
        least = largest = sums = None
        for batch in batches:
            if batch.num_rows:
                x = matrix_of(batch.column(0), dimensions)
                low, high = x.min(axis=0), x.max(axis=0)
                # halves: a batch of 2^31 rows adds up in 64 bits
                total = [(int(a) << 32) + int(b) for a, b in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
                least, largest = (low, high) if least is None else (np.minimum(least, low), np.maximum(largest, high))
                sums = total if sums is None else [a + b for a, b in zip(sums, total)]
        if least is not None:
            yield pa.RecordBatch.from_arrays([
                pa.array(range(dimensions), pa.int32()), pa.array(least, pa.int64()), pa.array(largest, pa.int64()),
                pa.array([s >> 32 for s in sums], pa.int64()), pa.array([s & 0xFFFFFFFF for s in sums], pa.int64()),
            ], names=["i", "least", "largest", "high", "low"])

    found = integers.select("x").mapInArrow(edges, "i int, least bigint, largest bigint, high bigint, low bigint").groupBy("i").agg(
        F.min("least").alias("least"), F.max("largest").alias("largest"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    per_dimension = sorted(found.toLocalIterator(), key=lambda r: r["i"])
    least = [r["least"] for r in per_dimension]
    sums = [(r["high"] << 32) + r["low"] for r in per_dimension]
    bits = max(r["largest"] - r["least"] for r in per_dimension).bit_length()
    shifted = [s - n * low for s, low in zip(sums, least)]
    values, basis, trace = whitening_basis(n, shifted, scatter(integers, least, bits), min(components, dimensions))
    varied = values > max(trace, 0.0) * np.finfo(float).eps * dimensions
    weights = np.where(varied, 1 / np.sqrt(np.where(varied, values, 1.0)), 0.0)
    # n * x - S stays exact in 64 bits below this, its squares added up as well
    reach = max(max(abs(n * r["largest"] - s), abs(n * r["least"] - s)) for r, s in zip(per_dimension, sums))
    narrow = reach * reach * dimensions < 2**63

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(1), dimensions)
            if narrow:
                centred = x * n - np.array(sums, np.int64)
                deviation = pa.array((centred * centred).sum(axis=1)).cast(pa.decimal128(38, 0))
            else:
                centred = x.astype(object) * n - np.array(sums, object)
                whole = [int(v) for v in (centred * centred).sum(axis=1)]
                deviation = pa.array([Decimal(v) if v < 10**38 else None for v in whole], pa.decimal128(38, 0))
            places = (centred / n).astype(float) @ basis * weights
            flat = pa.array(places.reshape(-1))
            offsets = pa.array(np.arange(batch.num_rows + 1) * places.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(offsets, flat)], names=["id", "deviation", "w"])

    places = settle(integers.mapInArrow(projected, f"id {id_type}, deviation decimal(38,0), w array<double>"), "projected")
    live = [k for k in range(len(values)) if varied[k]]
    pairs = [(a, b) for a in live for b in live if a <= b]
    error = None
    if pairs:
        covariances = places.select(*[F.get("w", k).alias(f"w{k}") for k in live]).agg(
            *[F.covar_pop(f"w{a}", f"w{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
        error = max(abs(covariances[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    alive = F.array(*[F.lit(bool(v)) for v in varied])
    rows = places.select("id", "deviation", F.posexplode("w").alias("k", "value"))
    return rows.select(
        F.col("id").alias(id_column), (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation",
        F.when(F.get(alive, F.col("k")), F.col("value")).alias("whitened"), F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
