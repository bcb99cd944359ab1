"""Vectors as DataFrame[id bigint, features array<double>], from the forms that data come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dense(df: DataFrame, id_col: str = "id", features_col: str = "features") -> DataFrame:
    """Vectors of a dense array column; TypeError unless its elements are numbers."""
    kind = df.schema[features_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{features_col} is {kind.simpleString()}, not an array of numbers")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(features_col).cast("array<double>").alias("features"))


def numeric_columns(df: DataFrame, id_col: str) -> DataFrame:
    """Vectors of all numeric columns of a mixed table but the id, in their order; TypeError where there is none."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != id_col]
    if not names:
        raise TypeError("no numeric columns")
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.array(*(F.col(c).cast("double") for c in names)).alias("features"))


def from_triplets(coo: DataFrame, size: int, id_col: str = "id", feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Dense vectors of `size` from (id, feature, value) triplets; repeated cells add up, absent ones are 0."""
    cells = coo.groupBy(F.col(id_col).cast("bigint").alias("id"), F.col(feature_col).cast("int").alias("f")).agg(F.sum(F.col(value_col).cast("double")).alias("v"))
    rows = cells.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("f", "v"))).alias("m"))
    return rows.select("id", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0.0))).alias("features"))


def from_sparse(rows: DataFrame, size: int, id_col: str = "id", index_col: str = "indices", value_col: str = "values") -> DataFrame:
    """Dense vectors of `size` from sparse ones, one a row as arrays of indices (from 0) and values; an index that repeats counts with its first value, others are 0."""
    cell = lambda k: F.coalesce(F.get(F.col(value_col), F.array_position(F.col(index_col), k.cast("int")).cast("int") - 1).cast("double"), F.lit(0.0))
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), cell).alias("features"))


def from_compressed(spark: SparkSession, i: list[int], p: list[int], x: list[float], size: int) -> DataFrame:
    """Vectors of a compressed sparse column matrix, whose columns are the examples: row indices, pointers and values."""
    columns = [(k, list(map(int, i[a:b])), list(map(float, x[a:b]))) for k, (a, b) in enumerate(zip(p[:-1], p[1:]))]
    return from_sparse(spark.createDataFrame(columns, "id bigint, indices array<int>, values array<double>"), size)


def without_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per distinct vector, that of the smallest id."""
    return vectors.groupBy("features").agg(F.min("id").alias("id")).select("id", "features")


def scaled(vectors: DataFrame) -> DataFrame:
    """Each feature less its mean, by its sample standard deviation; constant features become 0."""
    size = vectors.agg(F.max(F.size("features"))).first()[0] or 0
    if not size:
        return vectors
    cells = [F.col("features")[k] for k in range(size)]
    means, deviations = vectors.agg(F.array(*map(F.avg, cells)), F.array(*map(F.stddev_samp, cells))).first()
    z = [F.coalesce(F.try_divide(c - F.lit(m), F.lit(s)), F.lit(0.0)) for c, m, s in zip(cells, means, deviations)]
    return vectors.select("id", F.array(*z).alias("features"))


def read_edge_list(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """(src, dst, weight) of a text file of pairs, with an optional third column, made symmetric: both directions, summed."""
    raw = spark.read.csv(path, sep=sep, comment="#", schema="src bigint, dst bigint, weight double")
    return symmetric(raw.withColumn("weight", F.coalesce("weight", F.lit(1.0))))


def symmetric(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """g + g transposed."""
    flipped = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)
    return edges.select("src", "dst", weight).unionByName(flipped).groupBy("src", "dst").agg(F.sum(weight).alias(weight))


def with_labels(coords: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Coordinates with what is known of their points; unlabelled points stay."""
    return coords.join(labels, key, "left")


def random_of(key: Column, seed: int) -> Column:
    """A number from [0, 1) that depends on key and seed only, not on partitions."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
