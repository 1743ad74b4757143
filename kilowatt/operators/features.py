"""Feature operators (FEA1-FEA5): assemble, index categories, tokenize, hash.

These are ``pyspark.ml`` transformers; they run as JVM expressions per
row (no Python), and the only fitted one, the category indexer, gathers
at most ``max_categories + 1`` distinct values per slot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, Tokenizer, VectorAssembler, VectorIndexer, VectorIndexerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilowatt.functions.vectors import to_array

def assembler(cols: Sequence[str], out: str = "features", invalid: str = "error") -> VectorAssembler:
    """``invalid``: ``error`` (reference behaviour on a null), ``skip`` or ``keep`` (NaN)."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid=invalid)


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features", invalid: str = "error") -> DataFrame:
    return assembler(cols, out, invalid).transform(df)


def category_indexer(
    in_col: str = "features", out: str = "indexedFeatures", max_categories: int = 4, invalid: str = "error"
) -> VectorIndexer:
    """A slot with at most ``max_categories`` distinct values becomes
    categorical; codes follow ascending value, but 0.0 always takes code 0.
    ``invalid="keep"`` maps unseen values to an extra code."""
    return VectorIndexer(inputCol=in_col, outputCol=out, maxCategories=max_categories, handleInvalid=invalid)


def index_categories(
    df: DataFrame, in_col: str = "features", out: str = "indexedFeatures", max_categories: int = 4
) -> VectorIndexerModel:
    """Fit the indexer (one aggregate pass) and return the model."""
    return category_indexer(in_col, out, max_categories).fit(df)


def category_maps(model: VectorIndexerModel) -> DataFrame:
    """The fitted value -> code map as rows (slot, value, code)."""
    spark = SparkSession.getActiveSession()
    rows = [
        (int(slot), float(v), int(code))
        for slot, m in model.categoryMaps.items()
        for v, code in m.items()
    ]
    return spark.createDataFrame(rows, "slot int, value double, code int")


def tokenize(df: DataFrame, in_col: str = "text", out: str = "words") -> DataFrame:
    """Lower-case and split on each single whitespace character."""
    return Tokenizer(inputCol=in_col, outputCol=out).transform(df)


def hash_tf(df: DataFrame, in_col: str = "words", out: str = "tf", num_features: int = 1 << 18) -> DataFrame:
    """Term counts hashed (murmur3) into ``num_features`` slots."""
    return HashingTF(inputCol=in_col, outputCol=out, numFeatures=num_features).transform(df)


def explode_vector(df: DataFrame, vec: str, keys: Sequence[str], slot: str = "slot", value: str = "value") -> DataFrame:
    """(keys..., vector) -> one row per (keys..., slot, value); dense order."""
    return df.select(*keys, F.posexplode(to_array(vec)).alias(slot, value))
