"""Imputation, encoding, hold-out split and scaling for the models."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from voltrail.functions.quantiles import exact_quantiles
from voltrail.operators.profile import describe_categorical
from voltrail.schema import CATEGORICAL_FEATURES, MINUTES, NUMERIC_FEATURES, ROW_ID

# Slots of a text column that the caller wants hashed and not one-hot encoded.
HASH_SLOTS = 20_000


def is_test_row(row_id: str = ROW_ID, share: float = 0.2, seed: int = 42) -> Column:
    """Seeded, uniform and tied to the row, so a re-run or another partitioning gives the same split."""
    digest = F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(row_id).cast("string"))), 1, 8)
    return digest < F.lit(f"{int(share * 2**32):08x}")


def split_train_test(df: DataFrame, share: float = 0.2, seed: int = 42, row_id: str = ROW_ID) -> DataFrame:
    return df.withColumn("is_test", is_test_row(row_id, share, seed))


@dataclass(frozen=True)
class Fills:
    numeric: dict[str, float]
    text: dict[str, str]


def fill_table(
    train: DataFrame, numeric: Sequence[str] = NUMERIC_FEATURES, text: Sequence[str] = CATEGORICAL_FEATURES
) -> DataFrame:
    """Median of every numeric and most common value of every text feature (one row per feature)."""
    medians = exact_quantiles(train, numeric, [0.5]).select(
        "column", F.col("value").alias("median"), F.lit(None).cast("string").alias("most_common")
    )
    common = describe_categorical(train, text).select(
        "column", F.lit(None).cast("double").alias("median"), F.col("top").alias("most_common")
    )
    return medians.unionByName(common)


def learn_fills(train: DataFrame) -> Fills:
    """Fill values; a feature without any value in the train part is left out, with a warning, as there is nothing to learn."""
    # One row per feature, a few dozen in all.
    rows = {r["column"]: r for r in fill_table(train).collect()}
    numeric = {c: rows[c]["median"] for c in NUMERIC_FEATURES if c in rows and rows[c]["median"] is not None}
    text = {c: rows[c]["most_common"] for c in CATEGORICAL_FEATURES if c in rows and rows[c]["most_common"] is not None}
    empty = [c for c in NUMERIC_FEATURES + CATEGORICAL_FEATURES if c not in numeric and c not in text]
    if empty:
        warnings.warn(f"features without values are left out: {empty}", stacklevel=2)
    return Fills(numeric, text)


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _imputer(fills: Fills) -> SQLTransformer:
    """A persistable step; filled columns get the suffix ``_f``."""
    parts = [f"coalesce(cast({c} as double), {v!r}D) as {c}_f" for c, v in fills.numeric.items()]
    parts += [f"coalesce({c}, {_sql_text(v)}) as {c}_f" for c, v in fills.text.items()]
    return SQLTransformer(statement=f"select *, {', '.join(parts)} from __THIS__")


def build_preprocessor(train: DataFrame, hash_columns: Sequence[str] = (), hash_slots: int = HASH_SLOTS) -> Pipeline:
    """Impute, one-hot encode (an unseen value becomes all zeros) and assemble a sparse vector.

    One-hot encoding brings all values of a text column to the driver. Name the columns for which these are too many, as
    the station id of a large network, in ``hash_columns``: each is hashed into ``hash_slots`` slots of its own.
    """
    fills = learn_fills(train)
    hashed = [c for c in fills.text if c in hash_columns]
    one_hot = [c for c in fills.text if c not in hash_columns]
    stages = [_imputer(fills)]
    if one_hot:
        stages += [
            StringIndexer(
                inputCols=[f"{c}_f" for c in one_hot], outputCols=[f"{c}_i" for c in one_hot],
                handleInvalid="keep", stringOrderType="alphabetAsc",
            ),
            # "keep" adds a last slot for unseen values, which dropLast removes again.
            OneHotEncoder(inputCols=[f"{c}_i" for c in one_hot], outputCols=[f"{c}_o" for c in one_hot], dropLast=True),
        ]
    stages += [FeatureHasher(inputCols=[f"{c}_f"], outputCol=f"{c}_h", numFeatures=hash_slots) for c in hashed]
    vectors = [f"{c}_f" for c in fills.numeric] + [f"{c}_o" for c in one_hot] + [f"{c}_h" for c in hashed]
    stages.append(VectorAssembler(inputCols=vectors, outputCol="features"))
    return Pipeline(stages=stages)


def feature_names(prepared: DataFrame) -> list[str]:
    """Source feature of every vector slot, from the column metadata."""
    attrs = prepared.schema["features"].metadata["ml_attr"]["attrs"]
    slots = sorted((a["idx"], a["name"]) for kind in attrs.values() for a in kind)
    known = NUMERIC_FEATURES + CATEGORICAL_FEATURES
    owner = []
    for _, name in slots:
        owner.append(next(c for c in known if name == f"{c}_f" or name.startswith((f"{c}_o_", f"{c}_h_"))))
    return owner


def prepared_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, "features", F.col(MINUTES).cast("double").alias("label"))
