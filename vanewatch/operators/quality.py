"""Profiles of raw files: counts, missing values, value domains and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vanewatch.domain import EXPECTED_TYPES, SPARSE_PCT, VALID_STATUS
from vanewatch.functions.labels import status_label

FILE = "_source_file"


def rows_per_file(raw: DataFrame) -> DataFrame:
    return raw.groupBy("farm", FILE).agg(F.count(F.lit(1)).alias("n_rows"))


def file_summary(raw: DataFrame) -> DataFrame:
    return (
        rows_per_file(raw)
        .groupBy("farm")
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.sum("n_rows").alias("n_rows_total"),
            F.round(F.sum("n_rows") / F.count(F.lit(1)), 1).alias("avg_rows_per_file"),
        )
    )


def missingness(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Null count and percentage of each column per farm, from a single aggregate pass."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    wide = raw.groupBy("farm").agg(F.count(F.lit(1)).alias("n_rows"), *nulls)
    return wide.unpivot(["farm", "n_rows"], columns, "column_name", "n_missing").withColumn(
        "pct_missing", F.round(F.col("n_missing") / F.col("n_rows") * 100, 4)
    )


def missing_bucket(n_missing: str, n_rows: str) -> Column:
    share = F.col(n_missing) / F.col(n_rows) * 100
    return (
        F.when(F.col(n_missing) == 0, "always")
        .when(share <= SPARSE_PCT, "mostly")
        .otherwise("sparse")
    )


def missing_buckets(profile: DataFrame) -> DataFrame:
    """How many columns of a farm are always, mostly or sparsely populated."""
    return (
        profile.withColumn("bucket", missing_bucket("n_missing", "n_rows"))
        .groupBy("farm", "bucket")
        .agg(F.count(F.lit(1)).alias("n_columns"))
    )


def sparsest(profile: DataFrame, n: int | None = None) -> DataFrame:
    """The sparse columns, sparsest first; a report shows the first ``n``."""
    sparse = profile.where(missing_bucket("n_missing", "n_rows") == "sparse")
    ordered = sparse.orderBy(F.col("pct_missing").desc(), "farm", "column_name")
    return ordered if n is None else ordered.limit(n)


def with_share(counts: DataFrame, total_of: str = "farm", digits: int = 3) -> DataFrame:
    """Percentage of each count inside its farm; runs on counts, not on rows."""
    whole = F.sum("n_rows").over(Window.partitionBy(total_of))
    return counts.withColumn("pct", F.round(F.col("n_rows") / whole * 100, digits))


def status_distribution(raw: DataFrame) -> DataFrame:
    """Rows and percentage per status; rows without a status count in the total."""
    counts = raw.groupBy("farm", "status_type_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return (
        with_share(counts)
        .where(F.col("status_type_id").isNotNull())
        .withColumn("label", status_label("status_type_id"))
    )


def split_distribution(raw: DataFrame) -> DataFrame:
    counts = raw.groupBy("farm", "train_test").agg(F.count(F.lit(1)).alias("n_rows"))
    return with_share(counts).where(F.col("train_test").isNotNull())


def illegal_status(raw: DataFrame) -> DataFrame:
    """Each status value outside the domain with its number of rows per file, a row for each."""
    bad = ~F.coalesce(F.col("status_type_id").isin(VALID_STATUS), F.lit(False))
    return raw.where(bad).groupBy("farm", FILE, "status_type_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


#: One bit for each kind of cell a column can hold.
MISSING, INT, FLOAT, DATETIME, TEXT = 1, 2, 4, 8, 16

#: What a number can begin with. A run of digits before a date's or a clock's separator is none;
#: leaving those to the cast would cost an exception for every cell.
NUMBER_START = r"^[\x00-\x20]*[-+]?(?:[0-9.]+(?![-:/0-9.])|(?i:nan|inf))"


def _kind(column: str) -> Column:
    """The bit of a cell; each is classified once."""
    text = F.col(column).cast("string")
    number = F.when(text.rlike(NUMBER_START), text.try_cast("double")).isNotNull()
    return (
        F.when(text.isNull(), MISSING)
        .when(number, F.when(text.try_cast("bigint").isNotNull(), INT).otherwise(FLOAT))
        .when(text.try_cast("timestamp").isNotNull(), DATETIME)
        .otherwise(TEXT)
    )


def observed_types(raw: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Narrowest type all values of a column fit: int, float, datetime or str.

    A column with missing numbers is a float, as dataframe readers without a nullable
    integer type report it. So is one without a value. The kinds a column holds are one
    aggregate each, so hundreds of columns take one pass.
    """
    wide = raw.groupBy(*by).agg(*[F.bit_or(_kind(c)).alias(c) for c in columns])

    def verdict(c: str) -> Column:
        kinds = F.col(c)
        return (
            F.when(kinds == INT, "int")
            .when(kinds.bitwiseAND(DATETIME | TEXT) == 0, "float")
            .when(kinds.bitwiseAND(INT | FLOAT | TEXT) == 0, "datetime")
            .otherwise("str")
        )

    return wide.select(*by, *[verdict(c).alias(c) for c in columns]).unpivot(
        by, columns, "column_name", "actual"
    )


def type_check(raw: DataFrame) -> DataFrame:
    """Expected against observed type of the meta columns, one row per farm and column."""
    expected = [x for item in EXPECTED_TYPES.items() for x in item]
    lookup = F.create_map(*[F.lit(x) for x in expected])
    return (
        observed_types(raw, list(EXPECTED_TYPES), ["farm"])
        .withColumn("expected", F.element_at(lookup, F.col("column_name")))
        .withColumn("ok", F.col("expected") == F.col("actual"))
    )


def type_drift(raw: DataFrame, columns: list[str], n: int | None = None) -> DataFrame:
    """Columns whose type in a file differs from the farm's first file; a report shows ``n``."""
    per_file = observed_types(raw, columns, ["farm", FILE])
    number = F.regexp_extract(FILE, r"(\d+)", 1).try_cast("bigint")
    first = per_file.groupBy("farm", "column_name").agg(
        F.min_by("actual", F.struct(number, F.col(FILE))).alias("first_type")
    )
    drift = per_file.join(first, ["farm", "column_name"]).where("actual <> first_type")
    ordered = drift.orderBy("farm", number, FILE, "column_name")
    return ordered if n is None else ordered.limit(n)


def header_consistency(headers: DataFrame) -> DataFrame:
    """Does each file list the same columns, in order, as its farm's first file."""
    number = F.regexp_extract(FILE, r"(\d+)", 1).try_cast("bigint")
    first = headers.groupBy("farm").agg(
        F.min_by("columns", F.struct(number, F.col(FILE))).alias("_first")
    )
    return (
        headers.join(F.broadcast(first), "farm")
        .withColumn("consistent", F.col("columns") == F.col("_first"))
        .drop("_first")
    )
