"""From loosely typed rows to a prepared table: features as doubles and one target.

All of it is projection and filter, so Catalyst pushes it into the scan and
nothing shuffles.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label of harmless rows, and what marks metadata columns by name.
BENIGN = "Benign"
METADATA_MARKS = ("timestamp", "flow id", "ip", "port", "mac")
KNOWN_METADATA = ("Flow ID", "Src IP", "Dst IP", "Src Port", "Dst Port", "Source IP", "Destination IP", "Source Port", "Destination Port", "Timestamp")
#: Derived columns need these.
REQUIRED = ("Flow IAT Std", "Flow IAT Mean", "Fwd IAT Std", "Fwd IAT Mean", "SYN Flag Cnt", "ACK Flag Cnt")
TARGETS = ("Label", "Target")
DAY = "_capture_day"


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def trim_columns(df: DataFrame) -> DataFrame:
    """Column names without the white space around them."""
    return df.toDF(*[c.strip() for c in df.columns])


def rename_target(df: DataFrame, name: str = "Label") -> DataFrame:
    """`label` in lower case becomes `Label`."""
    return df.withColumnRenamed(name.lower(), name) if name.lower() in df.columns and name not in df.columns else df


def drop_header_rows(df: DataFrame, target: str = "Label") -> DataFrame:
    """Without header lines that files repeat inside; rows with a null label stay.  Labels are trimmed here, once."""
    return df.where(_c(target).isNull() | (F.trim(_c(target)) != target)).withColumn(target, F.trim(_c(target)))


def tag_day(df: DataFrame, pattern: str = r"^([A-Za-z]+-\d{2}-\d{2}-\d{4})") -> DataFrame:
    """The day of the file that each row comes from, or the file's base name where there's none in it."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), "%20", " ")
    day = F.regexp_extract(name, pattern, 1)
    return df.withColumn(DAY, F.when(day != "", day).otherwise(F.regexp_replace(name, r"\.[^.]*$", "")))


def binarise(column: Column | str, benign: str = BENIGN) -> Column:
    """0 for the harmless label, 1 for every other one and null."""
    return F.when((F.col(column) if isinstance(column, str) else column).eqNullSafe(F.lit(benign)), 0).otherwise(1).cast("tinyint")


def class_balance(df: DataFrame, target: str = "Label") -> DataFrame:
    """label, n, percent."""
    counts = df.groupBy(_c(target).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))  # one row of totals


def metadata_columns(columns: list[str], keep: tuple[str, ...] = TARGETS) -> tuple[list[str], list[str]]:
    """Columns whose names hold a mark of metadata, whatever their case, and those of them that aren't known ones."""
    found = [c for c in columns if c not in keep and any(m in c.lower() for m in METADATA_MARKS)]
    known = {c.lower() for c in KNOWN_METADATA}
    return found, [c for c in found if c.strip().lower() not in known]


def drop_metadata(df: DataFrame, keep: tuple[str, ...] = TARGETS) -> DataFrame:
    return df.drop(*metadata_columns(df.columns, keep)[0])


def coerce_numeric(df: DataFrame, keep: tuple[str, ...] = (*TARGETS, DAY)) -> DataFrame:
    """Every other column as a double; what is no number becomes null."""
    return df.select(*[_c(c) if c in keep else _c(c).try_cast("double").alias(c) for c in df.columns])


def require_columns(df: DataFrame, names: tuple[str, ...] = REQUIRED) -> None:
    """Raises KeyError that names the missing columns."""
    if missing := [c for c in names if c not in df.columns]:
        raise KeyError(f"missing columns: {', '.join(missing)}")


def ratio(above: Column, below: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(above, below)


def derive(df: DataFrame) -> DataFrame:
    """Coefficients of variation of the gaps between packets, and SYN per ACK + 1."""
    require_columns(df)
    return df.withColumns(
        {
            "Flow IAT CV": ratio(_c("Flow IAT Std"), _c("Flow IAT Mean")),
            "Fwd IAT CV": ratio(_c("Fwd IAT Std"), _c("Fwd IAT Mean")),
            "SYN_ACK_Ratio": ratio(_c("SYN Flag Cnt"), _c("ACK Flag Cnt") + 1),
        }
    )


def drop_invalid(df: DataFrame) -> DataFrame:
    """Without rows that have a null, NaN or infinity in any column."""
    bad = F.lit(False)
    for name, kind in df.dtypes:
        bad = bad | _c(name).isNull()
        if kind in ("double", "float"):
            bad = bad | F.isnan(_c(name)) | (F.abs(_c(name)) == float("inf"))
    return df.where(~bad)


def process(df: DataFrame) -> DataFrame:
    """Metadata dropped, numbers coerced, ratios derived, invalid rows dropped."""
    return drop_invalid(derive(coerce_numeric(drop_metadata(df))))


def project(df: DataFrame, features: list[str], target: str | None = None) -> DataFrame:
    """The selected features and the target."""
    return df.select(*[_c(c) for c in features], _c(resolve_target(df, target)))


def drop_selected(df: DataFrame, dropped: list[str]) -> DataFrame:
    """Without the features that a selector dropped; absent ones don't matter."""
    return df.drop(*[c for c in dropped if c in df.columns])


def resolve_target(df: DataFrame, wanted: str | None = None) -> str:
    """The wanted target if it's there, else whichever of Label and Target is."""
    for name in (wanted, *TARGETS):
        if name and name in df.columns:
            return name
    raise KeyError("no target column")


def separate(df: DataFrame, target: str | None = None, features: list[str] | None = None) -> DataFrame:
    """features (a vector) and label (a double)."""
    target = resolve_target(df, target)
    features = features or [c for c, k in df.dtypes if c != target and k not in ("string",)]
    safe = df.select(*[_c(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)], _c(target).cast("double").alias("label"))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features").transform(safe).select("features", "label")


def valid_with_side(df: DataFrame, side: list[str]) -> DataFrame:
    """Numbers coerced and invalid rows dropped, by the other columns alone; the side columns go along unchanged."""
    rest = [c for c in df.columns if c not in side]
    coerced = coerce_numeric(df, keep=(*side, *TARGETS))
    bad = F.lit(False)
    for c in rest:
        bad = bad | _c(c).isNull() | (F.coalesce(F.abs(_c(c).cast("double")), F.lit(0.0)) == float("inf")) | F.isnan(_c(c).cast("double"))
    return coerced.where(~F.coalesce(bad, F.lit(True)))
