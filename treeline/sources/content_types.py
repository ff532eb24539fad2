"""Content types of channels and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Accepted names per format.
ACCEPTED = {
    "csv": ("csv", "text/csv"),
    "libsvm": ("libsvm", "text/libsvm", "text/x-libsvm"),
    "parquet": ("parquet", "application/x-parquet"),
    "recordio-protobuf": ("recordio-protobuf", "application/x-recordio-protobuf"),
}


def normalized_type(content_type: Column) -> Column:
    """csv, libsvm, parquet or recordio-protobuf; NULL input means libsvm; NULL result means rejected.

    A ``label_size`` parameter of a CSV type must be 1; the last one counts when it is repeated.
    """
    parts = F.split(F.lower(content_type), ";")
    base = F.trim(parts[0])
    sizes = F.filter(
        F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.split(p, "=", 2)),
        lambda kv: (F.size(kv) == 2) & (F.trim(kv[0]) == "label_size"),
    )
    size = F.trim(F.get(F.get(sizes, F.size(sizes) - 1), F.lit(1)))
    bad_size = (F.size(sizes) > 0) & (size != "1")
    out = F.when(content_type.isNull(), F.lit("libsvm"))
    for name, accepted in ACCEPTED.items():
        hit = base.isin(list(accepted))
        out = out.when(hit & ~bad_size if name == "csv" else hit, F.lit(name))
    return out


def content_type_report(df: DataFrame, column: str = "content_type") -> DataFrame:
    """``format, accepted, n`` over a column of content types."""
    kind = normalized_type(F.col(column))
    return df.groupBy(kind.alias("format"), kind.isNotNull().alias("accepted")).agg(F.count(F.lit(1)).alias("n"))
