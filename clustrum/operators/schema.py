"""Column types of a table: continuous, categorical or excluded."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clustrum.functions.profile import distinct_counts, is_numeric

#: Names of identifier columns, and the distinct values up to which a numeric column is categorical.
ID_COLUMNS = ("Id", "id")
DISTINCT_LIMIT = 20


@dataclass(frozen=True)
class ColumnTypes:
    continuous: list[str]
    categorical: list[str]
    excluded: list[str]

    def to_dict(self) -> dict[str, list[str]]:
        return asdict(self)


def infer_column_types(df: DataFrame, id_columns: tuple[str, ...] = ID_COLUMNS, distinct_limit: int = DISTINCT_LIMIT) -> ColumnTypes:
    """Identifiers are excluded; columns that aren't numeric, or have few distinct values, are categorical.

    One pass estimates the distinct values of all numeric columns; only those that may be near the limit are counted
    exactly, so the shuffle carries values of low-cardinality columns only.
    """
    excluded = [c for c in id_columns if c in df.columns]
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in excluded]
    few: set[str] = set()
    if numeric:
        about = df.agg(*(F.approx_count_distinct(F.col(f"`{c}`"), 0.05).alias(c) for c in numeric)).first().asDict()
        unsure = [c for c in numeric if about[c] <= 2 * distinct_limit]
        if unsure:
            few = {r["column"] for r in distinct_counts(df, unsure).where(F.col("n_distinct") <= distinct_limit).collect()}
    rest = [c for c in df.columns if c not in excluded]
    continuous = [c for c in rest if c in numeric and c not in few]
    return ColumnTypes(continuous, [c for c in rest if c not in continuous], excluded)
