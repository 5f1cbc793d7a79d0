"""Data assertions: disjoint flags, exact sizes, equal category sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flag_report(df: DataFrame, train: str, test: str, category: str, wanted: int) -> DataFrame:
    """One row: sizes of both sides, rows in both or neither, whether the train side has its size and both sides the same categories."""
    sets = [F.sort_array(F.collect_set(F.when(F.col(c), F.col(category)))) for c in (train, test)]
    return df.agg(
        F.count_if(F.col(train)).alias("n_train"),
        F.count_if(F.col(test)).alias("n_test"),
        F.count_if(F.col(train) & F.col(test)).alias("n_both"),
        F.count_if(~F.col(train) & ~F.col(test)).alias("n_neither"),
        (F.count_if(F.col(train)) == wanted).alias("exact_size"),
        (sets[0] == sets[1]).alias("same_categories"),
    )


def require(report: DataFrame, *names: str) -> None:
    row = report.first()
    if broken := [n for n in names if not row[n]]:
        raise AssertionError(f"not fulfilled: {', '.join(broken)}")


def disjoint(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, disjoint: whether no row of ``a`` is in ``b``."""
    return a.join(b, a.columns, "left_semi").limit(1).agg((F.count(F.lit(1)) == 0).alias("disjoint"))
