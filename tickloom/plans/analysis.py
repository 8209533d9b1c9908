"""The analysis job: profile, importance, correlation and selection tables in one run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.config import KEYS, TS
from tickloom.operators.quality import profile
from tickloom.operators.select import correlations, f_scores, greedy_uncorrelated, mutual_information, strong_pairs
from tickloom.session import cut_lineage
from tickloom.sources.files import write_result, write_table


def analyse(df: DataFrame, cols: Sequence[str], label: str, threshold: float = 0.7, limit: int | None = None) -> dict[str, DataFrame]:
    """Tables of the analysis by name; ``selected`` lists the chosen columns in order."""
    rows = cut_lineage(df.select(*[k for k in (*KEYS, TS) if k in df.columns], *cols, label))
    corr = cut_lineage(correlations(rows, cols))
    scores = cut_lineage(f_scores(rows, cols, label).unionByName(mutual_information(rows, cols, label)))
    chosen = greedy_uncorrelated(scores.filter("method = 'f_regression'"), corr, limit, threshold)
    selected = df.sparkSession.createDataFrame(list(enumerate(chosen, 1)), "rank int, feature string")
    return {"profile": profile(rows, cols), "importance": scores, "correlation": corr, "strong_pairs": strong_pairs(corr, threshold), "selected": selected}


def run(df: DataFrame, cols: Sequence[str], label: str, path: str, **options) -> dict[str, DataFrame]:
    tables = analyse(df, cols, label, **options)
    for name, table in tables.items():
        write_result(table, f"{path}/{name}", "parquet")
    return tables


def write_selected(df: DataFrame, cols: Sequence[str], path: str, targets: Sequence[str] = ()) -> None:
    """The bar key, the chosen columns and the targets as one table."""
    write_table(df.select(*KEYS, TS, *[F.col(c) for c in (*cols, *targets)]), path)
