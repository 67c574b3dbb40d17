"""User indicators that no window expression can state."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.layout import Layout, own_rows


def custom_indicator(df: DataFrame, lay: Layout, name: str, back: int, compute: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Adds ``name`` (double), computed by ``compute`` on bars in time order.

    The function sees one key, or in the chunked layout one chunk with its
    halo, so a group never exceeds the layout's row bound.  ``back`` says how
    many earlier bars a value depends on; what the halo does not hold is
    refused, as is a value that depends on all of them.
    """
    lay.reach(name, back=back)

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        return pdf.assign(**{name: compute(pdf)})

    schema = df.withColumn(name, F.lit(None).cast("double")).schema
    return own_rows(df.groupBy(*lay.groups).applyInPandas(apply, schema), lay)
