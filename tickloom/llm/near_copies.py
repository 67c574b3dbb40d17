"""One document of each group of near copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.jaccard import similar_components
from tickloom.llm.rows import without_rows


def keep_one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each component of similar documents; columns as they were.

    The row with the smallest id stays, the same one as the component is named
    after.  Documents without words are similar to nothing and stay, as do rows
    with a null id.
    """
    found = similar_components(docs, id_column=id_column, text_column=text_column)
    groups = found.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    named = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("component_id").agg(F.min("row_id").alias("stays"))
    return without_rows(docs, groups.join(named, "component_id").filter(F.col("row_id") != F.col("stays")))
