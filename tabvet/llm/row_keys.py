"""A key for every row of a table of documents, where doc_ids may be null or repeated.

Operators that link documents answer by doc_id. Run on ``row_key`` instead, their answers
name rows, so that a row is not judged by another one of the same id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import in_shared_folder


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


class RowKeys:
    """``rows``: ``docs`` with the columns named ``key`` (bigint) and ``hashed`` (boolean) added.

    The key is the doc_id where one row alone has it, so it costs a count of ids and no hash
    of texts. Rows whose id is null or stands in several rows have a 64-bit hash of the
    whole row (columns of maps apart): equal rows share a key, others do not.
    """

    def __init__(self, docs: DataFrame):
        self.columns = docs.columns
        self.key, self.hashed, again = (free_name(docs, n) for n in ("row_key", "row_hashed", "row_shared_id"))
        shared = in_shared_folder(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(again)).agg(F.count("*").alias("n"))
                                  .where("n > 1").select(again), "shared-ids")
        plain = [c for c, t in docs.dtypes if "map<" not in t]
        whole = F.xxhash64(*plain, *[F.col(c).isNull() for c in plain])
        hashed = F.col("doc_id").isNull() | F.col(again).isNotNull()
        self.rows = (docs.join(shared, F.col("doc_id") == F.col(again), "left")
                     .withColumn(self.hashed, hashed)
                     .withColumn(self.key, F.when(F.col(self.hashed), whole).otherwise(F.col("doc_id").cast("bigint")))
                     .drop(again))

    def texts(self) -> DataFrame:
        """doc_id (the row's key) and text, for an operator that answers by doc_id."""
        return self.rows.select(F.col(self.key).alias("doc_id"), "text")

    def without(self, gone: DataFrame) -> DataFrame:
        """The rows whose key is not in ``gone`` (one column doc_id, as an operator names it), with the columns of the table."""
        return self.rows.join(gone.select(F.col("doc_id").alias(self.key)), self.key, "left_anti").select(*self.columns)

    def one_each_without(self, gone: DataFrame) -> DataFrame:
        """As ``without``, and of equal rows one. Only rows that have no id of their own can be equal, and only they are shuffled."""
        left = self.rows.join(gone.select(F.col("doc_id").alias(self.key)), self.key, "left_anti")
        single, several = left.where(~F.col(self.hashed)), left.where(self.hashed).dropDuplicates([self.key])
        return single.unionByName(several).select(*self.columns)
