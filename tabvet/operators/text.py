"""Records rendered to text and text/record consistency (survey X1, X2)."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.exprs import r6

_PLACEHOLDER = re.compile(r"\{([^{}]+)\}")


def _value(df: DataFrame, name: str, missing: str) -> Column:
    if name not in df.columns:
        return F.lit(missing)
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def render_text(df: DataFrame, template: str = "Record {record_id}: ", fields: Sequence[str] | None = None,
                record_id: str | None = None, missing: str = "unknown") -> DataFrame:
    """Template with {field} / {record_id} placeholders, then 'k=v, k=v' over ``fields``.

    The template is split once on the driver into literal pieces and column
    references; rendering is a single ``concat`` per row.  ``record_id`` names
    the id column (default: a column called record_id, else ``missing``).
    """
    fields = list(fields) if fields is not None else [c for c in df.columns if c != record_id]
    rid = record_id or ("record_id" if "record_id" in df.columns else None)
    pieces: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        name = m.group(1)
        if name == "record_id":
            pieces.append(F.col(rid).cast("string") if rid else F.lit(missing))
        else:
            pieces.append(_value(df, name, missing))
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    details = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), _value(df, k, missing)) for k in fields]) if fields else F.lit("")
    text = F.concat(*pieces, details) if pieces else details
    keep = [rid] if rid else []
    return df.select(*keep, text.alias("text"))


def rules_frame(spark, rules: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """(field, value, expected_text) rows from {field: {value: expected}}."""
    rows = [(f, str(v), e) for f, m in rules.items() for v, e in m.items()]
    return spark.createDataFrame(rows, "field string, value string, expected_text string")


def text_consistency(df: DataFrame, text_col: str, rules: DataFrame, id_col: str) -> DataFrame:
    """X2 per record: matched fields, violations, consistent flag.

    The rules become one row, a map from field and value to the rule, which every record
    looks its own fields up in; records are neither shuffled nor joined back, so repeated
    ids keep their own results. A rule matches when its expected text occurs
    case-insensitively in the record's text. Of repeated rules one counts.
    """
    fields = [r["field"] for r in rules.select("field").distinct().collect() if r["field"] in df.columns]
    rule = "struct<field:string,value:string,expected_text:string>"
    entry = F.struct(F.concat_ws("\u001f", "field", "value").alias("k"), F.struct("field", "value", "expected_text").cast(rule).alias("v"))
    table = rules.dropDuplicates(["field", "value"]).agg(F.map_from_entries(F.collect_list(entry)).alias("_rules"))
    base = df.select(F.col(id_col).alias("_id"), F.lower(F.col(text_col)).alias("_text"), *fields).crossJoin(F.broadcast(table))
    own = [F.try_element_at("_rules", F.concat(F.lit(f"{f}\u001f"), F.col(f).cast("string"))) for f in fields]
    base = base.withColumn("_own", F.array_compact(F.array(*own)) if own else F.array().cast(f"array<{rule}>"))
    stands = lambda r: F.col("_text").contains(F.lower(r["expected_text"]))
    out = base.select("_id", F.sort_array(F.transform(F.filter("_own", stands), lambda r: r["field"])).alias("matched_fields"),
                      F.sort_array(F.filter("_own", lambda r: ~stands(r))).alias("violations"))
    empty_m = F.array().cast("array<string>")
    empty_v = F.array().cast("array<struct<field:string,value:string,expected_text:string>>")
    return out.select(F.col("_id").alias(id_col), F.coalesce("matched_fields", empty_m).alias("matched_fields"),
                      F.coalesce("violations", empty_v).alias("violations")).withColumn(
        "consistent", F.size("violations") == 0)


def consistency_summary(per_record: DataFrame) -> DataFrame:
    """X2 overall: count, consistent_count, consistency_rate (1.0 when empty)."""
    return per_record.agg(F.count(F.lit(1)).cast("bigint").alias("count"),
                          F.count_if("consistent").cast("bigint").alias("consistent_count")).select(
        "count", "consistent_count",
        r6(F.when(F.col("count") > 0, F.col("consistent_count") / F.col("count")).otherwise(F.lit(1.0))).alias("consistency_rate"))
