"""Writers. Spark's commit protocol makes each write whole or absent, so no lock files or renames are needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import try_typed


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_features(df: DataFrame, path: str, schema: list[tuple[str, str]], overwrite: bool = False) -> None:
    """A feature table in a fixed column order and type; an existing one is refused unless asked otherwise."""
    try_typed(df, schema).write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)


def write_cells(df: DataFrame, path: str, keys: list[str], fmt: str = "json") -> None:
    """One folder for each cell, so that reading one cell reads its files only."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).format(fmt).save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_safe(c: Column) -> Column:
    """A number for JSON: NaN and infinities are NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def nested_payloads(rows: DataFrame, keys: list[str], condition: str, summary: list[str], items: list[str]) -> DataFrame:
    """For each key a map from condition to its summary and its list of items."""
    inner = rows.groupBy(*keys, condition).agg(F.first(F.struct(*summary)).alias("summary"), F.array_sort(F.collect_list(F.struct(*items))).alias("items"))
    entry = F.struct(F.col(condition), F.struct("summary", "items"))
    return inner.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("conditions"))


def flat_names(df: DataFrame) -> DataFrame:
    """Struct columns as columns, names joined by two underscores."""
    out: list[Column] = []
    for f in df.schema.fields:
        if hasattr(f.dataType, "fields"):
            out += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}__{g.name}") for g in f.dataType.fields]
        else:
            out.append(F.col(f"`{f.name}`"))
    return df.select(*out)


def prompts_by_index(rows: DataFrame, cell: list[str], prompt: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the index of their prompt instead of the prompt, and each cell's prompts by index."""
    from pyspark.sql import Window

    table = rows.select(*cell, prompt).distinct().withColumn("pi", F.row_number().over(Window.partitionBy(*cell).orderBy(prompt)) - 1)
    right = table.select(*[F.col(c).alias(f"_{c}") for c in [*cell, prompt]], "pi")
    on = F.lit(True)
    for c in [*cell, prompt]:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(right, on).select(*[c for c in rows.columns if c != prompt], "pi"), table
