"""Packs of named tables, one directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame

NAME_LENGTH = 31  # fixed value: the longest name of a sheet


def table_name(name: str) -> str:
    return name[:NAME_LENGTH] or "sheet"


def write_tables(
    tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> dict[str, str]:
    """Write every table below ``path`` and return where each one went."""
    names = {key: table_name(key) for key in tables}
    if len(set(names.values())) < len(names):
        raise ValueError("two tables have the same name in their first 31 characters")
    written = {}
    for key, table in tables.items():
        written[key] = f"{path.rstrip('/')}/{names[key]}"
        writer = table.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", "true")
        elif fmt == "parquet":
            writer = writer.option("compression", "zstd")
        writer.save(written[key])
    return written
