"""Writers: JSON, NDJSON, CSV, YAML and SQL.

Spark writes all formats in parallel. Only where a JSON or YAML path names one file do rows pass through the driver, one at a
time: that is for small data.
"""

from .documents import write_json, write_json_parts, write_yaml, write_yaml_parts
from .lines import csv_rows, display_rows, ndjson_rows, write_csv, write_ndjson
from .sql import create_table, insert_batches, sql_literal, write_sql

__all__ = ["create_table", "csv_rows", "display_rows", "insert_batches", "ndjson_rows", "sql_literal", "write", "write_csv", "write_json", "write_json_parts", "write_ndjson", "write_sql", "write_yaml", "write_yaml_parts"]

#: Names of the formats, aliases too.
FORMATS = {"json": "json", "ndjson": "ndjson", "jsonl": "ndjson", "csv": "csv", "yaml": "yaml", "yml": "yaml", "sql": "sql"}


def write(data, path: str, fmt: str, *, dialect: str = "postgres", pretty: bool = False) -> None:
    """data (DataFrames by name) in a format: a folder of part files for each entity. A path that ends in .json, .yaml or .yml
    is one local file instead, for small data; only there pretty counts."""
    from ..errors import OutputError

    kind = FORMATS.get(fmt)
    if kind is None:
        raise OutputError(f"unknown format: {fmt}")
    if kind == "json" and path.endswith(".json"):
        write_json(data, path, pretty=pretty)
    elif kind == "yaml" and path.endswith((".yaml", ".yml")):
        write_yaml(data, path)
    else:
        parts = {"ndjson": write_ndjson, "csv": write_csv, "json": write_json_parts, "yaml": write_yaml_parts}
        for name, df in data.items():
            if kind == "sql":
                write_sql(df, name, f"{path}/{name}", dialect=dialect)
            else:
                parts[kind](df, f"{path}/{name}")
