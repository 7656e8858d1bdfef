"""JSON and YAML: folders of part files written by the executors, or one file, row by row."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
import yaml
from pyspark.sql import DataFrame

from .lines import ndjson_rows


def write_json_parts(df: DataFrame, path: str) -> None:
    """A folder whose part files hold an array of rows each, in the order of df; Spark reads it with multiLine. Of a df without
    partitions (Spark knows that it has no rows) the one part file is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = True
        for frame in frames:
            lines = "," + frame["line"]
            if first and len(lines):
                lines.iloc[0] = "[" + lines.iloc[0][1:]
                first = False
            yield lines.to_frame("value")
        yield pd.DataFrame({"value": ["[]" if first else "]"]})

    ndjson_rows(df).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_yaml_parts(df: DataFrame, path: str) -> None:
    """A folder whose part files, each and put together, are a sequence of rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            shown = [yaml.safe_dump([json.loads(line)], sort_keys=False, allow_unicode=True).rstrip("\n") for line in frame["line"]]
            yield pd.DataFrame({"value": shown})

    ndjson_rows(df).mapInPandas(run, "value string").write.mode("overwrite").text(path)


def write_json(data: Mapping[str, DataFrame], path: str, *, pretty: bool = False) -> None:
    """{entity: [rows]} in one local file; rows come through the driver, one partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for i, (name, df) in enumerate(data.items()):
            out.write(("," if i else "") + ("\n  " if pretty else "") + json.dumps(name) + (": [" if pretty else ":["))
            for k, row in enumerate(ndjson_rows(df).toLocalIterator()):
                text = json.dumps(json.loads(row["line"]), indent=2, ensure_ascii=False).replace("\n", "\n    ") if pretty else row["line"]
                out.write(("," if k else "") + ("\n    " if pretty else "") + text)
            out.write(("\n  " if pretty else "") + "]")
        out.write("\n}\n" if pretty else "}\n")


def write_yaml(data: Mapping[str, DataFrame], path: str) -> None:
    """entity: a sequence of rows, keys in the order of the columns, in one local file; rows come through the driver."""
    with open(path, "w", encoding="utf-8") as out:
        for name, df in data.items():
            out.write(f"{name}:\n")
            empty = True
            for row in ndjson_rows(df).toLocalIterator():
                empty = False
                out.write(yaml.safe_dump([json.loads(row["line"])], sort_keys=False, allow_unicode=True))
            if empty:
                out.write("  []\n")
