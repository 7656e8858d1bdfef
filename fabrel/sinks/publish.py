"""Datasets that readers see whole: versioned folders behind a manifest that is written last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def manifest(spark: SparkSession, folder: str) -> dict[str, str]:
    """The current version (a path below the folder) of each dataset; none where nothing was published."""
    fs, path = _fs(spark, f"{folder}/{MANIFEST}")
    if not fs.exists(path):
        return {}
    return json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))  # a line for each dataset


def _swap(spark: SparkSession, folder: str, entries: dict[str, str]) -> None:
    """The manifest, written beside the old one and renamed over it: readers see the one or the other."""
    fs, new = _fs(spark, f"{folder}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(entries, indent=0, sort_keys=True).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}"), options)


def publish(spark: SparkSession, folder: str, writers: dict[str, Callable[[str], None]]) -> dict[str, str]:
    """Writes each dataset into a folder of its own, then lets the manifest name all of them at once; returns the manifest.

    A write that fails changes nothing that readers see. The version before stays, so readers that opened it still find it; older
    ones, and what failed writes left, go. One publisher at a time: two would each keep only their own entries.
    """
    before = manifest(spark, folder)
    entries = dict(before)
    for name, write in writers.items():
        version = f"versions/{name}/{uuid.uuid4().hex}"
        write(f"{folder}/{version}")
        entries[name] = version
    _swap(spark, folder, entries)
    for name in writers:
        fs, path = _fs(spark, f"{folder}/versions/{name}")
        kept = {x[name].rpartition("/")[2] for x in (before, entries) if name in x}
        for status in fs.listStatus(path):
            if status.getPath().getName() not in kept:
                fs.delete(status.getPath(), True)
    return entries


def publish_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """The tables as Parquet, all of them new to readers at the same moment."""
    spark = next(iter(tables.values())).sparkSession
    return publish(spark, folder, {n: df.write.parquet for n, df in tables.items()})


def published_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{version}") for n, version in manifest(spark, folder).items()}
