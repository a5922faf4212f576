"""Backup, restore and check of a log."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DataSafetyError, TidemarkError
from .files import files_of
from .operators.log_store import LogStore

MANIFEST = "manifest.json"


def absolute(path: str) -> str:
    """A local path in full; others as they are."""
    return path.rstrip("/") if ":" in path.split("/")[0] else os.path.abspath(path)


def digests(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(path, length, sha256) of files, computed where they are read; ordered by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path if names is None else [f"{path}/{n}" for n in names])
    name = F.substring_index("path", f"{absolute(path)}/", -1)
    return files.select(name.alias("path"), "length", F.sha2("content", 256).alias("sha256")).orderBy("path")


def backup(store: LogStore, output: str, source_name: str) -> dict:
    """Files of the latest commit and a manifest, published by a rename."""
    output, data, files = absolute(output), absolute(store.path), files_of(store.spark, output if ":" in output.split("/")[0] else store.path)
    if files.exists(output):
        raise TidemarkError(f"{output} exists")
    if output.startswith(data + "/"):
        raise TidemarkError("a backup cannot lie in the log")
    report, state, tmp = store.verify(), store.state(), f"{output}.{uuid.uuid4().hex}"
    try:
        files.make(f"{tmp}/log/data")
        for name in [x for x in files.names(f"{data}/_commits") if not x.startswith(".")]:
            files.copy(f"{data}/_commits/{name}", f"{tmp}/log/_commits/{name}")
        for s in state.segments:
            for f in (*s.files, *s.marker_files):
                for name in [x for x in files.names(f"{data}/data/{f}") if not x.startswith((".", "_"))]:
                    files.copy(f"{data}/data/{f}/{name}", f"{tmp}/log/data/{f}/{name}")
        listed = [r.asDict() for r in digests(store.spark, f"{tmp}/log").collect()]
        manifest = {"format_version": state.format_version, "version": state.version, "source": source_name, "report": report, "offset": state.source_offsets.get(source_name), "identity": state.identities.get(source_name), "files": listed}
        files.write(f"{tmp}/{MANIFEST}", json.dumps(manifest, indent=1))
        files.rename(tmp, output)
    except BaseException:
        files.delete(tmp)
        raise
    return manifest


def restore(spark: SparkSession, source: str, target: str) -> LogStore:
    """Files are compared with the manifest before the target exists, the log's report after."""
    files = files_of(spark, target if ":" in target.split("/")[0] else source)
    if files.exists(target) and files.names(target):
        raise TidemarkError(f"{target} is not empty")
    manifest = json.loads(files.read(f"{source}/{MANIFEST}"))
    found = [r.asDict() for r in digests(spark, f"{source}/log").collect()]
    if found != sorted(manifest["files"], key=lambda x: x["path"]):
        raise DataSafetyError("the backup's files differ from its manifest")
    files.delete(target)
    files.copy(f"{source}/log", target)
    store = LogStore(spark, target)
    state = store.state()
    if store.verify() != manifest["report"] or state.source_offsets.get(manifest["source"]) != manifest["offset"] or state.identities.get(manifest["source"]) != manifest["identity"]:
        raise DataSafetyError("the restored log differs from its manifest")
    return store
