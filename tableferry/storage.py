"""Files of the shared store as seen from Python: one way to name, open and list them."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system named. A path without a scheme is one of the cluster's default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def open_store(location: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified location, and the path in it."""
    if location.startswith("file:"):
        return fs.LocalFileSystem(), "/" + location.removeprefix("file:").lstrip("/")
    if "://" in location:
        return fs.FileSystem.from_uri(location)
    raise ValueError(f"{location!r} names no file system; give a qualified location")


def list_files(location: str) -> list[tuple[str, int]]:
    """(location, bytes) of every data file at or below ``location``, by name; hidden ones are left out."""
    store, root = open_store(location)
    info = store.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(location)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
    prefix = "file:" if location.startswith("file:") else location[: -len(root)] if location.endswith(root) else ""

    def shown(path: str) -> bool:
        return not any(part.startswith(("_", ".")) for part in posixpath.relpath(path, root).split("/") if part != ".")

    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f.path))


COMMITTED = "_committed"


def publish(location: str, name: str, folders: list[str]) -> None:
    """Makes the files in ``folders`` below ``location`` count, all at once: the manifest appears as a whole."""
    store, root = open_store(location)
    store.create_dir(f"{root}/{COMMITTED}", recursive=True)
    hidden = f"{root}/{COMMITTED}/.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(json.dumps(folders).encode())
    store.move(hidden, f"{root}/{COMMITTED}/{name}.json")


def list_committed(location: str) -> list[tuple[str, int]]:
    """The files that count: those in folders a manifest names, or all where nothing was ever published."""
    location = location.rstrip("/")
    store, root = open_store(location)
    if store.get_file_info(f"{root}/{COMMITTED}").type != fs.FileType.Directory:
        return list_files(location)
    out = []
    for file, _ in list_files(f"{location}/{COMMITTED}"):
        own, path = open_store(file)
        with own.open_input_stream(path) as source:
            for folder in json.loads(source.read()):
                out += list_files(f"{location}/{folder}")
    return sorted(out)
