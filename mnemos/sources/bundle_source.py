"""Bundles as a data source: rows as JSON lines in parts, and a manifest with the size and SHA-256 of each.

Every task writes a part of its own and tells the driver its digest; the driver writes the manifest last, so a bundle without one isn't whole. A part is read as a whole and
compared with the manifest before any of its rows leaves the reader. Files are reached through pyarrow, in whatever store the path names.

    spark.dataSource.register(BundleSource)
    df.write.format("sealed_bundle").mode("overwrite").save(path)
    spark.read.format("sealed_bundle").load(path)
"""

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_json_string

#: Versions of the format; rows of a part are gathered up to about so many bytes, then the task goes on with another part.
VERSION, PART = "1", 64 << 20
MANIFEST = "manifest.json"


class BundleError(ValueError):
    """A bundle that isn't what its manifest says."""


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _read(path: str, name: str) -> bytes:
    store, root = _store(path)
    try:
        with store.open_input_stream(f"{root}/{name}") as f:
            return f.read()
    except FileNotFoundError as e:
        raise BundleError(f"the bundle has no {name}") from e


def _write(path: str, name: str, data: bytes) -> None:
    store, root = _store(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(data)


def manifest(path: str) -> dict:
    """The manifest of a bundle. Raises BundleError if there is none, or of another version."""
    try:
        found = json.loads(_read(path, MANIFEST))
    except ValueError as e:
        raise BundleError(str(e)) from e
    if not isinstance(found, dict) or found.get("bundle_version") != VERSION:
        raise BundleError("unsupported bundle_version")
    return found


@dataclass
class Part(InputPartition):
    name: str
    rows: int
    size: int
    sha256: str


@dataclass
class Written(WriterCommitMessage):
    parts: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path, schema, overwrite
        self.run = uuid.uuid4().hex[:8]

    def write(self, iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        stem, parts, lines, size = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{self.run}", [], [], 0

        def close() -> None:
            nonlocal lines, size
            data = b"".join(lines)
            name = f"{stem}-{len(parts)}.jsonl"
            _write(self.path, name, data)
            parts.append({"name": name, "rows": len(lines), "size": len(data), "sha256": hashlib.sha256(data).hexdigest()})
            lines, size = [], 0

        for row in iterator:
            line = json.dumps(_plain(row.asDict(recursive=True)), ensure_ascii=False, separators=(",", ":")).encode() + b"\n"
            lines.append(line)
            size += len(line)
            if size >= PART:
                close()
        if lines:
            close()
        return Written(parts)

    def commit(self, messages: list) -> None:
        store, root = _store(self.path)
        if not self.overwrite and _there(store, f"{root}/{MANIFEST}"):
            self.abort(messages)
            raise BundleError("there is a bundle already")
        before = manifest(self.path)["parts"] if _there(store, f"{root}/{MANIFEST}") else []
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: p["name"])
        whole = {"bundle_version": VERSION, "schema": self.schema.jsonValue(), "rows": sum(p["rows"] for p in parts), "parts": parts}
        _write(self.path, MANIFEST, json.dumps(whole, indent=1, sort_keys=True).encode())
        for p in before:
            store.delete_file(f"{root}/{p['name']}")

    def abort(self, messages: list) -> None:
        store, root = _store(self.path)
        for m in messages:
            for p in m.parts if m else ():
                store.delete_file(f"{root}/{p['name']}")


def _there(store, path: str) -> bool:
    from pyarrow import fs

    return store.get_file_info(path).type != fs.FileType.NotFound


def _plain(value):
    """A value as JSON has it: times and dates as ISO texts, decimals as texts, bytes as hex."""
    import datetime
    import decimal

    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    return bytes(value).hex() if isinstance(value, (bytes, bytearray)) else value


def _typed(value, kind):
    """A value of a type from its JSON."""
    import datetime
    import decimal

    from pyspark.sql import types as T

    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_typed(value.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return [_typed(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return {_key(k, kind.keyType): _typed(v, kind.valueType) for k, v in value.items()}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime.fromisoformat(value)
    if isinstance(kind, T.DateType):
        return datetime.date.fromisoformat(value)
    if isinstance(kind, T.DecimalType):
        return decimal.Decimal(value)
    if isinstance(kind, T.BinaryType):
        return bytes.fromhex(value)
    return float(value) if isinstance(kind, (T.DoubleType, T.FloatType)) else value


def _key(text: str, kind):
    from pyspark.sql import types as T

    return int(text) if isinstance(kind, T.IntegralType) else _typed(text, kind)


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[Part]:
        return [Part(p["name"], p["rows"], p["size"], p["sha256"]) for p in manifest(self.path)["parts"]]

    def read(self, partition: Part):
        if partition is None:
            return
        data = _read(self.path, partition.name)
        if len(data) != partition.size or hashlib.sha256(data).hexdigest() != partition.sha256:
            raise BundleError(f"checksum mismatch for {partition.name}")
        lines = data.splitlines()
        if len(lines) != partition.rows:
            raise BundleError(f"{partition.name} has {len(lines)} rows, not {partition.rows}")
        for line in lines:
            yield _typed(json.loads(line), self.schema)


class BundleSource(DataSource):
    """The data source `sealed_bundle`; a read takes the schema from the manifest. A part's rows are in the memory of one task, about PART bytes of them."""

    @classmethod
    def name(cls) -> str:
        return "sealed_bundle"

    def schema(self) -> StructType:
        return _parse_datatype_json_string(json.dumps(manifest(self.options["path"])["schema"]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema, overwrite)


def verified(spark, path: str):
    """(name, rows, size, problem) of a bundle's parts, each compared with the manifest in its own task; problem: missing, checksum_mismatch or null."""
    parts = spark.createDataFrame([(p["name"], p["rows"], p["size"], p["sha256"]) for p in manifest(path)["parts"]], "name string, rows long, size long, sha256 string")

    def look(batches):
        import pandas as pd

        for batch in batches:
            problems = []
            for p in batch.itertuples():
                try:
                    problems.append(None if hashlib.sha256(_read(path, p.name)).hexdigest() == p.sha256 else "checksum_mismatch")
                except BundleError:
                    problems.append("missing")
            yield pd.DataFrame({"name": batch["name"], "rows": batch["rows"], "size": batch["size"], "problem": pd.Series(problems, dtype=object)})

    return parts.repartition(max(1, min(200, parts.count()))).mapInPandas(look, "name string, rows long, size long, problem string")
