"""Datasets on disk as Arrow shards: ``spark.read.format("arrow_shards").load(path)``.

The layout is that of a saved dataset dictionary: ``dataset_dict.json`` names the splits, every split
is a folder of ``data-00000-of-00003.arrow`` files, each a stream of record batches, and a
``state.json`` that lists them. A dataset without splits is one such folder. Files are
reached through Arrow's file systems, on the driver and in the tasks.

Reading: a shard is a partition of its own. A filter on ``split`` decides which folders are read
at all; comparisons of whole numbers and strings with a value are applied to the record batches
before Spark sees them. With a schema given, only its columns are taken out of the files.

Writing: every task streams its rows into shards of its own, one per split, under a staging
folder beside the target. The job's commit numbers the shards of the tasks that Spark accepted,
adds the lists and renames the staging folder; a job that fails removes it. Until that rename a
reader sees what was there before, or nothing.
"""

from __future__ import annotations

import json
import posixpath
import re
import sys
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as arrow_fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

# Tasks get the code with the plan, whether or not the package is installed where they run.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT, SPLIT = "arrow_shards", "split"
# The names that the layout gives its files.
SPLITS_FILE, STATE_FILE, INFO_FILE = "dataset_dict.json", "state.json", "dataset_info.json"
SHARD = "data-{:05d}-of-{:05d}.arrow"


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    if "://" not in path:
        return arrow_fs.LocalFileSystem(), path.rstrip("/")
    store, inner = arrow_fs.FileSystem.from_uri(path)
    return store, inner.rstrip("/")


def _exists(store: arrow_fs.FileSystem, path: str) -> bool:
    return store.get_file_info(path).type != arrow_fs.FileType.NotFound


def _json(store: arrow_fs.FileSystem, path: str) -> dict:
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


def _write_json(store: arrow_fs.FileSystem, path: str, value: dict) -> None:
    with store.open_output_stream(path) as f:
        f.write(json.dumps(value, indent=2).encode())


def shards(path: str) -> dict[str | None, list[str]]:
    """Shard files by split, in order; the split of a dataset without splits is None."""
    store, base = opened(path)
    if _exists(store, f"{base}/{SPLITS_FILE}"):
        folders = {s: f"{base}/{s}" for s in _json(store, f"{base}/{SPLITS_FILE}")["splits"]}
    elif _exists(store, f"{base}/{STATE_FILE}"):
        folders = {None: base}
    else:
        raise FileNotFoundError(f"{path} holds no dataset")
    return {
        split: [posixpath.join(folder, f["filename"]) for f in _json(store, f"{folder}/{STATE_FILE}")["_data_files"]]
        for split, folder in folders.items()
    }


@dataclass
class Shard(InputPartition):
    file: str
    split: str | None


_COMPARED = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less,
    LessThanOrEqual: pc.less_equal,
}
_EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType)  # equal here and in Spark


class ShardReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema
        self.splits: set[str] | None = None  # None: all
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._taken(f):
                yield f

    def _taken(self, f: Filter) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name is None or name not in self.schema.fieldNames():
            return False
        if name == SPLIT:
            if isinstance(f, (EqualTo, EqualNullSafe)):
                wanted = {f.value}
            elif isinstance(f, In):
                wanted = set(f.value)
            elif isinstance(f, IsNotNull):
                return True  # a split has a name
            else:
                return False
            self.splits = wanted if self.splits is None else self.splits & wanted
            return True
        exact = isinstance(self.schema[name].dataType, _EXACT)
        if isinstance(f, IsNotNull) or (exact and type(f) in _COMPARED and f.value is not None):
            self.kept.append(f)
            return True
        return False

    def partitions(self) -> list[Shard]:
        return [
            Shard(file, split) for split, files in shards(self.path).items()
            if self.splits is None or split in self.splits for file in files
        ] or [Shard("", None)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, _ = opened(self.path)
        target = to_arrow_schema(self.schema)
        wanted = [n for n in target.names if n != SPLIT or partition.split is None]
        with store.open_input_file(partition.file) as source:
            names = pa.ipc.open_stream(source).schema.names
            absent = [n for n in wanted if n not in names]
            if absent:
                raise ValueError(f"{partition.file} has no column {', '.join(absent)}")
            source.seek(0)
            # Columns that nobody asked for are not taken out of the stream.
            options = pa.ipc.IpcReadOptions(included_fields=sorted(names.index(n) for n in wanted))
            for batch in pa.ipc.open_stream(source, options=options):
                for f in self.kept:
                    column = batch.column(f.attribute[0])
                    batch = batch.filter(pc.is_valid(column) if isinstance(f, IsNotNull) else _COMPARED[type(f)](column, f.value))
                if batch.num_rows == 0:
                    continue
                columns = [
                    pa.repeat(pa.scalar(partition.split, t.type), batch.num_rows) if t.name not in wanted
                    else batch.column(t.name).cast(t.type) for t in target
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=target)


@dataclass
class Written(WriterCommitMessage):
    task: int = 0
    files: list[tuple[str | None, str, int]] = field(default_factory=list)  # split, name, rows


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite
        parent, _, name = path.rstrip("/").rpartition("/")
        self.staging = f"{parent}/.staging-{name}-{uuid.uuid4().hex}"
        # Made here alone: a task that outlives an abort must not bring the folder back.
        store, staging = opened(self.staging)
        store.create_dir(staging, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        store, base = opened(self.staging)
        has_split = SPLIT in self.schema.fieldNames()
        target = to_arrow_schema(T.StructType([f for f in self.schema.fields if f.name != SPLIT or not has_split]))
        out: dict[str | None, tuple] = {}
        rows: dict[str | None, int] = {}

        def put(split: str | None, batch: pa.RecordBatch) -> None:
            if split not in out:
                folder = f"{base}/{split}" if split is not None else base
                if split is not None:
                    store.create_dir(folder, recursive=False)
                name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
                sink = store.open_output_stream(f"{folder}/{name}")
                out[split] = (name, sink, pa.ipc.new_stream(sink, target))
            columns = [batch.column(t.name).cast(t.type) for t in target]
            out[split][2].write_batch(pa.RecordBatch.from_arrays(columns, schema=target))
            rows[split] = rows.get(split, 0) + batch.num_rows

        for batch in iterator:
            if not has_split:
                put(None, batch)
                continue
            splits = batch.column(SPLIT)
            for split in splits.unique().to_pylist():
                if not split or "/" in split or split.startswith((".", "_")):
                    raise ValueError(f"{split!r} cannot name a split")
                put(split, batch.filter(pc.equal(splits, split)))
        for _, sink, stream in out.values():
            stream.close()
            sink.close()
        return Written(context.partitionId(), [(split, name, rows[split]) for split, (name, _, _) in out.items()])

    def commit(self, messages: list[Written | None]) -> None:
        store, staging = opened(self.staging)
        _, base = opened(self.path)
        accepted = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        by_split: dict[str | None, list[tuple[str, int]]] = {}
        for m in accepted:
            for split, name, n in m.files:
                by_split.setdefault(split, []).append((name, n))
        if not by_split and SPLIT not in self.schema.fieldNames():
            by_split[None] = []
        for split, files in by_split.items():
            self._list(store, f"{staging}/{split}" if split is not None else staging, split, files)
        if None not in by_split:
            _write_json(store, f"{staging}/{SPLITS_FILE}", {"splits": sorted(by_split)})
            if not by_split:
                self._empty_shard(store, f"{staging}/schema.arrow")
        gone = None
        if _exists(store, base):
            if not self.overwrite:
                raise FileExistsError(self.path)
            gone = f"{staging}-replaced"
            store.move(base, gone)
        store.move(staging, base)
        if gone is not None:
            store.delete_dir(gone)

    def _empty_shard(self, store: arrow_fs.FileSystem, path: str) -> None:
        fields = [f for f in self.schema.fields if f.name != SPLIT]
        with store.open_output_stream(path) as sink, pa.ipc.new_stream(sink, to_arrow_schema(T.StructType(fields))):
            pass

    def _list(self, store: arrow_fs.FileSystem, folder: str, split: str | None, files: list[tuple[str, int]]) -> None:
        if not files:
            self._empty_shard(store, f"{folder}/{SHARD.format(0, 1)}")
            named = [SHARD.format(0, 1)]
        else:
            named = [SHARD.format(i, len(files)) for i in range(len(files))]
            for name, (old, _) in zip(named, files):
                store.move(f"{folder}/{old}", f"{folder}/{name}")
        wanted = {f"{folder}/{n}" for n in named}
        for info in store.get_file_info(arrow_fs.FileSelector(folder)):  # of attempts that were not accepted
            if info.path.endswith(".arrow") and info.path not in wanted:
                store.delete_file(info.path)
        _write_json(store, f"{folder}/{STATE_FILE}", {"_data_files": [{"filename": n} for n in named], "_split": split})
        fields = [f.jsonValue() for f in self.schema.fields if f.name != SPLIT]
        _write_json(store, f"{folder}/{INFO_FILE}", {"fields": fields, "num_rows": sum(n for _, n in files)})

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = opened(self.staging)
        if _exists(store, staging):
            store.delete_dir(staging)


class ArrowShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        path = self.options["path"]
        found = shards(path)
        store, base = opened(path)
        first = next((files[0] for files in found.values() if files), f"{base}/schema.arrow")
        with store.open_input_file(first) as source:
            own = from_arrow_schema(pa.ipc.open_stream(source).schema)
        return own if None in found else T.StructType([*own.fields, T.StructField(SPLIT, T.StringType())])

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], schema, overwrite)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowShards)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_dataset(df: DataFrame, path: str, mode: str = "append") -> None:
    """``df`` as a dataset on disk, a folder per value of ``split`` if it has that column.

    ``append`` makes a new dataset and fails if there is one; ``overwrite`` replaces it as a whole.
    """
    _registered(df.sparkSession)
    df.write.format(FORMAT).mode(mode).save(path)


def read_dataset(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A dataset on disk; of a dictionary of splits every row has its ``split``.

    ``columns`` names those to take out of the files; Spark does not tell a source of this kind
    which ones a query uses.
    """
    _registered(spark)
    reader = spark.read.format(FORMAT)
    if columns is not None:
        whole = ArrowShards({"path": path}).schema()
        reader = reader.schema(T.StructType([whole[c] for c in columns]))
    return reader.load(path)
