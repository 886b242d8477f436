"""Feather (Arrow IPC file) reader on the Python Data Source API.

A file's footer says where its record batches lie, so a file is split into
input partitions of consecutive batches of about ``PARTITION_BYTES``; each
task opens the file through pyarrow's filesystem layer (local, HDFS or object
stores, whatever pyarrow supports for the URI), seeks to its batches and
yields them, so rows never pass through the driver.  Option ``columns`` (names
separated by commas) reads only those columns' buffers.  Comparisons of a
column with a value are evaluated on the batches (``register`` turns on
Spark's filter pushdown to Python sources).  The schema comes from the
first file's footer.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _fs(path: str):
    """pyarrow filesystem and path for a local path, a ``file:`` URI or any
    URI pyarrow understands (hdfs://, s3://, ...)."""
    import pyarrow.fs as pafs

    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def output_stream(path: str):
    fs, p = _fs(path)
    parent = p.rsplit("/", 1)[0]
    fs.create_dir(parent, recursive=True)
    return fs.open_output_stream(p)


def _list_files(path: str) -> list[str]:
    import pyarrow.fs as pafs

    fs, root = _fs(path)
    info = fs.get_file_info(root)
    prefix = path[: len(path) - len(root)] if "://" in path else ""
    if info.type == pafs.FileType.File:
        return [path]
    sel = pafs.FileSelector(root, recursive=True)
    files = [f.path for f in fs.get_file_info(sel) if f.type == pafs.FileType.File
             and f.path.lower().endswith((".feather", ".arrow", ".ipc"))]
    return sorted(prefix + f for f in files)


def _open(path: str):
    fs, p = _fs(path)
    return fs.open_input_file(p)


#: Bytes of an input partition; a record batch is never split.
PARTITION_BYTES = 64 << 20
_FOOTER_THREADS = 16


def _columns(options: dict) -> list[str] | None:
    named = options.get("columns")
    return [c.strip() for c in named.split(",")] if named else None


def _reader(f, columns: list[str] | None):
    """The file's reader, of these columns' buffers only, in the file's order."""
    import pyarrow.ipc as ipc

    if columns is None:
        return ipc.open_file(f)
    names = ipc.open_file(f).schema.names
    return ipc.open_file(f, options=ipc.IpcReadOptions(included_fields=[names.index(c) for c in columns]))


class FeatherDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feather"

    def schema(self):
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _list_files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no feather files under {self.options['path']}")
        with _open(files[0]) as f:
            return from_arrow_schema(_reader(f, _columns(self.options)).schema)

    def reader(self, schema):
        plain = {f.name for f in schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "string")}
        return FeatherReader(self.options["path"], _columns(self.options), int(self.options.get("partitionBytes", PARTITION_BYTES)), plain)


class BatchRange(InputPartition):
    """Record batches ``first`` to ``stop`` of a file."""

    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


def split_file(path: str, partition_bytes: int) -> list[BatchRange]:
    import pyarrow.ipc as ipc

    with _open(path) as f:
        batches, size = ipc.open_file(f).num_record_batches, f.size()
    if not batches:
        return []
    parts = min(batches, max(1, -(-size // partition_bytes)))
    cuts = [batches * k // parts for k in range(parts + 1)]
    return [BatchRange(path, a, b) for a, b in zip(cuts, cuts[1:])]


class FeatherReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str] | None = None, partition_bytes: int = PARTITION_BYTES, plain: set[str] = frozenset()):
        self.path, self.columns, self.partition_bytes, self.plain, self.filters = path, columns, partition_bytes, plain, []

    def pushFilters(self, filters):
        """Takes comparisons of a whole-number or text column with a value; the
        others (floating values order NaN differently) stay with Spark."""
        for f in filters:
            if _mask_of(f) is None or f.attribute[0] not in self.plain:
                yield f
            else:
                self.filters.append(f)

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        files = _list_files(self.path)
        with ThreadPoolExecutor(_FOOTER_THREADS) as pool:  # footers only
            return [p for parts in pool.map(lambda f: split_file(f, self.partition_bytes), files) for p in parts]

    def read(self, partition):
        import pyarrow.compute as pc

        masks = [_mask_of(f) for f in self.filters]
        with _open(partition.path) as f:
            reader = _reader(f, self.columns)
            for i in range(partition.first, partition.stop):
                batch = reader.get_batch(i)
                for mask in masks:
                    batch = batch.filter(pc.fill_null(mask(batch), False))
                if batch.num_rows:
                    yield batch


def _mask_of(f):
    """A function from a batch to the rows that pass, or None for filters left to Spark."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark.sql import datasource as D

    compare = {D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal}
    column = getattr(f, "attribute", None)
    if column is None or len(column) != 1:
        return None
    name = column[0]
    if type(f) is D.IsNotNull:
        return lambda b: pc.is_valid(b.column(name))
    if type(f) is D.IsNull:
        return lambda b: pc.is_null(b.column(name))
    if type(f) in compare and isinstance(f.value, (int, str)) and not isinstance(f.value, bool):
        return lambda b: compare[type(f)](b.column(name), pa.scalar(f.value))
    return None


def register(spark) -> None:
    from foldwise.session import ship_package

    ship_package(spark)  # the reader classes are imported by the Python workers
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # a reader that takes filters needs it
    spark.dataSource.register(FeatherDataSource)
