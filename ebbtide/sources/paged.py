"""A source that is read by pages and a sink that is written by chunks, as services with row limits demand.

The classes are made when they are registered, so executors get them by value and need no package of ours.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

PAGE, CHUNK = 1000, 800


def register(spark: SparkSession) -> None:
    """Make the formats `paged` and `chunked` known to a session.

    paged: options path (a Parquet file or folder by a URI of pyarrow's file systems), schema (DDL), page (rows a
    page) and equal (a JSON object of columns and values). One partition is one page, so pages are read in
    parallel and a lost one is read again alone. The source filters: it counts the rows that are equal and pages
    over those only. The filter is an option and not one that Spark pushes, as Spark keeps a pushed filter with
    the table and would apply it to every later query on the same frame. A page reads the row groups that hold
    it. Rows keep the table's order.

    chunked: options path and chunk (rows a file). Tasks write JSON-lines files under names of their own; the
    commit lists those of the tasks that counted in `_chunks-<id>`, by one rename, so a chunk that a retried task wrote
    again is listed once and a reader that follows the lists never sees another. An aborted write deletes its files.
    """
    from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

    class Page(InputPartition):
        def __init__(self, start: int, stop: int):
            self.start, self.stop = start, stop

    class Reader(DataSourceReader):
        def __init__(self, options, schema):
            self.path, self.page, self.schema = options["path"], int(options.get("page", PAGE)), schema
            self.equal = list(json.loads(options.get("equal", "{}")).items())

        def _fragments(self):
            """(fragment of one row group, its rows), in the table's order."""
            import pyarrow.dataset as ds

            table = ds.dataset(self.path, format="parquet")
            for file in sorted(table.get_fragments(), key=lambda f: f.path):
                for group in file.split_by_row_group():
                    where = self._where()
                    yield group, sum(g.num_rows for g in group.row_groups) if where is None else group.to_table(columns=[], filter=where).num_rows

        def _where(self):
            import pyarrow.dataset as ds

            out = None
            for column, value in self.equal:
                one = ds.field(column) == value
                out = one if out is None else out & one
            return out

        def partitions(self):
            rows = sum(n for _, n in self._fragments())
            return [Page(k, min(rows, k + self.page)) for k in range(0, rows, self.page)] or [Page(0, 0)]

        def read(self, partition):
            at = 0
            for group, n in self._fragments():
                lo, hi = max(partition.start, at), min(partition.stop, at + n)
                if lo < hi:
                    yield from group.to_table(columns=self.schema.fieldNames(), filter=self._where()).slice(lo - at, hi - lo).to_batches()
                at += n
                if at >= partition.stop:
                    break

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return "paged"

        def schema(self):
            return self.options["schema"]

        def reader(self, schema):
            return Reader(self.options, schema)

    class Written(WriterCommitMessage):
        def __init__(self, files):
            self.files = files

    class Writer(DataSourceArrowWriter):
        def __init__(self, options):
            import uuid

            self.path, self.chunk, self.id = options["path"], int(options.get("chunk", CHUNK)), uuid.uuid4().hex

        def _store(self):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(self.path)
            store.create_dir(root)
            return store, root

        def write(self, batches):
            import uuid

            from pyspark import TaskContext

            store, root = self._store()
            task, files, held = TaskContext.get().partitionId(), [], []

            def flush():
                # The name tells the chunk; an attempt that is repeated adds a name of its own and not a second entry.
                name = f"{self.id}-{task:06d}-{len(files):06d}-{uuid.uuid4().hex[:8]}.json"
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write("".join(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in held).encode())
                files.append(name)
                held.clear()

            for b in batches:
                for s in range(0, b.num_rows, 256):
                    for row in b.slice(s, 256).to_pylist():
                        held.append(row)
                        if len(held) >= self.chunk:
                            flush()
            if held:
                flush()
            return Written(files)

        def commit(self, messages):
            store, root = self._store()
            with store.open_output_stream(f"{root}/_tmp-{self.id}") as out:
                out.write("".join(f + "\n" for m in messages if m for f in m.files).encode())
            store.move(f"{root}/_tmp-{self.id}", f"{root}/_chunks-{self.id}")

        def abort(self, messages):
            store, root = self._store()
            from pyarrow import fs

            for info in store.get_file_info(fs.FileSelector(root)):
                if info.base_name.startswith(self.id):
                    store.delete_file(info.path)

    class Chunked(DataSource):
        @classmethod
        def name(cls):
            return "chunked"

        def writer(self, schema, overwrite):
            return Writer(self.options)

    spark.dataSource.register(Paged)
    spark.dataSource.register(Chunked)


def read_pages(spark: SparkSession, path: str, schema: str, page: int = PAGE, equal: dict | None = None):
    """A table by pages, of the rows whose columns equal the values given."""
    register(spark)
    return spark.read.format("paged").option("path", path).option("schema", schema).option("page", page).option("equal", json.dumps(equal or {})).load()


def write_chunks(df, path: str, chunk: int = CHUNK) -> None:
    register(df.sparkSession)
    df.write.format("chunked").option("path", path).option("chunk", chunk).mode("append").save()


def read_chunks(spark: SparkSession, path: str, schema: str):
    """The rows of all chunks that a commit lists; the lists name files, so they are few and small."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    lists = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("_chunks-")]
    names = [n for f in sorted(lists) for n in store.open_input_file(f).read().decode().split("\n") if n]
    return spark.read.schema(schema).json([f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], schema)
