"""SQL's way in: the chunker as a table function, and a folder of documents as a data source."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from murmura.operators.chunking import check_sizes, greedy_chunks
from murmura.session import ship
from murmura.sources import files


@udtf(returnType=T.StructType([T.StructField("filename", T.StringType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("content", T.StringType())]))
class Chunks:
    """chunks(TABLE(...) [PARTITION BY (filename)], size, overlap, 'semantic' or 'sliding') of rows that have filename and content."""

    def eval(self, row: Row, size: int = 1000, overlap: int = 200, method: str = "semantic") -> Iterator[tuple]:
        check_sizes(size, overlap)
        if method not in ("semantic", "sliding"):
            raise ValueError("the method must be semantic or sliding")
        text = row["content"] or ""
        if method == "sliding":
            found = [text[i : i + size] for i in range(0, max(len(text) - overlap, 1), size - overlap)] if text else []
        else:
            found = greedy_chunks(text, size, overlap)
        for n, content in enumerate(found):
            yield row["filename"], n, content


class _Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str]]):
        self.paths = paths  # (path in its store, name shown)


class _Reader(DataSourceReader):
    def __init__(self, uri: str, recursive: bool, lenient: bool, per: int):
        self.uri, self.recursive, self.lenient, self.per = uri, recursive, lenient, per

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(top, recursive=self.recursive))
        root = top.rstrip("/") + "/"
        shown = sorted((f.path, f.path.removeprefix(root) if self.recursive else f.base_name) for f in found if f.type == fs.FileType.File and not f.base_name.startswith("."))
        return [_Files(shown[i : i + self.per]) for i in range(0, len(shown), self.per)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.uri)
        for path, name in partition.paths:
            with store.open_input_file(path) as f:
                yield name, *files.read_bytes(name, f.read(), self.lenient)


class DocumentFolder(DataSource):
    """format("documents"): (filename, content, error) of the files of a folder, some of them a partition.

    Options: path (any store that pyarrow knows), recursive, lenient, filesPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "filename string, content string, error string"

    def reader(self, schema) -> DataSourceReader:
        said = lambda name: self.options.get(name, "false").lower() == "true"
        return _Reader(self.options["path"], said("recursive"), said("lenient"), int(self.options.get("filesPerPartition", "16")))


def register(spark: SparkSession) -> None:
    """Make chunks() and format("documents") known to a session."""
    ship(spark)
    spark.udtf.register("chunks", Chunks)
    spark.dataSource.register(DocumentFolder)
