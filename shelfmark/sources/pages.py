"""A catalogue kept as a folder of pages, read as a Spark data source.

A page is a Parquet file of consecutive keys. An index file says which catalogue and which
keys each page holds; the reader makes one partition a page and opens only the pages that
the wanted catalogues and key range meet. Inside a page the range reaches the Parquet
reader. Any file system that Arrow opens will do.
"""

from __future__ import annotations

import functools
import json
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructField, StructType

INDEX = "_pages.json"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_pages(df: DataFrame, path: str, catalog: str = "catalogId", key: str = "catalogItemId", size: int = 5_000) -> None:
    """Write rows as pages of at most ``size`` rows of one catalogue, in key order, and their index.

    Rows without a key belong to no page and are left out. Tasks write their own pages; the
    driver writes the index, one line a page.
    """
    schema = df.schema
    rows = df.where(F.col(key).isNotNull() & F.col(catalog).isNotNull())
    ranged = rows.repartitionByRange(catalog, key).sortWithinPartitions(catalog, key)

    def write(batches):
        files, folder = _open(path)
        files.create_dir(folder, recursive=True)

        def put(table: pa.Table):
            first, last = table[key][0].as_py(), table[key][-1].as_py()
            of = table[catalog][0].as_py()
            # named by what it holds: a task that runs twice writes the same files
            name = f"page-{of}-{str(first).encode().hex()}.parquet"
            pq.write_table(table, f"{folder}/{name}", filesystem=files)
            return {"name": name, "catalog": of, "first": first, "last": last, "rows": table.num_rows}

        waiting: list[pa.RecordBatch] = []
        held, pages = 0, []

        def flush():
            nonlocal waiting, held
            if held:
                pages.append(put(pa.Table.from_batches(waiting)))
            waiting, held = [], 0

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                current = batch.column(catalog)[at].as_py()
                if waiting and waiting[0].column(catalog)[0].as_py() != current:
                    flush()
                stop = at
                ids = batch.column(catalog)
                while stop < batch.num_rows and held + stop - at < size and ids[stop].as_py() == current:
                    stop += 1
                waiting.append(batch.slice(at, stop - at))
                held += stop - at
                at = stop
                if held == size:
                    flush()
        flush()
        yield pa.record_batch([pa.array([json.dumps(p, default=str) for p in pages], pa.string())], names=["page"])

    pages = [json.loads(r["page"]) for r in ranged.mapInArrow(write, "page string").collect()]
    files, folder = _open(path)
    files.create_dir(folder, recursive=True)
    with files.open_output_stream(f"{folder}/{INDEX}") as out:
        out.write(json.dumps({"schema": schema.jsonValue(), "catalog": catalog, "key": key, "pages": sorted(pages, key=lambda p: p["name"])}).encode())


@dataclass
class Page(InputPartition):
    name: str


def _index(path: str) -> dict:
    files, folder = _open(path)
    with files.open_input_stream(f"{folder}/{INDEX}") as source:
        return json.loads(source.read())


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema, self.index = options["path"], schema, _index(options["path"])
        self.catalogs = json.loads(options.get("catalogs", "null"))
        self.after, self.upto = (json.loads(options.get(name, "null")) for name in ("after", "upto"))

    def _wanted(self, page: dict) -> bool:
        if self.catalogs is not None and page["catalog"] not in self.catalogs:
            return False
        return (self.after is None or page["last"] > self.after) and (self.upto is None or page["first"] <= self.upto)

    def partitions(self) -> list[Page]:
        return [Page(p["name"]) for p in self.index["pages"] if self._wanted(p)] or [Page("")]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        if not partition.name:  # nothing is wanted, and Spark asks for a partition at least
            return
        files, folder = _open(self.path)
        tests, key = [], ds.field(self.index["key"])
        if self.after is not None:
            tests.append(key > self.after)
        if self.upto is not None:
            tests.append(key <= self.upto)
        page = ds.dataset(f"{folder}/{partition.name}", filesystem=files, format="parquet")
        yield from page.to_batches(columns=[f.name for f in self.schema.fields], filter=functools.reduce(operator.and_, tests) if tests else None)


class PageSource(DataSource):
    """``spark.read.format("catalog_pages").load(path)``"""

    @classmethod
    def name(cls) -> str:
        return "catalog_pages"

    def schema(self) -> StructType:
        fields = StructType.fromJson(_index(self.options["path"])["schema"]).fields
        return StructType([StructField(f.name, f.dataType, True) for f in fields])

    def reader(self, schema: StructType) -> PageReader:
        return PageReader(self.options, schema)


def read_pages(spark: SparkSession, path: str, catalogs: Sequence | None = None, after=None, upto=None) -> DataFrame:
    """Rows of some catalogues (all by default) with keys above ``after`` and up to ``upto``.

    The range is an option of the scan, not a filter that Spark hands to the source: Spark 4.1
    keeps one reader for all scans of a loaded table, so what one scan pushes would also cut
    the rows of another scan of the same table in the same query.
    """
    spark.dataSource.register(PageSource)
    wanted = {"catalogs": None if catalogs is None else list(catalogs), "after": after, "upto": upto}
    options = {name: json.dumps(value) for name, value in wanted.items() if value is not None}
    return spark.read.format(PageSource.name()).options(**options).load(path)
