"""Token counts from flat token files by a separator scan.

A token file is a run of token identifiers without an index, each document followed by the end-of-document identifier.
Files are read in blocks of a fixed number of identifiers; in each block the separators are found by one array
comparison, which gives the counts of the documents that lie inside it, and the open ends at its two borders. A prefix
scan over the blocks' summaries (within stretches of blocks, then over the stretches) numbers the documents and sums
the pieces of those that cross borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..sources.tars import file_system, listed
from . import common
from .bpe import codec, default_path
from .common import slices, table, written

#: Identifiers in a block, and blocks in a stretch of the prefix scan.
BLOCK = 1 << 19
STRETCH = 1024


def _pack(path: str, end: int, block: int):
    """Documents -> the blocks of one token file for each partition, and the ids of the documents that end in each
    (kept beside the file for checks; the scan does not read them)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c, file, number = codec(path), TaskContext.get().partitionId(), 0
        stand_in = min(len(c.raw), np.iinfo(c.kind).max)  # no token has it, unless all are taken
        stand_in -= stand_in == end
        held, size, ends = [], 0, []
        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = c.encode(text if isinstance(text, str) else "")
                    held.append(np.where(ids == end, np.array(stand_in, dtype=c.kind), ids))
                    held.append(np.array([end], dtype=c.kind))
                    size += len(held[-2]) + 1
                    ends.append((size - 1, doc))
                    while size >= block:
                        flat = np.concatenate(held)
                        here = [d for at, d in ends if at < block]
                        ends = [(at - block, d) for at, d in ends if at >= block]
                        yield pd.DataFrame([(file, number, flat[:block].tobytes(), here)], columns=["file", "block", "ids", "docs"])
                        held, size, number = [flat[block:]], size - block, number + 1
        if size:
            flat = np.concatenate(held).tobytes()
            yield pd.DataFrame([(file, number, flat, [d for _, d in ends])], columns=["file", "block", "ids", "docs"])

    return run


def write_token_files(docs: DataFrame, path: str, end: int, block: int = BLOCK) -> DataFrame:
    """Encode docs(doc_id, text) into flat token files in blocks: file, block, ids (little-endian identifiers), docs.

    End-of-document identifiers that the text itself yields are written as the first identifier past the vocabulary, so
    that they count as tokens and not as separators. Null counts as empty; an empty document is its separator alone."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = source.where("doc_id IS NOT NULL")
    return written(source.mapInPandas(_pack(path, end, block), "file int, block long, ids binary, docs array<long>"), "op5-files")


class TokenRange(InputPartition):
    """Blocks first..last (not included) of a flat file."""

    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


class TokenFiles(DataSource):
    """Flat files of token identifiers as blocks: file (its path), block, ids. A partition is a range of a file's bytes that
    begins at a block, so that a file of any size is read by as many tasks as it has ranges, without an index; options: path,
    width (bytes of an identifier), block (identifiers), range (blocks). The files' sizes are all that is looked up before."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "file STRING, block BIGINT, ids BINARY"

    def reader(self, schema) -> DataSourceReader:
        o = {k.lower(): v for k, v in self.options.items()}
        return TokenReader(o["path"], int(o["width"]) * int(o["block"]), int(o["range"]))


class TokenReader(DataSourceReader):
    def __init__(self, path: str, size: int, together: int):
        self.path, self.size, self.together = path, size, together

    def partitions(self) -> list[TokenRange]:
        out = []
        for x in listed(self.path, suffixes=()):
            blocks = -(-x.size // self.size)
            out += [TokenRange(x.path, k, min(k + self.together, blocks)) for k in range(0, blocks, self.together)]
        return out or [TokenRange("", 0, 0)]

    def read(self, partition: TokenRange) -> Iterator[tuple]:
        path, first, last = partition.value
        if first < last:
            with file_system(self.path)[0].open_input_file(path) as f:
                for k in range(first, last):
                    yield path, k, f.read_at(self.size, k * self.size)


def read_token_files(spark: SparkSession, path: str, width: int, block: int = BLOCK, together: int = 64) -> DataFrame:
    """Flat binary token files (a file, those right in a folder, or a pattern; none where there are none) as blocks: file, block,
    ids. `together` blocks of a file are one task. An empty file has no block."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").options(width=width, block=block, range=together).load(path)


def _scan(width: int, end: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, block, raw in zip(batch["file"], batch["block"], batch["ids"], strict=True):
                ids = np.frombuffer(raw, dtype=f"<u{width}", count=len(raw) // width)
                at = np.flatnonzero(ids == end)
                if len(at):
                    rows.append((file, block, len(at), int(at[0]), len(ids) - int(at[-1]) - 1, np.diff(at) - 1))
                else:
                    rows.append((file, block, 0, len(ids), len(ids), np.zeros(0, dtype=np.int64)))
            yield pd.DataFrame(rows, columns=["file", "block", "n_ends", "head", "tail", "inner"])

    return run


def count_tokens(blocks: DataFrame, end: int, width: int = 2) -> DataFrame:
    """blocks(file, block, ids) -> (file, document, n_tokens): the documents of each file in their order from 0, with
    the identifiers before their separators. What follows a file's last separator is its last document, if there is any.

    Empty blocks and empty tables give no rows; bytes at the end of a block that make no identifier do not count; an empty document counts 0; null ids are taken as an empty block.
    """
    kind = dict(blocks.dtypes)["file"]
    rows = blocks.select("file", "block", F.coalesce("ids", F.lit(b"")).alias("ids"))
    schema = f"file {kind}, block long, n_ends long, head long, tail long, inner array<long>"
    scanned = written(rows.mapInPandas(_scan(width, end), schema), "op5-scan")
    stretch = F.floor(F.col("block") / STRETCH).cast("long")
    marks = scanned.select("file", "block", "n_ends", "head", "tail").withColumn("stretch", stretch)
    # a block carries on the open document: its tail, and all of the blocks before it back to the last separator
    inside = Window.partitionBy("file", "stretch").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    marks = marks.withColumn("run", F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(before))
    marks = marks.withColumn("run", F.coalesce("run", F.lit(0)))
    same = Window.partitionBy("file", "stretch", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("carry_own", F.coalesce(F.sum(F.when(F.col("n_ends") == 0, F.col("tail"))).over(same), F.lit(0)))
    last_tail = F.last(F.when(F.col("n_ends") > 0, F.col("tail")), ignorenulls=True).over(before)
    marks = marks.withColumn("carry", F.col("carry_own") + F.coalesce(last_tail, F.lit(0)))
    marks = written(marks.drop("carry_own"), "op5-marks")
    totals = marks.groupBy("file", "stretch").agg(
        F.sum("n_ends").alias("n_ends"),
        F.max_by(F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")), "block").alias("left"),
    )
    over = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ends_over", F.coalesce(F.sum("n_ends").over(over), F.lit(0)))
    totals = totals.withColumn("groups", F.coalesce(F.sum(F.when(F.col("n_ends") > 0, 1).otherwise(0)).over(over), F.lit(0)))
    chain = Window.partitionBy("file", "groups").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.sum(F.when(F.col("n_ends") == 0, F.col("left"))).over(chain), F.lit(0))
    closed = F.coalesce(F.last(F.when(F.col("n_ends") > 0, F.col("left")), ignorenulls=True).over(over), F.lit(0))
    totals = totals.withColumn("over", open_ + closed).select("file", "stretch", "ends_over", "over")
    marks = marks.join(totals, ["file", "stretch"])
    first = F.col("head") + F.col("carry") + F.when(F.col("run") == 0, F.col("over")).otherwise(0)
    marks = marks.select("file", "block", (F.col("ends_over") + F.col("ends_before")).alias("base"), first.alias("first"), "n_ends", "tail")
    parts = scanned.where("n_ends > 0").select("file", "block", "inner").join(marks.drop("n_ends", "tail"), ["file", "block"])
    counts = F.concat(F.array("first"), "inner")
    closed_docs = parts.select("file", "base", F.posexplode(counts).alias("i", "n_tokens"))
    closed_docs = closed_docs.select("file", (F.col("base") + F.col("i")).alias("document"), "n_tokens")
    end_of_file = marks.groupBy("file").agg(F.max_by(F.struct("base", "first", "n_ends", "tail"), "block").alias("z"))
    rest = F.when(F.col("z.n_ends") > 0, F.col("z.tail")).otherwise(F.col("z.first"))
    open_docs = end_of_file.select("file", (F.col("z.base") + F.col("z.n_ends")).alias("document"), rest.alias("n_tokens"))
    return closed_docs.unionByName(open_docs.where("n_tokens > 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from token files that are written first; doc_id comes from the side list."""
    common.prepare(spark)
    c = codec(default_path())
    end = c.special_id("<|endoftext|>")
    files = write_token_files(table(spark, sf_dir, "documents"), default_path(), end)
    counts = count_tokens(files.select("file", "block", "ids"), end, np.dtype(c.kind).itemsize)
    sizes = files.select("file", "block", F.size("docs").cast("long").alias("n"), "docs")
    stretch = F.floor(F.col("block") / STRETCH).cast("long")
    sizes = sizes.withColumn("stretch", stretch)
    inside = Window.partitionBy("file", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("file").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("file", "stretch").agg(F.sum("n").alias("n"))
    totals = totals.select("file", "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("over"))
    place = sizes.select("file", "block", "stretch", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("base"))
    place = place.join(totals, ["file", "stretch"]).select("file", "block", (F.col("base") + F.col("over")).alias("base"))
    names = files.select("file", "block", "docs").join(place, ["file", "block"])
    names = names.select("file", "base", F.posexplode("docs").alias("i", "doc_id"))
    names = names.select("file", (F.col("base") + F.col("i")).alias("document"), "doc_id")
    return counts.join(names, ["file", "document"]).select("doc_id", "file", "document", "n_tokens")
