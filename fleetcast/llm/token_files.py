"""Token ids as Arrow files of equal-length sequences.

A file holds one record batch of fixed-size lists: ``ids`` and ``mask``, sequence by sequence, the
last one padded (mask false). Documents follow each other in ascending id order, each ended by the
end id; they may run over the limit of a sequence, never over that of a file. A small Arrow stream
in the schema's metadata lists the documents with their token counts, so any document or sequence
is found and mapped without a copy.

Files are written by Spark's own committer (a row is a file), so any store that Spark reaches
will do, and a lost task leaves nothing behind.

A null text is empty: the end id alone. Null ids come first; rows of one id are ordered by a hash
of the text. An empty table gives no files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetcast.llm.frames import input_columns, measured_join
from fleetcast.llm.pieces import encoder
from fleetcast.llm.words import slices
from fleetcast.session import stage

SEQUENCE = 2048
FILE_TOKENS = 1 << 22
PARTITION_BYTES = 64 << 20

_MAGIC = "ARROW1"  # an Arrow file ends with it; the text sink writes it after each row


def _file(ids: np.ndarray, docs: pa.Table, part: int, number: int, length: int) -> bytes:
    rows = max(1, -(-len(ids) // length))
    padded = np.zeros(rows * length, ids.dtype)
    padded[: len(ids)] = ids
    mask = np.arange(rows * length) < len(ids)
    listed = pa.BufferOutputStream()
    with pa.ipc.new_stream(listed, docs.schema) as out:
        out.write_table(docs)
    facts = {"documents": listed.getvalue().to_pybytes(), "part": str(part), "file": str(number), "tokens": str(len(ids))}
    batch = pa.record_batch(
        {
            "ids": pa.FixedSizeListArray.from_arrays(pa.array(padded), length),
            "mask": pa.FixedSizeListArray.from_arrays(pa.array(mask), length),
        }
    ).replace_schema_metadata(facts)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def write_token_files(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    *,
    end_id: int,
    doc_id: str = "doc_id",
    text: str = "text",
    sequence: int = SEQUENCE,
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Encode whole texts and write the files in ascending ``doc_id`` order.

    Texts are range-partitioned by id once and go from the encoder into the files; a task holds
    one file at a time.
    """

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(vocabulary)
        part, number = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        held: list[pa.Table] = []
        size = 0

        def close() -> pa.RecordBatch:
            made = _file(np.concatenate(ids), pa.concat_tables(held).combine_chunks(), part, number, sequence)
            return pa.record_batch({"file": pa.array([made[: -len(_MAGIC)]], pa.binary())})

        for batch in batches:
            for piece in slices(batch, "text"):
                new, at = words.encode(piece.column("text"))
                ended = np.insert(new, at[1:], words.type(end_id))
                count = np.diff(at) + 1
                total = np.concatenate([[0], np.cumsum(count)])
                lo = 0
                while lo < len(count):  # whole documents up to the file's size, one at least
                    hi = int(np.searchsorted(total, total[lo] + max(0, file_tokens - size), side="right")) - 1
                    hi = max(hi, lo + (size == 0))
                    if hi > lo:
                        ids.append(ended[total[lo] : total[hi]])
                        held.append(pa.table({"doc_id": piece.column("doc_id")[lo:hi], "n_tokens": pa.array(count[lo:hi])}))
                        size += int(total[hi] - total[lo])
                    if hi < len(count):
                        yield close()
                        ids, held, size, number = [], [], 0, number + 1
                    lo = hi
        if held:
            yield close()

    plain = input_columns(docs, doc_id=doc_id, text=text)
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffled = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = plain.repartitionByRange(max(shuffled, -(-size // PARTITION_BYTES)), "doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", F.xxhash64("text"))
    made = ordered.mapInArrow(files, "file binary").select(F.col("file").cast("string").alias("file"))
    made.write.option("lineSep", _MAGIC).option("maxRecordsPerFile", 1).text(path)


@dataclass
class TokenFile:
    """A file mapped from its bytes; nothing is copied until a caller does."""

    ids: np.ndarray
    mask: pa.Array
    documents: pa.Table
    part: int
    number: int
    tokens: int
    sequence: int

    @classmethod
    def open(cls, content) -> TokenFile:
        batch = pa.ipc.open_file(pa.py_buffer(content)).get_batch(0)
        facts = batch.schema.metadata
        listed = pa.ipc.open_stream(facts[b"documents"]).read_all()
        ids = batch.column("ids")
        return cls(
            ids.values.to_numpy(), batch.column("mask"), listed, int(facts[b"part"]), int(facts[b"file"]), int(facts[b"tokens"]), ids.type.list_size
        )

    def sequence_at(self, row: int) -> np.ndarray:
        return self.ids[row * self.sequence : (row + 1) * self.sequence]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First token and token count of each document."""
        n = self.documents.column("n_tokens").to_numpy()
        return np.cumsum(n) - n, n


def read_token_index(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """One row per document: doc_id, start (tokens of all documents before it), n_tokens and ids_crc32
    (unsigned crc32 of its ids as little-endian unsigned 32-bit integers), all from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                if not len(content.as_buffer()):
                    continue
                f = TokenFile.open(content.as_buffer())
                first, n = f.spans()
                crc = [zlib.crc32(f.ids[a : a + k].astype("<u4")) for a, k in zip(first, n, strict=True)]
                ids = f.documents.column("doc_id").combine_chunks()
                yield pa.record_batch(
                    {
                        "part": pa.array([f.part] * len(n), pa.int32()),
                        "file": pa.array([f.number] * len(n), pa.int32()),
                        "doc_id": ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids,
                        "first": pa.array(first, pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    schema = f"part int, file int, doc_id {id_type}, first long, n_tokens long, ids_crc32 long"
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = stage(files.mapInArrow(documents, schema))
    # one row a file, then one row a part: neither grows with the documents in them
    sizes = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))
    offsets = sizes.withColumn("w", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "part")
    offsets = stage(offsets.select("part", "file", (F.col("p") + F.col("w")).alias("offset")))
    return measured_join(rows, offsets, ["part", "file"], "inner").select(
        "doc_id", (F.col("offset") + F.col("first")).alias("start"), "n_tokens", "ids_crc32"
    )
