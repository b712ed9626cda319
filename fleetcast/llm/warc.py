"""WARC archives with revisit records, and their index merged from sorted runs.

Records are written by Spark's text sink, whose line separator is the blank lines that end a record.
Each archive is a locally sorted capture run (url key, time, id). Reading an archive back gives its
index run; the runs are merged by a loser tree inside ranges of the key, which gives one global
order of captures without one task that sees them all.

Null payloads are empty. A null url has no target line and an empty key. Null ids are kept; they
never become the record that others revisit. Repeated rows are records of their own. An empty
table gives an empty index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcast.llm.frames import fold_ascii, measured_join
from fleetcast.operators.ordered import CHUNK, POS, with_index
from fleetcast.session import stage

# fixed values: the record format
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n\r\n"

_URN = "urn:fleetcast:page:"
#: payloads below this size are always written in full
REVISIT_BYTES = 1000
#: records of one archive, and index rows of one merged range
ARCHIVE_RECORDS = 8_192
RANGE_ROWS = 1 << 17

_INDEX = (
    "run string, url string, captured_at string, page_id long, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, offset long, length long"
)


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels from the right, then the rest; the scheme is dropped."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)^[^:/?#]*://", "")
    host = fold_ascii(F.regexp_extract(bare, r"(?s)^([^/?#]*)", 1))
    rest = F.regexp_extract(bare, r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(url.isNull(), "").otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    )


def with_revisits(pages: DataFrame, page_id: Column, payload: Column, least: int = REVISIT_BYTES) -> DataFrame:
    """``pages`` with _size, _sha1, _type and _first (the id that a revisit refers to).

    Of payloads of ``least`` bytes or more that are equal, the row with the largest id is the
    response. Only digests that occur more than once are joined back.
    """
    facts = pages.withColumns(
        {"_id": page_id, "_size": F.octet_length(payload).cast("long"), "_sha1": F.sha1(payload), "_sha2": F.sha2(payload, 256)}
    )
    many = facts.filter(F.col("_size") >= least).groupBy("_sha2")
    many = stage(many.agg(F.max("_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n"))
    joined = measured_join(facts, many, "_sha2", "left")
    revisit = (F.col("_size") >= least) & (F.coalesce(F.col("_id") != F.col("_first"), F.col("_id").isNull() & F.col("_first").isNotNull()))
    return joined.withColumn("_type", F.when(F.coalesce(revisit, F.lit(False)), "revisit").otherwise("response"))


def _record(url: Column, at: Column, payload: Column) -> Column:
    """A record without its closing blank lines."""
    revisit = F.col("_type") == "revisit"
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit(_END)
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_size"))
    target = F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c)
    head = F.concat_ws(
        "\r\n",
        F.lit(_VERSION),
        line("WARC-Type", F.col("_type")),
        line("WARC-Record-ID", urn(F.col("_id"))),
        line("WARC-Date", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_sha1"))),
        F.when(revisit, line("WARC-Profile", F.lit(_PROFILE))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("_first")))),
        F.lit("Content-Type: application/http;msgtype=response"),
        line("Content-Length", block.cast("string")),
    )
    return F.concat(head, F.lit(_END), http, F.when(revisit, "").otherwise(payload))


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", captured_at: Column) -> None:
    """Write one record per row; each archive is sorted by url key, time and id. Payloads are not shuffled."""
    payload = F.coalesce(F.col("_payload"), F.lit(""))
    rows = pages.select(
        F.col(page_id).cast("long").alias("_page"), F.col(url).alias("_url"), F.col(html).alias("_payload"), captured_at.alias("_at")
    )
    told = with_revisits(rows, F.col("_page"), payload)
    run = told.withColumn("_key", url_key(F.col("_url"))).sortWithinPartitions("_key", "_at", "_id")
    run.select(_record(F.col("_url"), F.col("_at"), payload).alias("record")).write.option("lineSep", _END).option(
        "maxRecordsPerFile", ARCHIVE_RECORDS
    ).text(path)


def parse_archive(content) -> Iterator[dict]:
    """Records of an archive, found by their lengths alone; payloads in full, with their place."""
    data = memoryview(content)
    at, size = 0, len(data)
    while at < size:
        head_end, step = -1, 1 << 12
        while head_end < 0:
            if step > 2 * (size - at) + (1 << 12):
                raise ValueError(f"broken record at {at}")
            head = bytes(data[at : at + step])
            head_end, step = head.find(b"\r\n\r\n"), step * 2
        lines = head[:head_end].decode().split("\r\n")
        if lines[0] != _VERSION:
            raise ValueError(f"no record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        begin = at + head_end + 4
        end = begin + int(fields["Content-Length"])
        block = bytes(data[begin:end])
        http_end = block.index(b"\r\n\r\n") + 4
        http = dict(x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:] if x)
        yield {"fields": fields, "http": http, "payload": block[http_end:], "offset": at, "length": end + 4 - at}
        if bytes(data[end : end + 4]) != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        at = end + 4


def _page(urn: str | None) -> int | None:
    number = urn[len(_URN) + 1 : -1] if urn else "none"
    return None if number == "none" else int(number)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index runs of all archives: one row per record, digests checked against the payloads read."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for r in parse_archive(content.as_buffer()):
                    f, full = r["fields"], r["fields"]["WARC-Type"] == "response"
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if full and hashlib.sha1(r["payload"]).hexdigest() != digest:
                        raise ValueError(f"payload at {r['offset']} of {name} does not match its digest")
                    rows.append(
                        {
                            "run": name,
                            "url": f.get("WARC-Target-URI"),
                            "captured_at": f.get("WARC-Date"),
                            "page_id": _page(f["WARC-Record-ID"]),
                            "record_type": f["WARC-Type"],
                            "refers_to": _page(f.get("WARC-Refers-To")),
                            "payload_bytes": len(r["payload"]) if full else int(r["http"]["Content-Length"]),
                            "payload_digest": digest,
                            "offset": r["offset"],
                            "length": r["length"],
                        }
                    )
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _arrow_schema())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(index, _INDEX)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _INDEX.split(", ")])


class LoserTree:
    """Merges sorted runs: each inner node keeps the run that lost there, so a step replays one path."""

    def __init__(self, runs: Sequence[Sequence[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads: list[tuple | None] = [next(r, None) for r in self.runs] or [None]
        self.loser = [-1] * self.k
        self.winner = 0
        for leaf in range(self.k - 1, -1, -1):
            self._seat(leaf)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and x is not None
        return (x, a) < (y, b)

    def _seat(self, leaf: int) -> None:
        """Play a new leaf up until a node has no opponent yet."""
        node, best = (leaf + self.k) // 2, leaf
        while node:
            if self.loser[node] < 0:
                self.loser[node] = best
                return
            if self._less(self.loser[node], best):
                self.loser[node], best = best, self.loser[node]
            node //= 2
        self.winner = best

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not None:
            yield head
            leaf = self.winner
            self.heads[leaf] = next(self.runs[leaf], None)
            node, best = (leaf + self.k) // 2, leaf
            while node:
                if self._less(self.loser[node], best):
                    self.loser[node], best = best, self.loser[node]
                node //= 2
            self.winner = best


def merge_index(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order (url_key, captured_at, page_id, run, offset) with its dense ``position``.

    Ranges of the whole key, so that a hot url is split too, hold about ``range_rows`` rows each; in
    a range the slices of the runs are merged by a loser tree.
    """
    keyed = index.withColumn("url_key", url_key(F.col("url")))
    order = ["url_key", "captured_at", "page_id", "run", "offset"]
    staged = stage(keyed)
    ranges = max(1, -(-staged.count() // range_rows))
    sliced = staged.repartitionByRange(ranges, *order).sortWithinPartitions("run", "url_key", "captured_at", "page_id", "offset")
    schema = sliced.schema

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [table.column(c).to_pylist() for c in order]
        runs: dict[str, list[tuple]] = {}
        for i, (key, at, page, run, offset) in enumerate(zip(*columns, strict=True)):
            runs.setdefault(run, []).append((key, at or "", page is not None, page or 0, run, offset, i))
        taken = pa.array([x[-1] for x in LoserTree(list(runs.values()))], pa.int64())
        yield from table.take(taken).combine_chunks().to_batches()

    merged = sliced.mapInArrow(merge, schema).withColumn("_mid", F.monotonically_increasing_id())
    placed = stage(
        merged.select("*", F.shiftright("_mid", 33).cast("int").alias(CHUNK), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)).alias(POS)).drop("_mid")
    )
    return with_index(placed).withColumnRenamed("_idx", "position").drop(CHUNK, POS)
