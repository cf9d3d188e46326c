"""WARC archives: a writer on Spark's text sink, and a Python data source that reads them.

The writer makes one response record for each distinct payload, and revisit records (identical payload digest) for the rest.
Records end in two line ends, which is the sink's line separator here, so Spark writes the files to any store it can reach;
payloads are bytes and pass unchanged.

The reader plans partitions of whole files, takes predicates on header fields from Spark (equality and lists, also on the record
type), parses a record's headers first, and seeks over the payload of records that fail them, or of all with
``option("payload", "false")``.

Defined cases: a null payload is empty. A null url has no WARC-Target-URI; control characters and blanks of a url are percent-encoded.
A null id is an empty record name. Rows that repeat the response's id and payload are responses too. Payloads of a group whose ids are
all null are responses. An empty table gives archives without records.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .common import written

END = "\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FORMAT = "khata_warc"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
PARTITION_BYTES = 16 << 20
BATCH_BYTES = 4 << 20


def base32_sha1(payload: F.Column | str) -> F.Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits are four letters."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(ALPHABET), F.shiftright(value, 15 - 5 * j).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*letters)


def with_digests(records: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """``records`` (id, url, payload) with payload_bytes, payload_digest and first_id: the smallest id with the payload."""
    payload = F.coalesce(F.col("payload").cast("binary"), F.lit("").cast("binary"))
    marked = records.select("id", "url", payload.alias("payload")).withColumn("payload_digest", base32_sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # a table of its own: where few payloads repeat it is small, Spark broadcasts it, and no payload is shuffled
    repeated = marked.where(F.col("payload_bytes") >= min_revisit_bytes).groupBy("payload_digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = written(repeated.where("n > 1").drop("n"), "repeated-payloads")
    return marked.join(firsts, "payload_digest", "left")


def write_archives(records: DataFrame, path: str, min_revisit_bytes: int = 0, records_per_file: int = 50_000) -> None:
    """Write ``records`` (id, url, payload) below ``path``."""
    marked = with_digests(records, min_revisit_bytes)
    revisit = F.coalesce(F.col("id") != F.col("first_id"), F.col("id").isNull() & F.col("first_id").isNotNull())

    def name(c: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    def line(key: str, value: F.Column) -> F.Column:
        return F.concat(F.lit(f"{key}: "), value, F.lit(END))

    escaped = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}"), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(END))
    block = F.when(revisit, http.cast("binary")).otherwise(F.concat(http.cast("binary"), F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name("id")),
        F.coalesce(line("WARC-Target-URI", escaped), F.lit("")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", name("first_id")), F.lit(f"WARC-Profile: {PROFILE}{END}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}"), line("Content-Length", F.octet_length("block").cast("string")), F.lit(END))
    out = marked.withColumn("block", block).select(F.concat(head.cast("binary"), "block").cast("string").alias("value"))
    out.write.option("lineSep", END * 2).option("maxRecordsPerFile", records_per_file).text(path)


# --- the reader

@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]

    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths
        self.value = None


def _opened(uri: str) -> io.BufferedReader:
    store, path = fs.FileSystem.from_uri(uri)
    return open(path, "rb", buffering=1 << 18) if isinstance(store, fs.LocalFileSystem) else io.BufferedReader(store.open_input_file(path), 1 << 18)


def _headers(stream: io.BufferedReader) -> dict[str, str]:
    out: dict[str, str] = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        key, colon, value = line.partition(b":")
        if colon:
            out[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out


def parsed(stream: io.BufferedReader, wanted: dict[str, set], payloads: bool) -> Iterator[tuple]:
    """Rows of the records that meet ``wanted`` (column: values); nothing of other records' blocks is read."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {stream.tell() - len(line)}")
        head = _headers(stream)
        size = int(head["content-length"])
        fields = {c: head.get(h) for c, h in HEADERS.items()}
        if fields["payload_digest"]:
            fields["payload_digest"] = fields["payload_digest"].removeprefix("sha1:")
        if any(fields[c] not in values for c, values in wanted.items()):
            stream.seek(size, 1)
            continue
        start, length, body = stream.tell(), size, None
        if head.get("content-type", "").startswith("application/http"):
            stream.readline()
            declared = _headers(stream).get("content-length")
            left = start + size - stream.tell()
            length = int(declared) if fields["record_type"] == "revisit" and declared else left
        else:
            left = size
        if payloads:
            body = stream.read(left)
        stream.seek(start + size)
        yield (*fields.values(), length, body)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payloads = options["path"], options.get("payload", "true").lower() != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = fs.FileSystem.from_uri(self.path)
        scheme = re.match(r"[a-z0-9]+://[^/]*", self.path)
        prefix = scheme[0] if scheme and not isinstance(store, fs.LocalFileSystem) else ""
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((prefix + f.path, f.size) for f in found if f.is_file and f.size and not f.base_name.startswith(("_", ".")))
        out: list[InputPartition] = []
        held, size = [], 0
        for f in files:
            if held and size + f[1] > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append(f)
            size += f[1]
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        names = [*HEADERS, "payload_bytes", "payload"]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for path, _ in partition.paths:
            with _opened(path) as stream:
                for row in parsed(stream, self.wanted, self.payloads):
                    rows.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known, and let Spark hand predicates to Python data sources (off by default)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format(FORMAT).option("payload", str(payloads).lower()).load(path)
