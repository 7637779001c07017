"""WARC archives: writing captures as record groups, and assembling transactions from archives.

Every capture becomes a request, a response (or a revisit of an equal payload) and a metadata record; the
request and the metadata name the response in WARC-Concurrent-To.  Reading parses all records of all
archives and joins those of one transaction through these identifiers into one nested row.
Records are compressed one by one (gzip members), as the format recommends.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import stored
from stanceframe.llm.token_files import open_fs
from stanceframe.session import scratch_path

MIN_SHARED = 100  # bytes from which equal payloads are stored once
SALT = 32  # ways that rows of one payload are spread over
DATE = "2024-01-01T00:00:00Z"  # the pages carry no time of capture
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed by the format


def response_id(page_id: int | None, digest: str, n: int = 0) -> str:
    """Record identifier of a page's response; ``n`` tells repeated rows of one archive apart."""
    raw = hashlib.md5(f"{page_id}:{digest}:{n}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=4)}>"


def with_originals(pages: DataFrame) -> DataFrame:
    """``pages`` with payload digest and, for repeats, the page whose payload they repeat (``original``).

    The smallest page of each payload is found by partial aggregation; the repeated payloads are then
    joined back in ``SALT`` copies, so that one payload on a third of all pages is not one task."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html"), F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    rows = rows.withColumn("digest", F.sha2(body, 256)).withColumn("_n", F.octet_length(body))
    shared = (rows.where(F.col("_n") >= MIN_SHARED).groupBy("digest")
              .agg(F.min("page_id").alias("original"), F.count("*").alias("_c")).where("_c > 1").select("digest", "original"))
    shared = stored(shared, "warc-shared").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = salted.join(shared, ["digest", "_salt"], "left")
    other = F.when(F.col("_n") >= MIN_SHARED, F.when(F.col("page_id") != F.col("original"), F.col("original")))
    return joined.select("page_id", "url", "html", "digest", other.alias("original"))


def record(kind: str, record_id: str, headers: list[tuple[str, str]], content: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(content)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return gzip.compress(head.encode() + content + b"\r\n\r\n", compresslevel=4, mtime=0)


def capture_records(page_id: int | None, url: str, html: str, digest: str, original: int | None, n: int) -> Iterator[bytes]:
    """The records of one capture, the response or revisit in the middle."""
    own = response_id(page_id, digest, n)
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    payload = html.encode("utf-8", "surrogatepass")
    request = f"GET {target or '/'} HTTP/1.1\r\n\r\n".encode()
    made = lambda part: f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{part}{own}'.encode()).digest(), version=4)}>"
    yield record("request", made("request"), [("WARC-Target-URI", target), ("WARC-Concurrent-To", own),
                                              ("Content-Type", "application/http;msgtype=request")], request)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", target), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", f"sha256:{digest}")]
    if original is None:
        yield record("response", own, common, head + payload)
    else:
        yield record("revisit", own, [*common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", response_id(original, digest))], head)
    fields = f"page-id: {'' if page_id is None else page_id}\r\npayload-length: {len(payload)}\r\n".encode()
    yield record("metadata", made("metadata"), [("WARC-Target-URI", target), ("WARC-Concurrent-To", own),
                                                ("Content-Type", "application/warc-fields")], fields)


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of all pages to a shared folder; returns the manifest (path, bytes).

    One archive per task and attempt; only successful attempts are in the manifest.  A null html is an
    empty payload; null ids and urls are written as empty, and a row without id is never a revisit;
    repeated rows are captures of their own (rows of the first id with a payload are all responses);
    extra columns are ignored; an empty table gives an empty manifest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, size, seen = None, "", 0, {}
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs, base = open_fs(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"pages-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    first = record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", [("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n")
                    out.write(first)
                    size += len(first)
                key = (row["page_id"], row["digest"])
                n = seen.get(key, 0)
                seen[key] = n + 1
                for raw in capture_records(row["page_id"], row["url"], row["html"], row["digest"], row["original"], n):
                    out.write(raw)
                    size += len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64())]))

    return stored(with_originals(pages).mapInArrow(run, "path string, bytes bigint"), "warc-manifest")


def parse_records(src) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, content) of every record of a compressed archive, a member at a time."""
    unzip, pending = zlib.decompressobj(wbits=31), b""
    whole = io.BytesIO()

    def split(raw: bytes) -> tuple[dict[str, str], bytes]:
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields.get("content-length", "0"))
        if len(rest) < size:
            raise ValueError("record is cut off")
        return fields, rest[:size]

    while True:
        if not pending:
            pending = src.read(1 << 20)
            if not pending:
                break
        whole.write(unzip.decompress(pending))
        pending = b""
        if unzip.eof:
            pending = unzip.unused_data
            yield split(whole.getvalue())
            unzip, whole = zlib.decompressobj(wbits=31), io.BytesIO()
    if whole.getvalue():
        raise ValueError("archive is cut off")


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives: file, type, record_id, concurrent_to, refers_to, target, digest,
    payload digest and length as found in the content, fields (of metadata), and the payload on request."""
    names = ["file", "type", "record_id", "concurrent_to", "refers_to", "target", "payload_digest", "found_digest", "found_bytes", "fields"]
    kinds = [pa.string()] * 8 + [pa.int64(), pa.map_(pa.string(), pa.string())]
    if with_payload:
        names, kinds = [*names, "payload"], [*kinds, pa.binary()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    ddl = ", ".join(f"{n} {'bigint' if n == 'found_bytes' else 'map<string,string>' if n == 'fields' else 'binary' if n == 'payload' else 'string'}"
                    for n in names)

    def row(file: str, head: dict[str, str], content: bytes) -> dict:
        kind = head.get("warc-type")
        out = {"file": file, "type": kind, "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"),
               "refers_to": head.get("warc-refers-to"), "target": head.get("warc-target-uri"),
               "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None}
        if kind == "response":
            payload = content.partition(b"\r\n\r\n")[2]
            out |= {"found_digest": hashlib.sha256(payload).hexdigest(), "found_bytes": len(payload)}
            if out["payload_digest"] not in (None, out["found_digest"]):
                raise ValueError(f"payload of {out['record_id']} does not match its digest")
            if with_payload:
                out["payload"] = payload
        elif kind == "metadata":
            lines = content.decode("utf-8", "replace").split("\r\n")
            out["fields"] = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines if x)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        for batch in batches:
            for f in batch.to_pylist():
                held, size = [], 0
                with fs.open_input_stream(f"{base}/{f['path']}", compression=None) as src:
                    for head, content in parse_records(src):
                        held.append(row(f["path"], head, content))
                        size += len(content) if with_payload else 300
                        if size > 4_000_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(n, "path").mapInArrow(run, ddl)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit) and metadata of one transaction.

    Records meet through (archive, identifier of the response): the response's own, the others'
    WARC-Concurrent-To.  Records without either, such as warcinfo, belong to no capture; a missing part
    is a null struct."""
    part = F.struct("record_id", "target", "refers_to", "payload_digest", "found_digest", "found_bytes", "fields",
                    *(["payload"] if "payload" in records.columns else []))
    kind = F.col("type")
    is_response = kind.isin("response", "revisit")
    rows = records.where(is_response | F.col("concurrent_to").isNotNull()).withColumn(
        "capture", F.when(is_response, F.col("record_id")).otherwise(F.col("concurrent_to")))
    # max_by keeps the one part of each kind; its struct goes through the shuffle, a map inside allows no max
    pick = lambda cond: F.max_by(F.when(cond, part), F.when(cond, F.col("record_id")))
    return rows.groupBy("file", "capture").agg(pick(kind == "request").alias("request"), pick(is_response).alias("response"),
                                               pick(kind == "metadata").alias("metadata"), F.max(F.when(is_response, kind)).alias("record_type"))


def captures(pages: DataFrame) -> DataFrame:
    """Write all pages as archives, read them back and return page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder = scratch_path(pages.sparkSession, "warc-files")
    done = stored(transactions(read_warc(write_warc(pages, folder), folder)), "warc-captures")
    page = F.col("metadata.fields")["page-id"].cast("bigint")
    rows = done.select(F.when(F.col("metadata.fields")["page-id"] != "", page).alias("page_id"), "record_type",
                       F.col("response.record_id").alias("record_id"), F.col("response.refers_to").alias("_to"),
                       F.col("response.payload_digest").alias("payload_digest"),
                       F.coalesce("response.found_bytes", F.col("metadata.fields")["payload-length"].cast("bigint")).alias("payload_bytes"),
                       F.col("request.target").alias("target"))
    wanted = rows.where("_to is not null").select(F.col("_to").alias("record_id")).distinct()
    named = (rows.where("record_type = 'response'").join(wanted, "record_id").groupBy("record_id").agg(F.min("page_id").alias("refers_to"))
             .select(F.col("record_id").alias("_to"), "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("_salt")))
    return (rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "target"), F.lit(SALT)).cast("int")).join(named, ["_to", "_salt"], "left")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
