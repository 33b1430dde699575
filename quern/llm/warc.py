"""WARC archives: written with an index, read back by coalesced byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import marked, new_path, stored

#: Payloads of fewer bytes are always stored in full.
REVISIT_FROM = 100
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
#: A task starts a new archive beyond so many bytes. Reads cover records that start in the same RANGE bytes, and bridge
#: gaps of up to GAP bytes between them.
ARCHIVE_BYTES = 512 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of archives that are meant for one task to read.
TASK_BYTES = 64 << 20
INDEX = "archive string, offset long, length long, url string, digest string, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC 1.1 record as a gzip member. A revisit has the HTTP head only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": "".join(c if 32 < ord(c) != 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in url) if url else f"urn:page:{page_id}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "X-Page-ID": "" if page_id is None else str(page_id),
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        fields |= {
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To": record_id(refers_to, digest),
            "X-Refers-To-Page-ID": str(refers_to),
        }
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; a revisit's payload is empty."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def classified(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` of ``pages`` with ``digest`` and ``refers_to``.

    Only digests and ids meet in the aggregate that finds repeated digests. Pages whose digest is not among them, by a
    bitmap of bounded size that is broadcast, stay where they are; the others, and few more, are moved by one join,
    whose large groups Spark may split.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("digest", F.sha2(body, 256))
    large = rows.where(F.octet_length(body) >= REVISIT_FROM)
    first = large.groupBy("digest").agg(F.min("page_id").alias("_q_first"), F.count("*").alias("_q_n")).where("_q_n > 1 and _q_first is not null")
    first = stored(first.drop("_q_n"), "repeated")
    tested = marked(rows, F.xxhash64("digest"), first, F.xxhash64("digest"))
    joined = tested.where("_q_maybe").join(first, "digest", "left").withColumn("refers_to", F.expr("if(page_id <=> _q_first, null, _q_first)"))
    alone = tested.where("not _q_maybe").withColumn("refers_to", F.lit(None).cast("long"))
    names = ["page_id", "url", "html", "digest", "refers_to"]
    return alone.select(names).union(joined.select(names))


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for each row of ``pages`` to gzip archives below ``path`` and return the index table, ``archive,
    offset, length, url, digest, page_id``.

    Each task writes archives of its own name, so a task that runs again leaves an unused file at worst; the index
    names those of the attempts that Spark took, and files that it does not name are deleted at the end. Of equal
    payloads of REVISIT_FROM bytes or more, the one with the smallest page_id is a response and the others revisit it;
    rows that repeat this page_id are responses, too, as are copies whose page_ids are all null. A null html is an empty
    payload, a null url is named after the page. A payload of any length is one record, held by one task while it is
    written. An empty table writes no archive and an empty index. Columns other than page_id, url and html are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(f"{path}/archives")
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in batches:
                index = []
                for page_id, url, html, digest, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    member = record(page_id, url, (html or "").encode(), digest, refers)
                    out.write(member)
                    index.append((name, at, len(member), url, digest, page_id))
                    at += len(member)
                cols = list(zip(*index, strict=True)) or [[]] * 6
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["archive", "offset", "length", "url", "digest", "page_id"])
        finally:
            if out is not None:
                out.close()

    classified(pages).mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    index = pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")
    _drop_unnamed(index, path)
    return index


def _drop_unnamed(index: DataFrame, path: str) -> None:
    """Delete archives that the index does not name. The driver holds file names only, one for each 512 MB or task."""
    store, base = pafs.FileSystem.from_uri(f"{path}/archives")
    if store.get_file_info(base).type == pafs.FileType.Directory:
        named = {r[0] for r in index.select("archive").distinct().collect()}
        for f in store.get_file_info(pafs.FileSelector(base)):
            if f.base_name not in named:
                store.delete_file(f.path)


def coalesced(spans: list[tuple[int, int]], gap: int = GAP_BYTES) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) spans as reads ``(first, last, spans)``; gaps up to ``gap`` bytes are read along."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for at, length in spans:
        if reads and at - reads[-1][1] <= gap:
            first, last, own = reads[-1]
            own.append((at, length))
            reads[-1] = first, max(last, at + length), own
        else:
            reads.append((at, at + length, [(at, length)]))
    return reads


def read(selected: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records that ``selected``, rows of the index, points to; without ``payloads`` their texts stay behind.

    Selected records that start in the same RANGE_BYTES of an archive meet in one row of sorted spans and are read
    together; ranges are dealt to as many tasks as their bytes need. Length and digest are those of the payload as read; a revisit's are the ones its record states. A
    response whose payload does not have the digest it states fails the read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(f"{path}/archives")
        for b in batches:
            for archive, spans in zip(b.column("archive").to_pylist(), b.column("spans").to_pylist(), strict=True):
                with store.open_input_file(f"{base}/{archive}") as f:
                    for first, last, own in coalesced([(s["offset"], s["length"]) for s in spans]):
                        data = f.read_at(last - first, first)
                        yield batch([parsed(data[at - first : at - first + n]) for at, n in own])

    def batch(found: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
        rows = []
        for fields, payload in found:
            kind, stated = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
            size = int(fields["X-Payload-Length"])
            if kind == "response":
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if digest != stated:
                    raise OSError(f"record {fields['WARC-Record-ID']} is damaged")
            number = lambda k: int(v) if (v := fields.get(k)) else None
            rows.append((number("X-Page-ID"), fields["WARC-Target-URI"], kind, size, stated, number("X-Refers-To-Page-ID"), payload.decode() if payloads and kind == "response" else None))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    spans = selected.select("archive", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("_q_range"))
    spans = spans.repartition(tasks, "archive", "_q_range")
    ranges = spans.groupBy("archive", "_q_range").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("spans"))
    return ranges.select("archive", "spans").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives of all ``pages`` to the shared folder and read every record back, without payloads."""
    path = new_path(pages.sparkSession, "warc")
    return read(write(pages, path), path, payloads=False)
