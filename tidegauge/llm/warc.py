"""Zstandard web archives: one frame per record, the dictionary in a leading skippable frame.

``write_archives`` stores a table of pages; ``read_archives`` decodes archives frame by
frame and checks every record: version line, mandatory headers, the stated lengths of
block and payload, the end mark and the digest of the payload. A record that fails a
check becomes a row whose ``problem`` says why; a damaged frame ends its file with such a
row, since the next frame's place is unknown then.

Among pages with equal payloads of at least ``min_bytes`` bytes the smallest page_id is
stored in full, the others as revisit records without a body. A revisit keeps its HTTP
head, whose Content-Length is that of the full payload.

Defined results: a null html is an empty payload; a null url leaves out the target header
and reads back as null; control characters and blanks of a url are percent-encoded; null
page ids read back as null and are never the stored copy while another id has the
payload; rows that repeat the stored copy's page_id are responses too; extra columns are
ignored; an empty table writes no archive and reads as no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import files
from tidegauge.session import materialize, workspace

#: Magic numbers of the archive format: skippable dictionary frame, plain frame, dictionary.
DICTIONARY_FRAME, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
END = b"\r\n\r\n"
#: Dictionary training: so many pages, so many characters of each, so many bytes of dictionary.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 256, 16_384, 32_768
#: A task starts a new archive when the last one has so many bytes.
ARCHIVE_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"

RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary, problem string"
)


def train(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from a bounded sample of pages, those of the smallest hash; empty if there is too little text."""
    import zstandard

    picked = (
        pages.where(F.length("html") > 0).select(F.substring("html", 1, chars).alias("head"), F.xxhash64("page_id", "url").alias("h"))
        .orderBy("h").limit(sample).select("head").collect()
    )
    try:
        return zstandard.train_dictionary(size, [r.head.encode() for r in picked]).as_bytes() if picked else b""
    except zstandard.ZstdError:
        return b""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, own: str) -> bytes:
    """One record: headers, an HTTP head, the payload unless it is a revisit, the end mark."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{own}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _headers(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode().split("\r\n")
    pairs = (line.split(":", 1) for line in lines)
    return first, {k.strip().lower(): v.strip() for k, v in pairs}


def parse(data: bytes) -> tuple:
    """One row of RECORD."""
    row = dict.fromkeys(("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"))

    def out(problem: str | None) -> tuple:
        return (*row.values(), problem)

    try:
        text, mark, rest = data.partition(END)
        version, headers = _headers(text)
        if not mark or not version.startswith("WARC/1."):
            return out("no version line")
        if missing := [h for h in MANDATORY if h not in headers]:
            return out(f"no {missing[0]}")
        length = int(headers["content-length"])
        row |= {"page_id": _page(headers["warc-record-id"]), "url": headers.get("warc-target-uri"),
                "record_type": headers["warc-type"], "refers_to": _page(headers.get("warc-refers-to"))}
        if len(rest) != length + len(END) or not rest.endswith(END):
            return out(f"the block has {len(rest) - len(END)} bytes, its header says {length}")
        http, mark, payload = rest[:length].partition(END)
        status, inner = _headers(http)
        if not mark or not status.startswith("HTTP/"):
            return out("no HTTP head")
        size, named = int(inner.get("content-length", -1)), headers.get("warc-payload-digest", "").removeprefix("sha1:")
        row |= {"payload_bytes": size, "payload_digest": named}
        if row["record_type"] == "revisit":
            return out("a revisit with a payload" if payload else "a revisit of nothing" if row["refers_to"] is None else None)
        if row["record_type"] != "response":
            return out("unknown record type")
        row["payload"] = payload
        if size != len(payload):
            return out(f"the payload has {len(payload)} bytes, its header says {size}")
        return out(None if named == digest(payload) else "the payload does not match its digest")
    except (ValueError, UnicodeDecodeError) as error:
        return out(f"unreadable headers: {error}")


def records(source, chunk: int = 1 << 20) -> Iterator[tuple]:
    """Rows of one archive; holds one record and one chunk at a time."""
    import zstandard

    head = source.read(8)
    dictionary = None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        raw = source.read(struct.unpack("<I", head[4:])[0])
        if len(raw) >= 4 and struct.unpack("<I", raw[:4])[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary, data = zstandard.ZstdCompressionDict(raw), b""
    else:
        data = head
    machine = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    try:
        while data or (data := source.read(chunk)):
            frame, parts = machine.decompressobj(), []
            while True:
                parts.append(frame.decompress(data))
                if frame.eof:
                    data = frame.unused_data
                    break
                if not (data := source.read(chunk)):
                    yield (*[None] * 7, "the last frame is cut off")
                    return
            yield parse(b"".join(parts))
    except zstandard.ZstdError as error:
        yield (*[None] * 7, f"damaged frame: {error}")


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to``: the page whose equal payload is stored, null for that page itself."""
    body = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), F.sha1(F.encode(body, "UTF-8")).alias("sum"), F.octet_length(body).alias("size"))
    firsts = (
        keyed.where(F.col("size") >= min_bytes).groupBy("sum", "size")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sum", "size", "first")
    )
    # adaptive execution splits a payload that very many pages share
    return keyed.join(firsts, ["sum", "size"], "left").select(
        "page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write_archives(
    pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES, dictionary: bytes | None = None,
) -> DataFrame:
    """Writes the archives; returns the manifest: path, n_records, n_bytes."""
    trained = train(pages) if dictionary is None else dictionary

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        if trained:
            given = zstandard.ZstdCompressionDict(trained)
            machine = zstandard.ZstdCompressor(level=level, dict_data=given)
            packed = zstandard.ZstdCompressor(level=19).compress(trained)
            lead = struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed
        else:
            machine, lead = zstandard.ZstdCompressor(level=level), b""

        def frames():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for page, url, html, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                        payload = html.encode()
                        yield machine.compress(record(page, url, payload, refers, digest(payload)))

        rest = frames()
        frame = next(rest, None)
        while frame is not None:
            path, n, size = files.attempt_name(folder, ".warc.zst"), 0, len(lead)
            with files.writing(path) as out:
                out.write(lead)
                while frame is not None and size < archive_bytes:
                    out.write(frame)
                    n, size = n + 1, size + len(frame)
                    frame = next(rest, None)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    written = with_originals(pages, min_bytes).mapInArrow(run, "path string, n_records bigint, n_bytes bigint")
    return materialize(written, "manifest", f"{folder.rstrip('/')}/manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of all archives that the manifest lists."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def rows():
            for batch in batches:
                for path, expected in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist()):
                    n = 0
                    with files.reading(path) as source:
                        for n, row in enumerate(records(source), 1):
                            yield row
                    if n != expected:
                        yield (*[None] * 7, f"{path} has {n} records, the manifest says {expected}")

        held, size = [], 0
        for row in rows():
            if not payloads:
                row = (*row[:6], None, row[7])
            held.append(row)
            size += 200 + len(row[6] or b"")
            if size >= 4 << 20:
                yield batch_of(pa, held)
                held, size = [], 0
        if held:
            yield batch_of(pa, held)

    def batch_of(pa, held):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
        names = [c.split(" ")[0] for c in RECORD.split(", ")]
        return pa.RecordBatch.from_pydict({n: pa.array(v, k) for n, k, v in zip(names, kinds, zip(*held))})

    return manifest.select("path", "n_records").repartition(max(1, manifest.count())).mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = True) -> tuple[DataFrame, str]:
    """Writes and reads back; also the folder, which the caller discards when done."""
    folder = workspace(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, min_bytes), payloads), folder
