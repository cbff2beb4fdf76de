"""WARC archives compressed with Zstandard: a writer, and a reader that checks everything it reads.

Format of an archive (``.warc.zst``): a skippable frame (magic 0x184D2A5D) holds the archive's dictionary, itself compressed or
plain; then every record is one frame that uses it. The reader loads the dictionary from the leading frame, decodes frame by frame,
and raises ``WarcError`` unless each frame is exactly one record with a known version line, the mandatory headers, a
Content-Length that matches the bytes there, CRLF CRLF after them, and digests that match the payload. Memory is one
record's, however large the archive.

Records of equal payloads: the one with the smallest page id is a response, the others revisit it, unless the payload is
shorter than 100 bytes. Digests are grouped with map-side aggregation. Those of at least one in HOT of all repeated rows, HOT digests at most, go back to the
pages by a broadcast, the others by a join in which the pages of the first ones lie scattered: no digest brings many pages into one task.

Archives are real files in the shared folder. A task writes each under a name of its own attempt and only names it in its
result; those results are saved before anything is read, so retries and lost executors leave stray files but no wrong ones.

Defined results: a null payload is empty; a null URL is written as ``urn:page:<id>``, and one of any length comes back; a null page id has no header and comes
back as null; of repeated rows with one id each has its own record, and copies of the smallest id are responses all; payloads that have no id at all are responses. An
empty table makes no archive and no rows. Columns besides those named are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the format.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = (b"warc-type", b"warc-record-id", b"warc-date", b"content-length")
TYPES = (b"warcinfo", b"response", b"revisit", b"resource", b"request", b"metadata", b"conversion", b"continuation")

#: Payloads shorter than this are always responses.
REVISIT_BYTES = 100
#: An archive is closed beyond this many uncompressed bytes.
ARCHIVE_BYTES = 16 << 20
#: Payloads that take at least one in so many of the repeated rows are joined by a broadcast.
HOT = 1000
DICTIONARY_BYTES, DICTIONARY_SAMPLE = 32 << 10, 4 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format."""


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha256: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    name = f"page:{page_id}" if page_id is not None else f"page:{sha256}"
    target = (url or f"urn:{name}").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{base64.b32encode(bytes.fromhex(sha256)).decode().rstrip('=')}"),
        *([("WARC-Page-ID", str(page_id))] if page_id is not None else []),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is None:
        body += payload
    else:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    lines += [("WARC-Block-Digest", f"sha256:{base64.b32encode(hashlib.sha256(body).digest()).decode().rstrip('=')}"), ("Content-Length", str(len(body)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + b"\r\n" + body + b"\r\n\r\n"


def train(samples: list[bytes]):
    """A dictionary for a few megabytes of records; plain content of the first ones where training finds too little."""
    import zstandard

    if sum(map(len, samples)) < 4 * DICTIONARY_BYTES or len(samples) < 16:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or VERSION + b"\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archive(out, records: Iterable[bytes], sample: list[bytes]) -> None:
    """Write the dictionary frame and one frame for each record."""
    import zstandard

    known = train(sample)
    held = zstandard.ZstdCompressor(level=LEVEL).compress(known.as_bytes())
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=True, write_content_size=True)
    for r in records:
        out.write(packer.compress(r))


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise WarcError("the archive ends within a frame")
    return got


def load_dictionary(f):
    """The dictionary from the leading skippable frame, or None if the archive has none; f is left behind it."""
    import zstandard

    head = f.read(4)
    if not head:
        return None
    if head == FRAME_MAGIC:
        f.seek(0)
        return None
    if len(head) < 4 or struct.unpack("<I", head)[0] != DICTIONARY_MAGIC:
        raise WarcError("the archive begins with neither a dictionary nor a record")
    data = _exactly(f, struct.unpack("<I", _exactly(f, 4))[0])
    if data[:4] == FRAME_MAGIC:
        try:
            data = zstandard.ZstdDecompressor().decompress(data, max_output_size=16 << 20)
        except zstandard.ZstdError as e:
            raise WarcError(f"the dictionary can't be read: {e}") from e
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def frames(f) -> Iterator[bytes]:
    """The content of each frame after the dictionary, one at a time."""
    import zstandard

    known = load_dictionary(f)
    opener = zstandard.ZstdDecompressor(dict_data=known) if known else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        rest = rest or f.read(1 << 20)
        if not rest:
            return
        if len(rest) < 4:
            rest += f.read(1 << 20)
        if rest[:4] != FRAME_MAGIC:
            raise WarcError("no frame where a record should begin")
        one, parts = opener.decompressobj(), []
        try:
            while not one.eof:
                if not rest and not (rest := f.read(1 << 20)):
                    raise WarcError("the archive ends within a frame")
                parts.append(one.decompress(rest))
                rest = one.unused_data if one.eof else b""
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        yield b"".join(parts)


def parse(data: bytes, most: int | None = None) -> tuple[dict[bytes, bytes], bytes]:
    """Headers (names in lower case) and block of the one record that a frame holds. For archives from elsewhere, most bounds the header block; the frame does at any rate."""
    end = data.find(b"\r\n\r\n", 0, most)
    if end < 0:
        raise WarcError("a record's headers don't end")
    first, *lines = data[:end].split(b"\r\n")
    if first not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"unknown version line {first[:40]!r}")
    headers: dict[bytes, bytes] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"malformed header {line[:60]!r}")
        if (key := name.lower()) in headers and key in MANDATORY:
            raise WarcError(f"repeated header {name!r}")
        headers[key] = value.strip()
    if missing := [m for m in MANDATORY if m not in headers]:
        raise WarcError(f"missing header {missing[0]!r}")
    if headers[b"warc-type"] not in TYPES:
        raise WarcError(f"unknown record type {headers[b'warc-type']!r}")
    length = headers[b"content-length"]
    if not length.isdigit():
        raise WarcError(f"malformed length {length!r}")
    n = int(length)
    block = data[end + 4 : end + 4 + n]
    if len(block) != n or data[end + 4 + n :] != b"\r\n\r\n":
        raise WarcError("a record's length does not match its frame")
    if (told := headers.get(b"warc-block-digest")) is not None and told != b"sha256:" + base64.b32encode(hashlib.sha256(block).digest()).rstrip(b"="):
        raise WarcError("a block does not match its digest")
    return headers, block


def _hex(digest: bytes) -> str:
    kind, _, value = digest.partition(b":")
    if kind != b"sha256":
        raise WarcError(f"unknown digest {kind!r}")
    return base64.b32decode(value + b"=" * (-len(value) % 8)).hex()


def read_pages(f, most: int | None = None) -> Iterator[tuple[int | None, int, str, str, int | None]]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, payloads checked."""
    for data in frames(f):
        headers, block = parse(data, most)
        head, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not head.startswith(b"HTTP/"):
            raise WarcError("a block is no HTTP message")
        try:
            page = int(headers[b"warc-page-id"]) if b"warc-page-id" in headers else None
            kind, told = headers[b"warc-type"].decode(), _hex(headers[b"warc-payload-digest"])
            length = int(headers[b"warc-payload-length"])
            to = int(headers[b"warc-refers-to-page-id"]) if kind == "revisit" else None
        except (KeyError, ValueError) as e:
            raise WarcError(f"missing or malformed header: {e}") from e
        if kind == "response":
            if len(payload) != length or hashlib.sha256(payload).hexdigest() != told:
                raise WarcError("a payload does not match its digest or length")
        elif payload:
            raise WarcError("a revisit has a payload")
        yield page, length, told, kind, to


def with_revisits(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload_digest and refers_to, null for responses."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select("page_id", "url", body.alias("html"), F.sha2(body.cast("binary"), 256).alias("payload_digest"), F.octet_length(body).alias("bytes"))
    first = keyed.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL")
    first = common.saved(first.select(F.col("payload_digest").alias("_d"), "first", "n"), "warc-repeated")
    repeated = first.agg(F.sum("n")).first()[0] or 0
    hot = first.filter(F.col("n") * HOT >= repeated).select(F.col("_d").alias("_h"), F.col("first").alias("_hot"))  # HOT rows at most, since all n add up to repeated
    cold = first.filter(F.col("n") * HOT < repeated).select("_d", "first")
    marked = keyed.join(F.broadcast(hot), F.col("payload_digest") == F.col("_h"), "left")
    # Pages of hot digests match nothing in the second join and lie scattered there.
    key = F.when(F.col("_hot").isNull(), F.col("payload_digest")).otherwise(F.concat(F.lit("hot-"), F.xxhash64("page_id", "url").cast("string")))
    both = marked.withColumn("_key", key).join(cold, F.col("_key") == F.col("_d"), "left").withColumn("first", F.coalesce("_hot", "first"))
    return both.select("page_id", "url", "html", "payload_digest", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write pages (page_id, url, html) as archives into a shared folder; returns the saved manifest (archive, records)."""
    common.ship(pages.sparkSession)

    def run(batches):
        fs, root = common.filesystem(folder)
        fs.create_dir(root, recursive=True)
        held, size = [], 0

        def close():
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                sample, n = [], 0
                for r in held:
                    sample.append(r[: 64 << 10])
                    if (n := n + len(sample[-1])) > DICTIONARY_SAMPLE:
                        break
                write_archive(out, held, sample)
            made = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["archive", "records"])
            held.clear()
            return made

        for b in batches:
            for page, url, html, sha, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page, url, html.encode(), to, sha))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    size = 0
        if held:
            yield close()

    return common.saved(with_revisits(pages).mapInArrow(run, "archive string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives in a manifest."""
    common.ship(manifest.sparkSession)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        fs, root = common.filesystem(folder)
        for b in batches:
            for name, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    rows = list(read_pages(io.BufferedReader(f, 1 << 20)))
                if len(rows) != records:
                    raise WarcError(f"{name} has {len(rows)} records instead of {records}")
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    dealt = manifest.select("archive", "records").repartition(4 * common.partitions(manifest.sparkSession))
    return dealt.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages into the folder and read them back."""
    return read_archives(write_archives(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html"), folder), folder)
