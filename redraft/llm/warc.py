"""WARC derivative builder (operator 5).

Takes one row per response and gives two derived records for each: a metadata
record and a plain-text conversion record.  Both refer to the response's
WARC-Record-ID, keep its target URI and date, and carry digests of their own
blocks; the metadata block repeats the source's headers and digests and names
the conversion, so that the three records are linked both ways.

Records are made with DataFrame functions only; tasks write them as files with a gzip
member for each record.  Time is in proportion to a page's length, whatever it holds:
what opens an element that is never closed is set aside before the patterns run.

Results for odd input: a null or empty body is an
empty payload, its conversion an empty block; null headers and URIs are empty;
a response without a record id is left out; responses that share a record id
are handled row by row; numbers of characters that do not exist stay as they are.
An empty table gives no records.
"""

from __future__ import annotations

import gzip
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Named characters that are resolved (fixed values of HTML), the ampersand last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
#: Elements whose content is not text, and elements that end a line.
UNSEEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<head[^>]*>.*?</head>"
BREAKS = r"(?i)<(br|/p|/div|/h[1-6]|/li|/tr|/title|/article|/section|/nav|/footer|/header)[^>]*>"


#: Stands for the bracket of an opening that is set aside; no character has this number.
ASIDE = "\ufdd0"
#: What opens and closes the elements of UNSEEN, and whether the opening ends with a bracket of its own.
PAIRS = (("script", "</script>", True), ("style", "</style>", True), ("!--", "-->", False), ("head", "</head>", True))


#: Characters of a page from which on openings are set aside; shorter ones take no time worth saving.
LONG_PAGE = 10_000


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often body uses it."""
    return F.get(F.transform(F.array(x), body), 0)


def _to_end(x: Column, start: Column) -> Column:
    return F.substring(x, start, F.length(x))


def _set_aside(x: Column, opening: str, closing: str, bracket: bool) -> Column:
    """The text with the openings marked behind which nothing closes them, so that no pattern starts there in vain."""
    head = lambda x: F.regexp_extract(x, rf"(?is)\A(.*){closing}", 1)
    closed = (lambda x: F.regexp_extract(head(x), r"(?s)\A(.*>)", 1)) if bracket else head
    return _let(x, lambda x: _let(closed(x), lambda h: F.concat(h, F.regexp_replace(_to_end(x, F.length(h) + 1), rf"(?i)<(?={opening})", ASIDE))))


def _closed_only(html: Column) -> Column:
    x = html
    for pair in PAIRS:
        x = _set_aside(x, *pair)
    return x


def _without_tags(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, BREAKS, "\n"), r"<[^>]*>", " ")


def _tags_of_long(x: Column) -> Column:
    """_without_tags of a long text: behind its last bracket there are no tags to look for."""
    return _let(F.regexp_extract(x, r"(?s)\A(.*>)", 1), lambda h: F.concat(_without_tags(h), _to_end(x, F.length(h) + 1)))


def _characters(x: Column) -> Column:
    """Numbered characters resolved."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))

    def resolve(text: Column, entity: Column) -> Column:
        digits = F.regexp_extract(entity, "([0-9a-fA-F]+);", 1)
        number = F.when(F.lower(entity).startswith("&#x"), F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        known = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return F.when(known, F.replace(text, entity, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))).otherwise(text)

    return F.when(F.contains(x, F.lit("&#")), F.aggregate(found, x, resolve)).otherwise(x)


def plain_text(html: Column) -> Column:
    """Readable text of a page: unseen elements go, block ends break lines, tags go, named and numbered characters are resolved, blank runs and empty lines are folded."""
    long = F.length(html) > LONG_PAGE
    x = F.when(long, F.replace(F.regexp_replace(_closed_only(html), UNSEEN, " "), F.lit(ASIDE), F.lit("<"))).otherwise(F.regexp_replace(html, UNSEEN, " "))
    x = F.regexp_replace(x, r"[ \t\r\n\f]+", " ")
    x = _let(x, lambda x: F.when(F.length(x) > LONG_PAGE, _tags_of_long(x)).otherwise(_without_tags(x)))
    for name, char in ENTITIES[:-1]:
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.replace(_let(x, _characters), F.lit(ENTITIES[-1][0]), F.lit(ENTITIES[-1][1]))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?\n[ \n]*", "\n")
    return F.trim(x, F.lit(" \n"))


def digest(x: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.encode(x, "UTF-8"), 256))


def urn(*parts: Column | str) -> Column:
    """A name-based urn:uuid: the first 128 bits of the SHA-256 of the parts, so a rerun gives the same identifiers."""
    h = F.sha2(F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts]), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses_of_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Responses (row_id, record_id, target_uri, date, http_headers, body) of a table of pages; record ids are named after id and URL."""
    url, body = F.coalesce(F.col(url_col).cast("string"), F.lit("")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("row_id"), url.alias("target_uri"), body.alias("body"))
    return rows.select(
        "row_id",
        urn("response", F.col("row_id").cast("string"), F.col("target_uri")).alias("record_id"),
        "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length("body").cast("string"), F.lit(CRLF)).alias("http_headers"),
        "body",
    )


def _record(kind: str, block: Column, block_digest: Column, content_type: str, record_id: Column) -> Column:
    """The fields of one derived record and its serialised form."""
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: "),
        record_id,
        F.lit(f"{CRLF}WARC-Refers-To: "),
        F.col("record_id"),
        F.lit(f"{CRLF}WARC-Target-URI: "),
        F.col("target_uri"),
        F.lit(f"{CRLF}WARC-Date: "),
        F.col("date"),
        F.lit(f"{CRLF}WARC-Block-Digest: "),
        block_digest,
        F.lit(f"{CRLF}Content-Type: {content_type}{CRLF}Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.struct(
        F.lit(kind).alias("warc_type"),
        record_id.alias("derived_id"),
        F.lit(content_type).alias("content_type"),
        block_digest.alias("block_digest"),
        F.octet_length(block).cast("long").alias("content_length"),
        block.alias("block"),
        F.concat(header, block, F.lit(CRLF + CRLF)).alias("record"),
    )


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows for each response: row_id, refers_to, target_uri, date, source_digest, warc_type, derived_id, content_type, block_digest, content_length, block, record (the serialised record)."""
    empty = F.lit("")
    rows = responses.where("record_id is not null").select(
        "row_id", "record_id", *[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("target_uri", "date", "http_headers", "body")]
    )
    rows = rows.select("*", digest(F.col("body")).alias("source_digest"), plain_text(F.col("body")).alias("plain"))
    # what the records use more than once is a column, as an explode computes each mention anew
    rows = rows.select("*", digest(F.col("plain")).alias("plain_digest"), urn("metadata", F.col("record_id")).alias("metadata_id"), urn("conversion", F.col("record_id")).alias("conversion_id"))
    fields = F.concat(
        F.lit("source-payload-digest: "),
        F.col("source_digest"),
        F.lit(CRLF + "source-payload-length: "),
        F.octet_length("body").cast("string"),
        F.lit(CRLF + "conversion: "),
        F.col("conversion_id"),
        F.lit(CRLF + "conversion-digest: "),
        F.col("plain_digest"),
        F.lit(CRLF + "source-http-headers:" + CRLF),
        F.col("http_headers"),
    )
    rows = rows.select("*", fields.alias("fields"))
    rows = rows.select("*", digest(F.col("fields")).alias("fields_digest"))
    metadata = _record("metadata", F.col("fields"), F.col("fields_digest"), "application/warc-fields", F.col("metadata_id"))
    conversion = _record("conversion", F.col("plain"), F.col("plain_digest"), "text/plain; charset=utf-8", F.col("conversion_id"))
    both = rows.select(
        "row_id",
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "source_digest",
        F.explode(F.array(metadata, conversion)).alias("r"),
    )
    return both.select("row_id", "refers_to", "target_uri", "date", "source_digest", "r.*")


#: Bytes of a file of records before the next is begun.
FILE_BYTES = 256 << 20


def write_records(derived: DataFrame, path: str) -> DataFrame:
    """Write the records to files of a folder that driver and executors share, a gzip member for each record, and return (file, n_records, n_bytes).

    Every attempt of a task writes to files of its own in a folder for unfinished ones; those of the attempt that counts are moved when all tasks are done, so lost executors leave nothing behind.
    """
    from pyarrow.fs import FileSystem

    spark, unfinished = derived.sparkSession, f"{path.rstrip('/')}/_unfinished-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = FileSystem.from_uri(unfinished)
        done, out = [], None
        for batch in batches:
            for record in batch["record"].to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((name, n, size))
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = gzip.compress(record.encode(), 6, mtime=0)
                out.write(member)
                n, size = n + 1, size + len(member)
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.RecordBatch.from_pydict({"file": pa.array([d[0] for d in done], pa.string()), "n_records": pa.array([d[1] for d in done], pa.int64()), "n_bytes": pa.array([d[2] for d in done], pa.int64())})

    store, base = FileSystem.from_uri(unfinished)
    store.create_dir(base, recursive=True)
    rows = derived.select("record").mapInArrow(write, "file string, n_records long, n_bytes long").collect()  # a row for each file
    for r in rows:
        store.move(f"{base}/{r['file']}", f"{base.rsplit('/', 1)[0]}/{r['file']}")
    store.delete_dir(base)
    return spark.createDataFrame([tuple(r) for r in rows], "file string, n_records long, n_bytes long")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block, of a serialised record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(re.findall(r"^([^:\r\n]+): ?([^\r\n]*)", head.decode(), re.MULTILINE))
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, block[: int(fields["content-length"])]


def members(data: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members, each fed in slices that grow with it, so that time is in proportion to the file."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts, size = zlib.decompressobj(wbits=31), [], 4096
        while not member.eof:
            piece = view[at : at + size]
            if not piece:
                raise ValueError("the last member of a gzip file has no end")
            parts.append(member.decompress(piece))
            at, size = at + len(piece), min(2 * size, 1 << 20)
        at -= len(member.unused_data)
        yield b"".join(parts)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, warc_type, record_id, refers_to, target_uri, block_digest, content_length, block) of the files of write_records, read member by member."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-block-digest", "content-length")
        for batch in batches:
            for file, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                records = map(parse_record, members(data))
                while some := list(islice(records, 1000)):
                    rows = [(file, *[fields.get(n) for n in names[:-1]], int(fields["content-length"]), block) for fields, block in some]
                    kinds = [*[pa.string()] * 6, pa.int64(), pa.binary()]
                    columns = ["file", "warc_type", "record_id", "refers_to", "target_uri", "block_digest", "content_length", "block"]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", "content")
    return files.mapInArrow(read, "file string, warc_type string, record_id string, refers_to string, target_uri string, block_digest string, content_length long, block binary")
