"""WARC: archives of web pages, written, and read again past damage.

An archive is a row (archive, content) of a table, or a file that Spark's
binaryFile source reads. It holds records, each as a gzip member of its own or
plain. A reader that finds a record broken looks for the next valid member or version
line, goes on there, and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spread, text_bytes

GZIP, END = b"\x1f\x8b\x08", b"\r\n\r\n"
#: A record without one of these headers is broken.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
_START = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: So many digests of repeated payloads are broadcast; with more, the pages are shuffled by digest.
FEW = 200_000


class Broken(ValueError):
    """Why a place holds no valid record."""


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A plain record; headers without a value are left out, and line ends in values become their percent codes."""
    named = [*headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    lines = [f"{k}: {v.replace('%', '%25') if any(c in v for c in _ENDS) else v}".translate(_CODES) for k, v in named if v is not None]
    return b"WARC/1.1\r\n" + "\r\n".join(lines).encode() + END + block + END


_ENDS = "\r\n\0"
_CODES = {ord(c): f"%{ord(c):02X}" for c in _ENDS}


def member(data: bytes) -> bytes:
    """A gzip member without name or time, so that equal records have equal bytes."""
    work = zlib.compressobj(6, zlib.DEFLATED, 31)
    return work.compress(data) + work.flush()


def write(pages: DataFrame, id_col: str = "page_id", col: str = "html", url: str = "url", least: int = 100, size: int = 4 << 20, date: str = "1970-01-01T00:00:00Z", packed: bool = True) -> DataFrame:
    """(archive, content): every page as a record of a WARC archive of about `size` bytes.

    The payload is the text's UTF-8 (null: empty) below an HTTP head. Of pages with equal
    payloads of at least `least` bytes, that with the smallest id is a response and the others
    revisit it; all others are responses. Rows that repeat the smallest id are all responses, and a null
    id is never the smallest. Null addresses are left out; line ends in addresses become percent codes. An empty table gives
    no archive. Only the three columns named are read. A task holds one archive and one batch of
    pages. Names of archives follow Spark's partitions.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), text_bytes(col).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.groupBy("digest").agg(F.min(F.when(F.octet_length("payload") >= least, F.col("page_id"))).alias("first_id"), F.count("*").alias("n_rows"))
    shared = groups.filter("n_rows > 1 and first_id is not null")
    if len(shared.limit(FEW + 1).select(F.lit(1)).take(FEW + 1)) <= FEW:
        told = rows.join(F.broadcast(shared.select("digest", "first_id")), "digest", "left")
    else:
        told = spread(rows, groups.select("digest", "first_id"), ["digest"], groups, by=["page_id", "url"])
    other = ~F.col("first_id").eqNullSafe(F.col("page_id"))
    told = told.select("page_id", "url", "digest", F.when(other, F.col("first_id")).alias("refers_to"), "payload")

    def work(batches):
        import pyarrow as pa

        put = member if packed else bytes
        part, ending, made, held, total = TaskContext.get().partitionId(), ".warc.gz" if packed else ".warc", 0, [], 0

        def close():
            return pa.RecordBatch.from_pydict({"archive": [f"pages-{part:06d}-{made:06d}{ending}"], "content": [b"".join(held)]})

        for batch in batches:
            for i in range(batch.num_rows):
                page, at, digest, to, payload = (batch.column(c)[i].as_py() for c in range(5))
                if not held:
                    held.append(put(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{part}:{made}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                own = [("WARC-Type", "response" if to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", date), ("WARC-Target-URI", at), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + END
                if to is None:
                    head += payload
                else:
                    own += [("WARC-Refers-To", f"<urn:page:{to}>"), ("WARC-Profile", _PROFILE)]
                held.append(put(record(own, head)))
                total += len(held[-1])
                if total >= size:
                    yield close()
                    made, held, total = made + 1, [], 0
        if held:
            yield close()

    return told.mapInArrow(work, "archive string, content binary")


def page_id(col: str) -> Column:
    """The page's id in a record id of write(); else null."""
    return F.expr(f"try_cast(regexp_extract({col}, '^<urn:page:(-?[0-9]+)>$', 1) as bigint)")


def _digest_of(value: str, data) -> bool:
    """Whether a labelled digest is that of data; one of an unknown kind counts as right."""
    kind, _, told = value.strip().partition(":")
    kind = kind.lower().replace("-", "")
    if kind not in ("sha1", "sha256", "md5", "sha512"):
        return True
    own = hashlib.new(kind, data)
    return told.lower() == own.hexdigest() or told.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def _plain(data, at: int, most: int) -> tuple[dict[str, str], int, int, int]:
    """Headers of the plain record at `at`, where its block begins and ends, and where the record ends."""
    start = _START.match(data, at)
    if not start or data[at : at + 1] != b"W":
        raise Broken("no version line")
    head = data.find(END, at)
    if head < 0:
        raise Broken("headers without an end")
    headers: dict[str, str] = {}
    name = ""
    for line in data[start.end() : head].split(b"\r\n") if head >= start.end() else []:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:  # a header goes on
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon or not name:
            raise Broken("a header line without a name")
        headers[name] = value.strip()
    for name in MANDATORY:
        if not headers.get(name):
            raise Broken(f"no {name}")
    length = headers["content-length"]
    if not (length.isascii() and length.isdigit()):
        raise Broken("content-length is no number")
    first = head + len(END)
    last = first + int(length)
    if last + len(END) > most or data[last : last + len(END)] != END:
        raise Broken("the record does not end where its length says")
    return headers, first, last, last + len(END)


def _checked(headers: dict[str, str], block: memoryview) -> memoryview:
    """The payload of a block whose digests are right."""
    if "warc-block-digest" in headers and not _digest_of(headers["warc-block-digest"], block):
        raise Broken("block digest differs")
    payload = block
    if headers.get("content-type", "").lower().startswith("application/http"):
        cut = bytes(block[: 1 << 16]).find(END)
        if cut < 0:
            cut = bytes(block).find(END)
        payload = block[cut + len(END) :] if cut >= 0 else block[len(block) :]
    if headers["warc-type"] != "revisit" and "warc-payload-digest" in headers and not _digest_of(headers["warc-payload-digest"], payload):
        raise Broken("payload digest differs")
    return payload


def _unpacked(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int]:
    """Content of the gzip member at `at`, its checksum verified, and where it ends."""
    work, out, view, here = zlib.decompressobj(31), [], memoryview(data), at
    try:
        while not work.eof and here < len(data):
            out.append(work.decompress(view[here : here + step]))
            here += step
    except zlib.error as e:
        raise Broken("the gzip member is damaged") from e
    if not work.eof:
        raise Broken("the gzip member is cut off")
    return b"".join(out), min(here, len(data)) - len(work.unused_data)


def salvage(data: bytes):
    """All valid records of an archive, in order, and the gaps between.

    Yields (start, end, headers, payload, None), or (start, end, None, None,
    reason) for a gap; together they cover every byte once. A packed record is one gzip member
    with nothing else in it. What is checked: the member's checksum, the version line, mandatory headers, the
    length and the end mark, and block and payload digests where the record has them. After a failed
    check the search goes on at the next byte, so that a valid record is lost only if its own bytes are damaged.
    """
    at, lost, reason = 0, None, ""
    while at < len(data):
        try:
            if data.startswith(GZIP, at):
                plain, end = _unpacked(data, at)
                headers, first, last, over = _plain(plain, 0, len(plain))
                if over != len(plain):
                    raise Broken("the gzip member holds more than a record")
                payload = _checked(headers, memoryview(plain)[first:last])
            else:
                headers, first, last, end = _plain(data, at, len(data))
                payload = _checked(headers, memoryview(data)[first:last])
        except Broken as e:
            if lost is None:
                lost, reason = at, str(e)
            found = _START.search(data, at + 1)
            at = found.start() if found else len(data)
            continue
        if lost is not None:
            yield lost, at, None, None, reason
            lost = None
        yield at, end, headers, payload, None
        at = end
    if lost is not None:
        yield lost, len(data), None, None, reason


FIELDS = "archive string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, gap string"


def read(archives: DataFrame, name: str = "archive", col: str = "content", payload: bool = True) -> DataFrame:
    """One row for each record and each gap of the archives, with the byte range it has in its archive.

    payload_bytes and payload_digest (SHA-256) are of the bytes that were read; a
    revisit has none until resolve(). In a gap's row all but archive,
    offset, length and gap (the reason of the first failed check) are null. Null and empty archives have no rows,
    repeated ones repeat theirs. payload adds the record's payload. One batch of archives is in memory at a time. Files:
    spark.read.format("binaryFile").load(folder), with name="path".
    """

    def work(batches):
        import pyarrow as pa

        def rows(held):
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        text, number = pa.string(), pa.int64()
        types = [text, number, number, text, text, text, text, number, text, text, *[pa.binary()] * payload]
        names = [f.split()[0] for f in FIELDS.split(", ")] + ["payload"] * payload
        for batch in batches:
            held, total = [], 0
            for i in range(batch.num_rows):
                label, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for start, end, headers, body, why in salvage(data or b""):
                    if headers is None:
                        row = [label, start, end - start, *[None] * 6, why]
                    else:
                        own = (None, None) if headers["warc-type"] == "revisit" else (len(body), hashlib.sha256(body).hexdigest())
                        row = [label, start, end - start, headers["warc-type"], headers["warc-record-id"], headers.get("warc-target-uri"), headers.get("warc-refers-to"), *own, None]
                    held.append(row + [bytes(body) if body is not None else None] * payload)
                    total += len(body) if payload and body is not None else 200
                    if total > 1 << 24:
                        yield rows(held)
                        held, total = [], 0
            if held:
                yield rows(held)

    return archives.select(F.col(name).cast("string"), F.col(col)).mapInArrow(work, FIELDS + ", payload binary" * payload)


def resolve(records: DataFrame) -> DataFrame:
    """records with payload_bytes and payload_digest of revisits taken from the record that they refer to.

    Nulls stay where that record is not among these, or is null. Where several have its id, the
    smallest digest counts. A record that a third of all revisit is dealt over several tasks.
    """
    visits = records.filter("record_type = 'revisit' and refers_to is not null")
    rest = records.filter("not coalesce(record_type = 'revisit' and refers_to is not null, false)")
    asked = visits.groupBy("refers_to").agg(F.count("*").alias("n_rows"))
    held = records.filter("record_type <> 'revisit' and record_id is not null")
    # the ids that are asked for and what is known of them meet in one sum by id
    both = held.select(F.col("record_id").alias("refers_to"), F.struct("payload_digest", "payload_bytes").alias("known"), F.lit(0).cast("long").alias("n_rows"))
    both = both.unionByName(asked.select("refers_to", F.lit(None).cast(both.schema["known"].dataType).alias("known"), "n_rows"))
    table = both.groupBy("refers_to").agg(F.min("known").alias("known"), F.sum("n_rows").alias("n_rows")).filter("n_rows > 0")
    bare = visits.drop("payload_bytes", "payload_digest")
    found = spread(bare, table.select("refers_to", "known"), ["refers_to"], table, by=["archive", "offset"])
    return rest.unionByName(found.select(*bare.columns, "known.payload_bytes", "known.payload_digest"))
