"""WARC derivatives: metadata and plain-text conversion records of responses.

Each response gives two records. `metadata` (application/warc-fields) holds what the response said of itself: the HTTP
status and headers, title, language, description and links out. `conversion` (text/plain) holds the text. Both carry

    WARC-Refers-To                  the response's record id
    WARC-Refers-To-Target-URI, WARC-Refers-To-Date
    WARC-Source-Block-Digest, WARC-Source-Payload-Digest   as the response had them
    WARC-Block-Digest               of their own block

and each names the other in WARC-Concurrent-To. Ids are made from the response's id and the kind, so a task that runs again
makes the same records. A digest that the response lacks is computed; one that is wrong is kept and noted in the
metadata record. Reading of markup is in linear time whatever the input: unclosed tags, comments and scripts end the text.

A body is taken out of its chunks and its compression (gzip, deflate, zstd) first; digests are those of the body as it was sent. A type
that isn't text, and a compression that can't be undone or grows beyond `MOST_BYTES`, give the metadata record alone, with a note.
A damaged record or file member is passed over up to the next one that begins on a line of its own, and the bytes passed over
are told.

Results: a page with null html has an empty body; a null url is the empty URI; repeated rows give records each, with ids of their own
(made from their place in the table); a record that isn't a response is passed over; a response that isn't HTTP is all body. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small_batches

Headers = list[tuple[str, str]]
_NEWLINE = b"\r\n"
#: A body that is larger once its compression is undone isn't read.
MOST_BYTES = 256 << 20


def digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(0).join(parts))}>"


def serialised(headers: Headers, block: bytes) -> bytes:
    """One record; Content-Length is set here."""
    lines = [f"{k}: {_line(v)}" for k, v in headers if k.lower() != "content-length"]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + 2 * _NEWLINE + block + 2 * _NEWLINE


def _line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def _fields(head: bytes) -> Headers:
    out: Headers = []
    for line in head.decode("utf-8", "replace").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def get(headers: Headers, name: str, default: str = "") -> str:
    return next((v for k, v in headers if k.lower() == name.lower()), default)


_START = re.compile(rb"(?:\A|\n)(?=WARC/\d)")
_STEP = 1 << 20


def records(stream: BinaryIO) -> Iterator[tuple[int, Headers, bytes]]:
    """(bytes passed over before it, headers, block) of each record; at the end a last one without headers if bytes are left over.

    Only one record and what was read ahead are held. Where a record has no whole head or no usable length, or neither its end mark nor
    another record's head follows its block, reading goes on at the next line that begins like a record.
    """
    held, over, ended = b"", 0, False

    def more() -> bool:
        nonlocal held, ended
        part = b"" if ended else stream.read(max(_STEP, len(held)))
        held, ended = held + part, not part
        return not ended

    def passed(n: int) -> None:
        nonlocal held, over
        over += len(held[:n].strip(b"\r\n"))
        held = held[n:]

    while held or more():
        start = _START.search(held)
        if not start:
            passed(max(0, len(held) - 8))  # what may be the beginning of a head stays
            if not more():
                passed(len(held))
            continue
        passed(start.end())
        while (end := held.find(b"\r\n\r\n")) < 0 and len(held) < _STEP and more():
            pass
        whole = end >= 0 and not _START.search(held, 5, end)
        headers = _fields(held[held.find(b"\n") + 1 : end]) if whole else []
        size = get(headers, "Content-Length")
        if not size.isdigit():
            passed(5)
            continue
        to = end + 4 + int(size)
        while len(held) < to + 9 and more():
            pass
        after = held[to : to + 9]
        if len(held) < to or not (after.startswith(2 * _NEWLINE) or b"WARC/".startswith(after.lstrip(b"\r\n")[:5])):
            passed(5)
            continue
        yield over, headers, held[end + 4 : to]
        held, over = held[to:], 0
    if over:
        yield over, [], b""


def parsed(raw: bytes) -> Iterator[tuple[Headers, bytes]]:
    """Headers and block of each whole record."""
    return ((headers, block) for _, headers, block in records(io.BytesIO(raw)) if headers)


class Inflated(io.RawIOBase):
    """A stream of gzip members, or of anything else as it is. A damaged member is passed over up to the next one that can be
    read; `damaged` counts them."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.held, self.ready, self.damaged = raw, raw.read(_STEP), b"", 0
        self.zipped, self.member = self.held[:2] == b"\x1f\x8b", None

    def readable(self) -> bool:
        return True

    def _fill(self) -> bool:
        if not self.held:
            self.held = self.raw.read(_STEP)
        return bool(self.held)

    def read(self, size: int = -1) -> bytes:
        parts, n = [self.ready], len(self.ready)
        while (size < 0 or n < size) and self._fill():
            part = self._inflate() if self.zipped else self.held
            if not self.zipped:
                self.held = b""
            parts.append(part)
            n += len(part)
        out = b"".join(parts)
        size = len(out) if size < 0 else size
        self.ready = out[size:]
        return out[:size]

    def _inflate(self) -> bytes:
        if self.member is None:
            at = self.held.find(b"\x1f\x8b\x08")
            if at < 0:
                self.held = self.held[-2:] if self.held[-2:].startswith(b"\x1f") and self._longer() else b""
                return b""
            self.held, self.member = self.held[at:], zlib.decompressobj(31)
        try:
            out = self.member.decompress(self.held, 4 * _STEP)
            self.held = self.member.unconsumed_tail or self.member.unused_data
            if self.member.eof:
                self.member = None
            return out
        except zlib.error:
            self.damaged, self.member, self.held = self.damaged + 1, None, self.held[2:]
            return b"\r\n"  # so that the next record begins on a line of its own

    def _longer(self) -> bool:
        part = self.raw.read(_STEP)
        self.held += part
        return bool(part)


def dechunked(body: bytes) -> bytes | None:
    """A body without its chunks' sizes; None if it isn't in chunks."""
    parts, at = [], 0
    while m := _CHUNK_SIZE.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
        if len(parts[-1]) < size or body[at - 2 : at] != _NEWLINE:
            return None
    return None


_CHUNK_SIZE = re.compile(rb"([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


def decompressed(body: bytes, coding: str, most: int = MOST_BYTES) -> bytes | None:
    """None for an unknown coding, a damaged body, or one that grows beyond `most` bytes."""
    try:
        if coding in ("gzip", "x-gzip"):
            reader = Inflated(io.BytesIO(body))
            out = reader.read(most + 1) if reader.zipped else None
            if reader.damaged or (reader.member is not None and len(out) <= most):
                return None
        elif coding == "deflate":
            out = None
            for bits in (15, -15):  # with its header, or bare
                try:
                    out = zlib.decompressobj(bits).decompress(body, most + 1)
                    break
                except zlib.error:
                    pass
        elif coding == "zstd":
            out = zstandard.ZstdDecompressor().stream_reader(body).read(most + 1)
        else:
            return None
    except (zlib.error, zstandard.ZstdError, EOFError):
        return None
    return out if out is not None and len(out) <= most else None


def entity(http: Headers, body: bytes) -> tuple[bytes | None, Headers]:
    """The body as its type describes it (None if it can't be had), and notes."""
    notes: Headers = []
    if get(http, "Transfer-Encoding").lower().endswith("chunked"):
        whole = dechunked(body)
        if whole is None:
            notes.append(("transfer-encoding", "the body is not in chunks"))
        body = body if whole is None else whole
    for coding in reversed([c.strip().lower() for c in get(http, "Content-Encoding").split(",") if c.strip().lower() not in ("", "identity")]):
        got = decompressed(body, coding)
        if got is None:
            if coding in ("gzip", "x-gzip") and body[:2] != b"\x1f\x8b":
                notes.append(("content-encoding", "the body is not compressed"))
                continue
            return None, [*notes, ("content-encoding", f"{coding} could not be undone")]
        body = got
    return body, notes


_MARKUP_TYPES = ("", "text/html", "application/xhtml+xml")
_META_CHARSET = re.compile(rb"<meta[^>]{0,200}charset=[\"']?([A-Za-z0-9_:.-]{1,40})", re.I)


def is_text(kind: str) -> bool:
    return kind in _MARKUP_TYPES or kind.startswith("text/") or kind in ("application/json", "application/xml") or kind.endswith(("+xml", "+json"))


def http_parts(block: bytes, content_type: str) -> tuple[str, Headers, bytes]:
    """Status line, headers and body."""
    if not content_type.lower().startswith("application/http"):
        return "", [], block
    end, gap = block.find(b"\r\n\r\n"), 4
    if end < 0:
        end, gap = block.find(b"\n\n"), 2
    if end < 0:
        return "", [], block
    status, _, rest = block[:end].partition(b"\n")
    return status.decode("utf-8", "replace").strip(), _fields(rest), block[end + gap :]


#: Tags that end a line of text, and those whose content isn't text.
BLOCKS = frozenset("address article aside blockquote body br center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
OPAQUE = frozenset("script style noscript template svg math iframe object textarea".split())
_CLOSE = {name: re.compile(f"</{name}", re.I | re.A) for name in OPAQUE}
_NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-\w:.]*)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")


def tags_and_text(markup: str) -> Iterator[tuple[str, str]]:
    """("", text) and (name, the tag's inside); the name of an end tag starts with a slash."""
    at, size = 0, len(markup)
    while at < size:
        open_at = markup.find("<", at)
        if open_at < 0:
            yield "", markup[at:]
            return
        if open_at > at:
            yield "", markup[at:open_at]
        if markup.startswith("<!--", open_at):
            end = markup.find("-->", open_at + 4)
            at = size if end < 0 else end + 3
            continue
        found = _NAME.match(markup, open_at + 1)
        if not found:
            if markup[open_at + 1 : open_at + 2] in ("!", "?"):
                end = markup.find(">", open_at)
                at = size if end < 0 else end + 1
            else:
                yield "", "<"
                at = open_at + 1
            continue
        end = _tag_end(markup, found.end())
        name = found[1].lower()
        is_end = markup[open_at + 1] == "/"
        yield ("/" if is_end else "") + name, markup[found.end() : end]
        at = min(size, end + 1)
        if name in OPAQUE and not is_end and markup[end - 1 : end] != "/":
            close = _CLOSE[name].search(markup, at)  # in the markup itself: lower case may have another length
            at = close.start() if close else size


def _tag_end(markup: str, at: int) -> int:
    """Place of the > that ends a tag, not one within quotes; the text's end if there is none."""
    while True:
        end = markup.find(">", at)
        if end < 0:
            return len(markup)
        inside = markup[at:end]
        quote = next((c for c in inside if c in "\"'"), "")
        if not quote:
            return end
        close = markup.find(quote, at + inside.index(quote) + 1)
        if close < 0:
            return end
        at = close + 1


def page_text(markup: str) -> tuple[str, dict[str, str], list[str]]:
    """Text, what the page says of itself (title, language, description), and its links."""
    parts: list[str] = []
    about: dict[str, str] = {}
    links: list[str] = []
    in_title: list[str] | None = None
    for name, inside in tags_and_text(markup):
        if not name:
            text = html.unescape(inside)
            (parts if in_title is None else in_title).append(text)
            continue
        if name in ("title", "/title"):
            if name == "title":
                in_title = []
            elif in_title is not None:
                about.setdefault("title", " ".join("".join(in_title).split()))
                in_title = None
            continue
        if name in ("html", "meta", "a"):
            own = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(inside)}
            if name == "html" and own.get("lang"):
                about.setdefault("language", own["lang"])
            elif name == "meta" and own.get("name", "").lower() == "description":
                about.setdefault("description", own.get("content", ""))
            elif name == "a" and own.get("href"):
                links.append(own["href"])
        if name.lstrip("/") in BLOCKS:
            parts.append("\n")
    lines = (" ".join(x.split()) for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), about, links


def response(page_id: str, url: str, body: bytes, date: str) -> bytes:
    """A response record of a page."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    headers = [
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", page_id, url)), ("WARC-Target-URI", url), ("WARC-Date", date),
        ("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response"),
    ]
    return serialised(headers, block)


def derived(headers: Headers, block: bytes) -> list[tuple[Headers, bytes]]:
    """The metadata record of a response, and its conversion record where it is text."""
    record_type = get(headers, "Content-Type").lower()
    status, http, body = http_parts(block, record_type)
    full_type = get(http, "Content-Type") or ("" if status or record_type.startswith("application/http") else record_type)
    kind = full_type.partition(";")[0].strip().lower()
    shown, notes = entity(http, body)
    text, about, links = None, {}, []
    if shown is not None and not is_text(kind):
        notes.append(("conversion", f"none of {kind}"))
    elif shown is not None:
        declared = re.search(r"charset=[\"']?([\w.:-]+)", full_type, re.I)
        meta = None if declared else _META_CHARSET.search(shown, 0, 4096)
        try:
            text = shown.decode(declared[1] if declared else meta[1].decode() if meta else "utf-8", "replace")
        except LookupError:
            text = shown.decode("utf-8", "replace")
        if kind in _MARKUP_TYPES:
            text, about, links = page_text(text)
    source, url, date = get(headers, "WARC-Record-ID"), get(headers, "WARC-Target-URI"), get(headers, "WARC-Date")
    own = {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(body)}
    noted = [("digest-mismatch", k) for k, v in own.items() if get(headers, k) not in ("", v)]
    fields = [
        *((k, about[k]) for k in ("title", "language", "description") if about.get(k)), *([("http-status", status)] if status else []), *((f"http-{k.lower()}", v) for k, v in http),
        *((f"source-{k.lower()}", v) for k, v in headers), *noted, *((f"note-{k}", v) for k, v in notes),
        *([("text-digest", digest(text.encode("utf-8", "replace")))] if text is not None else []), *(("outlink", x) for x in links),
    ]
    ids = {k: record_id(k, source) for k in ("metadata", "conversion")}
    out = []
    for name, other, content_type, own_block in (
        ("metadata", "conversion", "application/warc-fields", "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode("utf-8", "replace")),
        ("conversion", "metadata", "text/plain; charset=utf-8", None if text is None else text.encode("utf-8", "replace")),
    ):
        if own_block is None:
            continue
        made = [
            ("WARC-Type", name), ("WARC-Record-ID", ids[name]), ("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url),
            ("WARC-Date", date), *([("WARC-Concurrent-To", ids[other])] if text is not None else []), ("WARC-Source-Block-Digest", get(headers, "WARC-Block-Digest") or own["WARC-Block-Digest"]),
            ("WARC-Source-Payload-Digest", get(headers, "WARC-Payload-Digest") or own["WARC-Payload-Digest"]), ("WARC-Block-Digest", digest(own_block)), ("Content-Type", content_type),
        ]
        out.append((made, own_block))
    return out


_DERIVED = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("source_payload_digest", pa.string()), ("block_digest", pa.string()), ("content_length", pa.int64()), ("headers", pa.string()), ("block", pa.string())])
_DERIVED_SQL = "page_id long, record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, headers string, block string"


def _responses(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "place")), strict=True)
            made = [response(str(i) if place is None else f"{i} {place}", _line(url or ""), body or b"", date) for i, url, body, place in rows]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], ["page_id", "record"])

    return run


def _derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for page_id, raw in zip(batch.column("page_id").to_pylist(), batch.column("record").to_pylist(), strict=True):
            for headers, block in parsed(raw or b""):
                if get(headers, "WARC-Type").lower() != "response":
                    continue
                for own, own_block in derived(headers, block):
                    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in own)
                    out.append((page_id, *(get(own, k) for k in ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Source-Payload-Digest", "WARC-Block-Digest")), len(own_block), head, own_block.decode()))
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_DERIVED)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _DERIVED, strict=True)], schema=_DERIVED)


def page_responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z", most_broadcast: int = 1_000_000) -> DataFrame:
    """(page_id, record): a response record of each page, fetched at that date. Pages that share id and url differ in their place."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    again = checkpointed(rows.groupBy(F.col("page_id").alias("p"), F.col("url").alias("u")).count().filter("count > 1").select("p", "u"))
    if n := again.count():
        same = F.col("page_id").eqNullSafe(F.col("p")) & F.col("url").eqNullSafe(F.col("u"))
        placed = rows.withColumn("at", F.monotonically_increasing_id()).join((F.broadcast(again) if n <= most_broadcast else again).withColumn("again", F.lit(True)), same, "left")
        rows = placed.select("page_id", "url", "html", F.when(F.col("again"), F.col("at")).alias("place"))
    else:
        rows = rows.withColumn("place", F.lit(None).cast("long"))
    return rows.mapInArrow(_responses(date), "page_id long, record binary")


def derivatives(responses: DataFrame) -> DataFrame:
    """A row per derived record of (page_id, record): its kind, ids, digests, header lines and block."""
    return responses.select("page_id", "record").mapInArrow(_derive, _DERIVED_SQL)


def _file_writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        system, path = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        name, part = f"{path}/part-{task.partitionId():05d}.warc.gz", f"{path}/.part-{task.partitionId():05d}-{task.taskAttemptId()}"
        n = 0
        with system.open_output_stream(part) as f:
            for batch in batches:
                for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist(), strict=True):
                    f.write(gzip.compress(serialised(_fields(headers.encode()), block.encode()), 6, mtime=0))
                    n += 1
        system.move(part, name)  # whole or not there
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return run


def write_files(records: DataFrame, folder: str) -> DataFrame:
    """Write records (headers, block) to .warc.gz files, one a partition, in a folder all executors share; (file, records)."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    return records.select("headers", "block").mapInArrow(_file_writer(folder), "file string, records long")


_READ = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("record", pa.binary()), ("skipped", pa.int64())])


def _records_of(path: str, raw: BinaryIO, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    stream = Inflated(raw)
    for skipped, headers, block in records(stream):
        rows.append((path, get(headers, "WARC-Record-ID") if headers else None, serialised(headers, block) if headers else None, skipped))
        held += len(block) + 500
        if held >= most:
            yield _read_batch(rows)
            rows, held = [], 0
    yield _read_batch(rows)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_READ)
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _READ, strict=True)], schema=_READ)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            with system.open_input_stream(place, compression=None) as raw:
                yield from _records_of(path, raw)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            yield from _records_of(path, io.BytesIO(content))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, record, skipped) of the records of .warc and .warc.gz files; skipped: damaged bytes before the record, or, in
    a last row without a record, at the file's end.

    Files are read as streams, record by record, where tasks can open their store; from a store that only Spark reads they come
    whole, so there each must be under 2 GB.
    """
    from pyarrow import fs

    files = spark.read.format("binaryFile").load(path)
    schema = "path string, record_id string, record binary, skipped long"
    first = files.select("path").first()
    try:
        if first is not None:
            fs.FileSystem.from_uri(first[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return files.select("path", "content").mapInArrow(_whole, schema)
    return files.select("path").mapInArrow(_streamed, schema)
