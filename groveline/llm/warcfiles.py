"""Records of web archives inside tasks: writing gzip members, and finding them again."""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark import cloudpickle

# Send the code itself to the workers, so that they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_MAGIC = b"\x1f\x8b\x08"
_GZIP = 31
_STEP = 1 << 20
_PIECE = 1 << 16
_LONGEST_HEADER = 1 << 20
# Names that the archive format lays down.
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a path and the path in it; file:, hdfs:, s3: and other stores of Arrow."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page: str | None, url: str | None, refers: str | None, payload: bytes, date: str) -> bytes:
    block = _HTTP.format(len(payload)).encode() + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page or ''}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if kind == "revisit":
        fields.append(("WARC-Profile", _REVISIT_PROFILE))
        fields.append(("WARC-Refers-To", f"<urn:page:{refers}>"))
    fields.append(("Content-Type", "application/http; msgtype=response"))
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, _GZIP)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def archive_writer(folder: str, date: str, file_bytes: int):
    """A function for mapInPandas: writes the task's records to files of its own.

    Hands on (path, bytes, records) of each file. A name is never used twice, so a task
    that runs again leaves files that no listing mentions.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        out, path, size, records = None, "", 0, 0
        done = []
        for batch in batches:
            for page, url, html, kind, refers in zip(
                batch["page_id"], batch["url"], batch["html"], batch["record_type"], batch["refers_to"]
            ):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    path = f"{folder}/{name}"
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = _record(kind, page, url, refers, payload, date)
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((path, size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, records))
        yield pd.DataFrame(done, columns=["path", "bytes", "records"])

    return write


class _Source:
    """A file read in steps, of which the part from some place on is held."""

    def __init__(self, handle, start: int) -> None:
        self.handle, self.start, self.data, self.ended = handle, start, b"", False
        handle.seek(start)

    def more(self) -> bool:
        found = b"" if self.ended else self.handle.read(_STEP)
        self.ended = not found
        self.data += found
        return bool(found)

    def drop(self, to: int) -> None:
        # not for every record, which would copy what is held for each
        if to - self.start >= _STEP:
            self.data, self.start = self.data[to - self.start :], to


def _header(data: bytes) -> dict[str, str] | None:
    """The named fields at the start of a decoded member, if it begins like a record."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = dict(line.split(":", 1) for line in lines if ":" in line)
    fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
    return fields if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


def _member(source: _Source, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(fields, block, end) of the record that starts at ``at``, None if none does."""
    unpacker, parts, n, fields, fed = zlib.decompressobj(_GZIP), [], 0, None, at
    while not unpacker.eof:
        piece = source.data[fed - source.start : fed - source.start + _PIECE]
        if not piece:
            if source.more():
                continue
            if fields is None:
                return None
            raise ValueError(f"archive ends inside the record at {at}")
        fed += len(piece)
        try:
            part = unpacker.decompress(piece)
        except zlib.error:
            if fields is None:
                return None
            raise
        parts.append(part)
        n += len(part)
        if fields is None:
            head = b"".join(parts)
            parts = [head]
            fields = _header(head)
            known_not = not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1.")
            if fields is None and (known_not or b"\r\n\r\n" in head or n > _LONGEST_HEADER):
                return None
    if fields is None:
        return None
    whole = b"".join(parts)
    first = whole.find(b"\r\n\r\n") + 4
    length = int(fields["content-length"])
    if len(whole) < first + length:
        raise ValueError(f"the record at {at} is shorter than its header says")
    return fields, whole[first : first + length], fed - len(unpacker.unused_data)


def records_of(path: str, start: int, stop: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, fields, block) of the records that start in [start, stop) of a file.

    Every place with the gzip magic is a candidate; one whose decoded bytes are no
    record's header is passed over. The last record may end beyond ``stop``.
    """
    store, inner = file_system(path)
    with store.open_input_file(inner) as handle:
        source = _Source(handle, start)
        at = start
        while at < stop:
            source.drop(at)
            place = source.data.find(_MAGIC, at - source.start)
            if place < 0:
                # the magic may be cut by the end of what has been read
                at = max(at, source.start + len(source.data) - len(_MAGIC) + 1)
                if not source.more():
                    return
                continue
            at = source.start + place
            if at >= stop:
                return
            found = _member(source, at)
            if found is None:
                at += 1
                continue
            yield at, found[0], found[1]
            at = found[2]


def _id(value: str | None) -> str | None:
    found = re.fullmatch(r"<urn:page:(.*)>", value or "")
    return (found[1] or None) if found else None


def archive_reader(batch_bytes: int = 16 << 20):
    """A function for mapInPandas: the records of byte ranges (path, start, stop)."""
    names = ["path", "place", "record_type", "page_id", "url", "refers_to", "digest", "payload"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                rows, size = [], 0
                for place, fields, block in records_of(path, int(start), int(stop)):
                    kind = fields["warc-type"]
                    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    payload = None
                    if kind == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        if digest and digest_of(payload) != digest:
                            raise ValueError(f"the payload at {path}:{place} does not fit its digest")
                    rows.append(
                        (path, place, kind, _id(fields.get("warc-record-id")), fields.get("warc-target-uri"),
                         _id(fields.get("warc-refers-to")), digest, payload)
                    )
                    size += len(payload or b"")
                    if size >= batch_bytes:
                        yield pd.DataFrame(rows, columns=names)
                        rows, size = [], 0
                yield pd.DataFrame(rows, columns=names)

    return read
