"""Raw messages (RFC 822) of folders of .eml files and mbox files, as a table or as a stream with offsets.

``spark.dataSource.register(MailboxSource)`` makes the format ``mailbox``; its ``path`` is a folder (at any depth) of any file system
that pyarrow opens: local or mounted, hdfs, s3, gs. An .eml file is one message. An mbox file (option ``mbox``: how their names end) is cut at the lines that begin
with ``From `` after a blank line (or at its start); large ones are read in slices, and a slice has the messages that begin in it.

Stream offsets say how many bytes of each file are taken, so files may arrive late and mbox files may grow; a message that
is added later is taken once, whatever the order. ``commit`` has nothing to keep: offsets live in the stream's checkpoint. An
mbox is taken up to its size when the folder is listed, so writers should append whole messages.

Defined results: malformed messages give a row with what can be read and ``problem`` says what is wrong; a message without an
id has a null one; a nested message (message/rfc822) counts in ``nested`` and its text is no part of the body; unknown
charsets are read as UTF-8 with replacements.
"""

from __future__ import annotations

import email
import email.policy
import hashlib
import json
import re
from collections.abc import Iterator
from email.header import decode_header, make_header
from email.utils import getaddresses
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MESSAGES = """file string, begin long, size long, message_id string, in_reply_to string, references array<string>, subject string, sender string, recipients array<string>, date string,
body string, html string, attachments array<struct<name: string, type: string, bytes: long>>, nested int, body_hash string, problem string"""
SLICE_BYTES = 64 << 20
_FROM = re.compile(rb"(?:\A|(?<=\n\n)|(?<=\n\r\n))From [^\n]*\n")


class Slice(NamedTuple):
    """The messages of one file that begin from ``begin`` on, before ``end``."""

    file: str
    begin: int
    end: int


class Bundle(InputPartition):
    """The slices that one task reads: about SLICE_BYTES in all, or one slice."""

    def __init__(self, slices: list[Slice]) -> None:
        self.slices = slices


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def listed(path: str, mbox: str = ".mbox") -> dict[str, int]:
    """The size of every .eml and mbox file below ``path``."""
    from pyarrow import fs

    system, base = _opened(path)
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    return {x.path[len(base) :].lstrip("/"): x.size for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".eml", mbox))}


def slices_of(taken: dict[str, int], sizes: dict[str, int]) -> list[Slice]:
    """Slices of what files have beyond what is ``taken`` of them; an .eml file is one slice."""
    out = []
    for file, size in sizes.items():
        begin = taken.get(file, 0)
        step = max(size, 1) if file.endswith(".eml") else SLICE_BYTES
        out += [Slice(file, at, min(at + step, size)) for at in range(begin, size, step)]
    return out


def bundled(slices: list[Slice]) -> list[Bundle]:
    """Slices in the order of their files, small ones together; one empty bundle where there are none."""
    out, size = [Bundle([])], 0
    for own in slices:
        if out[-1].slices and size + own.end - own.begin > SLICE_BYTES:
            out.append(Bundle([]))
            size = 0
        out[-1].slices.append(own)
        size += own.end - own.begin
    return out


def raw_messages(data, begin: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the messages of an mbox that begin from ``begin`` on, before ``end``; ``data(a, b)`` reads bytes."""
    # Four bytes before show whether a line at the very start begins a message.
    start = max(0, begin - 4)
    buffer, at, place = data(start, min(end + 4096, size)), start, None
    while at + len(buffer) < size and b"\n" not in buffer[end - at :]:  # a line that begins before the end is read whole
        buffer += data(at + len(buffer), min(at + len(buffer) + 4096, size))
    while True:
        found = [m for m in _FROM.finditer(buffer) if (m.start() > 0 or at == 0) and begin <= at + m.start()]
        for m in found:
            if place is not None:
                yield place, _unquoted(buffer[place_end - at : m.start()])
                place = None
            if at + m.start() >= end:
                return
            place, place_end = at + m.start(), at + m.end()
        if at + len(buffer) >= size:
            if place is not None:
                yield place, _unquoted(buffer[place_end - at :])
            return
        if place is None:
            return
        # The last message goes on beyond what is read.
        more = data(at + len(buffer), min(at + len(buffer) + (1 << 20), size))
        buffer, at = buffer[place_end - 4 - at if place_end - 4 >= at else 0 :] + more, max(at, place_end - 4)
        begin = place_end


def _unquoted(raw: bytes) -> bytes:
    """A message as it was before mbox quoting."""
    return re.sub(rb"(?m)^>(>*From )", rb"\1", raw)


def _said(value) -> str | None:
    """A header as text, encoded words decoded."""
    if value is None:
        return None
    try:
        return str(make_header(decode_header(str(value)))).strip()
    except (LookupError, ValueError, email.errors.HeaderParseError):
        return str(value).strip()


def _text(part) -> str:
    data = part.get_payload(decode=True) or b""
    try:
        return data.decode(part.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def parsed(file: str, begin: int, raw: bytes) -> tuple:
    """A row of MESSAGES."""
    message = email.message_from_bytes(raw, policy=email.policy.compat32)
    problems, plain, html, files, nested = [type(x).__name__ for x in message.defects], None, None, [], 0
    waiting = [message]
    while waiting:
        part = waiting.pop()
        problems += [type(x).__name__ for x in part.defects if part is not message]
        kind, name = part.get_content_type(), part.get_filename()
        if kind == "message/rfc822":
            nested += 1
        elif part.is_multipart():
            waiting.extend(reversed(part.get_payload()))
        elif name or part.get_content_disposition() == "attachment":
            files.append((_said(name), kind, len(part.get_payload(decode=True) or b"")))
        elif kind == "text/plain" and plain is None:
            plain = _text(part)
        elif kind == "text/html" and html is None:
            html = _text(part)
    if not raw.strip():
        problems.append("Empty")
    elif not message.keys():
        problems.append("NoHeaders")
    ids = re.findall(r"<([^<>\s]+)>", str(message.get("References") or ""))
    one = lambda name: (re.findall(r"<([^<>\s]+)>", str(message.get(name) or "")) or [(_said(message.get(name)) or "").strip("<> ") or None])[0]
    people = [a for _, a in getaddresses([str(x) for x in (message.get_all("To") or []) + (message.get_all("Cc") or [])]) if a]
    body = plain or ""
    digest = hashlib.sha256(body.encode("utf-8", "replace")).hexdigest()
    said = _said(message.get("Subject")), _said(message.get("From")), people, _said(message.get("Date"))
    return file, begin, len(raw), one("Message-ID"), one("In-Reply-To"), ids, *said, body, html, files, nested, digest, ", ".join(dict.fromkeys(problems)) or None


def rows_of(path: str, own: Slice) -> Iterator[tuple]:
    """The rows of one slice."""
    system, base = _opened(path)
    with system.open_input_file(f"{base}/{own.file}") as f:
        size = f.size()

        def data(a: int, b: int) -> bytes:
            return f.read_at(max(0, b - a), a)

        if own.file.endswith(".eml"):
            yield parsed(own.file, 0, data(0, size))
        else:
            for begin, raw in raw_messages(data, own.begin, own.end, size):
                yield parsed(own.file, begin, raw)


class _Reader(DataSourceReader):
    def __init__(self, path: str, mbox: str) -> None:
        self.path, self.mbox = path, mbox

    def partitions(self) -> list[Bundle]:
        return bundled(slices_of({}, listed(self.path, self.mbox)))

    def read(self, partition: Bundle) -> Iterator[tuple]:
        return (row for own in partition.slices for row in rows_of(self.path, own))


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, mbox: str) -> None:
        self.path, self.mbox = path, mbox

    def initialOffset(self) -> dict:
        return {"taken": "{}"}

    def latestOffset(self) -> dict:
        return {"taken": json.dumps(listed(self.path, self.mbox))}

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        return bundled(slices_of(json.loads(start["taken"]), json.loads(end["taken"])))

    def read(self, partition: Bundle) -> Iterator[tuple]:
        return (row for own in partition.slices for row in rows_of(self.path, own))

    def commit(self, end: dict) -> None:
        """Nothing is held here that an offset could free."""


class MailboxSource(DataSource):
    """The format ``mailbox``."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return MESSAGES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("mbox", ".mbox"))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.options.get("mbox", ".mbox"))
