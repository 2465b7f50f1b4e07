"""Messages from files: mailbox exports, streams of them, MIME parts."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A message as mail services export it; its parts nest as deep as they like, so the payload stays text until it is flattened.
MESSAGE = "id string, threadId string, labelIds array<string>, snippet string, payload string"
_FLAT = "message_id string, threadId string, subject string, sender string, date string, in_reply_to string, references array<string>, body string, attachments array<string>, thread_depth int"


def read_messages(spark: SparkSession, path: str, stream: bool = False, lines: bool = False) -> DataFrame:
    """Messages of JSON files: an array in each file, or with ``lines`` one message a line, which splits large files over tasks.

    With ``stream``, files of lines as they arrive. The reader's unit for an array is the file, so large exports should
    be in lines.
    """
    if stream:
        return spark.readStream.schema(MESSAGE).json(path)
    return spark.read.schema(MESSAGE).option("multiLine", not lines).json(path)


def _decoded(data: str) -> str:
    """URL-safe base64, padded or not, as text; nothing where it isn't that."""
    try:
        return base64.urlsafe_b64decode(data + "=" * (-len(data) % 4)).decode("utf-8", "replace")
    except (binascii.Error, ValueError):
        return ""


def _leaves(payload: dict) -> Iterator[dict]:
    """A payload's parts that hold no parts, in order, at any depth."""
    waiting = [payload]
    while waiting:
        part = waiting.pop()
        inner = part.get("parts") or []
        if inner:
            waiting.extend(reversed(inner))
        else:
            yield part


def _flattened(message_id: str | None, thread: str | None, payload: str | None, body_chars: int) -> tuple:
    try:
        data = json.loads(payload) if payload else {}
    except ValueError:
        data = {}
    heads: dict[str, str] = {}
    for h in data.get("headers") or []:
        heads.setdefault(str(h.get("name", "")).lower(), h.get("value"))
    parts = list(_leaves(data))
    told = [(p.get("body") or {}).get("data") for p in parts if p.get("mimeType") == "text/plain"]
    body = next((_decoded(d) for d in told if d), None) or _decoded((data.get("body") or {}).get("data") or "")
    references = (heads.get("references") or "").split()
    depth = len(references) or int(bool(heads.get("in-reply-to")))
    names = [p["filename"] for p in parts if p.get("filename")]
    return message_id, thread, heads.get("subject"), heads.get("from"), heads.get("date"), heads.get("in-reply-to"), references, body[:body_chars], names, depth


def flat_messages(messages: DataFrame, body_chars: int = 2000) -> DataFrame:
    """One flat row per message: headers, text body, attachments' names, and how deep in its thread it is.

    Parts are walked to any depth. The body is the first plain text there is, else the payload's own; unreadable
    payloads give empty rows.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FLAT.split(", ")]
        for frame in frames:
            rows = [_flattened(*r, body_chars) for r in zip(frame["id"], frame["threadId"], frame["payload"], strict=True)]
            yield pd.DataFrame(rows, columns=names)

    return messages.select("id", "threadId", "payload").mapInPandas(work, _FLAT)


def search_mails(mails: DataFrame, query: str, limit: int) -> DataFrame:
    """The first mails by id that hold a string in their subject or body."""
    low = F.lower(F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit(""))))
    return mails.filter(low.contains(query.lower())).orderBy("message_id").limit(limit)


def key_of_delivery(message_id, body):
    """The id of a delivered message: its header's, else the hash of its body."""
    return F.coalesce(F.nullif(F.trim(message_id), F.lit("")), F.sha2(F.coalesce(body, F.lit("")), 256))
