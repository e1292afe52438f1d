"""The query object: validation, identity, and its one translation into filter columns."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import serialize


@dataclass(frozen=True)
class SearchSpec:
    query: str = ""
    scope: str = "all"
    chat_ids: tuple = ()
    author_ids: tuple = ()
    forwarded_from: tuple = ()
    date_from: int | None = None
    date_to: int | None = None
    content_type: str = "all"
    exclude_deleted: bool = False
    exact_phrase: bool = False
    mode: str = "words"
    sort: str = "newest"
    page_size: int = 20
    chunk_size: int = 10

    def __post_init__(self):
        checks = (
            (len(self.query) <= 4096, "query is too long"),
            (self.scope in ("all", "selected"), "unknown scope"),
            (not (self.scope == "all" and self.chat_ids), "scope all takes no chats"),
            (max(map(len, (self.chat_ids, self.author_ids, self.forwarded_from))) <= 500, "too many ids"),
            (self.content_type in ("all", "text", "photo", "service"), "unknown content type"),
            (self.mode in ("words", "meaning", "hybrid"), "unknown mode"),
            (self.sort in ("newest", "oldest"), "unknown order"),
            (1 <= self.page_size <= 100 and 1 <= self.chunk_size <= 100, "size out of range"),
            (None in (self.date_from, self.date_to) or self.date_from < self.date_to, "empty date range"),
        )
        for ok, what in checks:
            if not ok:
                raise ValueError(what)

    @property
    def browses(self) -> bool:
        return not self.query.strip()

    def identity(self) -> str:
        """SHA-256 of the canonical form: lists sorted without repeats, the query stripped."""
        form = {k: sorted(set(v), key=str) if isinstance(v, tuple) else v for k, v in vars(self).items()}
        return hashlib.sha256(serialize(form | {"query": self.query.strip()}).encode()).hexdigest()

    def filters(self) -> Column:
        """All conditions on a message; a selected scope without chats is false at once."""
        out = F.lit(not (self.scope == "selected" and not self.chat_ids))
        for column, values in (("chat_id", self.chat_ids), ("author_id", self.author_ids), ("forwarded_from", self.forwarded_from)):
            if values:
                out = out & F.col(column).isin(*values)
        if self.date_from is not None:
            out = out & (F.col("timestamp") >= self.date_from)
        if self.date_to is not None:
            out = out & (F.col("timestamp") < self.date_to)
        kinds = {"photo": F.col("has_photo") == 1, "text": (F.col("kind") == "message") & (F.col("text") != ""), "service": F.col("kind") == "service"}
        if self.content_type in kinds:
            out = out & kinds[self.content_type]
        return out & (F.col("deleted") == 0) if self.exclude_deleted else out


def after(cursor: tuple, newest: bool = True) -> Column:
    """Rows behind a position (timestamp, chat, message), written out so that it reaches the scan."""
    t, c, m = (F.col(x) for x in ("timestamp", "chat_id", "message_id"))
    beyond = (lambda a, b: a < b) if newest else (lambda a, b: a > b)
    edge = t <= cursor[0] if newest else t >= cursor[0]
    return edge & (beyond(t, cursor[0]) | (beyond(c, cursor[1]) | ((c == cursor[1]) & beyond(m, cursor[2]))))


def write_cursor(spec: SearchSpec, epoch: int, position: tuple) -> str:
    return base64.urlsafe_b64encode(json.dumps([spec.identity(), epoch, list(position)]).encode()).decode()


def read_cursor(spec: SearchSpec, epoch: int, cursor: str) -> tuple:
    """The position of a cursor, if it belongs to this query and this state of the archive."""
    identity, then, position = json.loads(base64.urlsafe_b64decode(cursor))
    if identity != spec.identity() or then != epoch:
        raise ValueError("the cursor belongs to another query or an older state")
    return tuple(position)
