"""Public channel previews as a source that goes on from where it was.

A Python data source with a stream reader.  Its offset has a number for each channel: the last message that a batch held.
A pass looks at three pages of a channel at most, newest first, back to that number, and moves on by ``limit`` messages,
the oldest first, so a burst is caught up over passes and none is left out.  Spark writes a batch's offsets before it reads the
batch and marks it done when its rows are kept; a crash between the two reads the same numbers again.

Pages come from a function ``fetch(channel, before) -> html or None``, named as ``module:function``; the default asks the web.
"""

from __future__ import annotations

import html
import importlib
import json
import re
import urllib.request
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "external_key string, channel string, number long, text string, published_at timestamp, url string"
PAGES, FEW = 3, 5
_TEXT = re.compile(r'(?s)<div[^>]*class="[^"]*message_text[^"]*"[^>]*>(.*?)</div>')
_POST = re.compile(r'data-post="([^"]+)"')
_TIME = re.compile(r'<time[^>]*datetime="([^"]+)"')


def web_page(channel: str, before: int | None) -> str | None:
    """A channel's public preview; None if there is none."""
    url = f"https://t.me/s/{channel}" + (f"?before={before}" if before else "")
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=25) as r:
            return r.read().decode("utf-8", "replace")
    except OSError:
        return None


def messages_of(page: str) -> list[tuple[str, int, str, datetime | None]]:
    """SRC-04: key, number, text and time of a preview's messages in page order; those without text, or seen before, are left out."""
    out, seen = [], set()
    for block in re.split(r"(?=<div[^>]*data-post=)", page)[1:]:
        post, text = _POST.search(block), _TEXT.search(block)
        number = re.search(r"(\d+)$", post[1]) if post else None
        if not (post and text and number) or post[1] in seen:
            continue
        said = html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>", "\n", text[1])))
        said = re.sub(r"[ \t]+", " ", said).strip()
        if said:
            seen.add(post[1])
            when = _TIME.search(block)
            try:
                at = datetime.fromisoformat(when[1]).astimezone(timezone.utc) if when else None
            except ValueError:
                at = None
            out.append((post[1], int(number[1]), said, at))
    return out


def pending(fetch, channel: str, after: int) -> list[tuple[str, int, str, datetime | None]]:
    """SRC-05: messages behind a number, in order, of the pages that a pass looks at."""
    found, before = {}, None
    for _ in range(PAGES):
        page = fetch(channel, before)
        rows = messages_of(page) if page else []
        if not rows:
            break
        found |= {r[1]: r for r in rows}
        before = min(r[1] for r in rows)
        if before <= after or len(rows) < FEW:
            break
    return [found[n] for n in sorted(found) if n > after]


class _Span(InputPartition):
    def __init__(self, channel: str, after: int, upto: int) -> None:
        self.channel, self.after, self.upto = channel, after, upto


class _Pages:
    def __init__(self, options: dict) -> None:
        self.channels = [c.strip().lstrip("@") for c in options["channels"].split(",") if c.strip()]
        self.limit = int(options.get("limit", 20))
        self.start = json.loads(options.get("start", "{}"))
        module, name = options.get("fetch", "sievework.sources.channels:web_page").split(":")
        self.fetch_of = (module, name)

    def fetch(self, channel: str, before: int | None) -> str | None:
        return getattr(importlib.import_module(self.fetch_of[0]), self.fetch_of[1])(channel, before)

    def rows(self, span: _Span) -> Iterator[tuple]:
        for key, number, text, at in pending(self.fetch, span.channel, span.after):
            if number <= span.upto:
                yield (f"tgweb:{key}", span.channel, number, text, at, f"https://t.me/{key}")


class ChannelStream(_Pages, DataSourceStreamReader):
    """SRC-05, SRC-06: offsets are {channel: number}."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {c: int(self.start.get(c, 0)) for c in self.channels}

    def latestOffset(self) -> dict:
        """From where the last batch ended, ``limit`` messages of each channel."""
        self.at = self.at or self.initialOffset()
        new = {}
        for c in self.channels:
            after = int(self.at.get(c, 0))
            rows = pending(self.fetch, c, after)[: self.limit]
            new[c] = rows[-1][1] if rows else after
        return new

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        self.at = dict(end)
        return [_Span(c, int(start.get(c, 0)), int(end[c])) for c in end if int(end[c]) > int(start.get(c, 0))] or [_Span("", 0, 0)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return self.rows(partition) if partition.channel else iter(())

    def commit(self, end: dict) -> None:
        self.at = {c: max(int(n), int((self.at or {}).get(c, 0))) for c, n in end.items()}


class ChannelReader(_Pages, DataSourceReader):
    """One pass over each channel from ``start``."""

    def partitions(self) -> list[_Span]:
        return [_Span(c, int(self.start.get(c, 0)), 1 << 62) for c in self.channels]

    def read(self, partition: _Span) -> Iterator[tuple]:
        for k, row in enumerate(self.rows(partition)):
            if k < self.limit:
                yield row


class ChannelPreviews(DataSource):
    """``spark.dataSource.register(ChannelPreviews)``, then ``readStream.format("channel_previews").option("channels", "a,b")``."""

    @classmethod
    def name(cls) -> str:
        return "channel_previews"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChannelReader:
        return ChannelReader(self.options)

    def streamReader(self, schema) -> ChannelStream:
        return ChannelStream(self.options)
