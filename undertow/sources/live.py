"""Transports of feeds that are read by cursor. Each takes a cursor and returns (JSON strings, new cursor).

The openers can be replaced, so nothing here needs a network to be tested.
"""

from __future__ import annotations

import contextlib
import json
import os
import urllib.request
from collections.abc import Callable, Iterable

from undertow.sources.poll import sse_events

Open = Callable[[str, dict], object]


def opened(url: str, headers: dict, seconds: float = 60.0):
    return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=seconds)


#: The instances asked where neither the caller nor the environment names any.
INSTANCES = "mstdn.social,mas.to,fosstodon.org"


def mastodon_page(cursor: str, instances: Iterable[str] = (), open_: Open = opened) -> tuple[list[str], str]:
    """New statuses of each instance's public timeline, oldest first. The cursor is a JSON map of instance to the
    newest id seen; an instance that fails, or answers with no list, keeps its place and does not stop the others."""
    named = os.environ.get("MASTO_INSTANCES", INSTANCES).split(",")
    since, out = json.loads(cursor or "{}"), []
    for instance in list(instances) or filter(None, map(str.strip, named)):
        url = f"https://{instance}/api/v1/timelines/public?limit=40" + (f"&since_id={since[instance]}" if instance in since else "")
        try:
            with open_(url, {}) as answer:
                page = [s for s in json.load(answer) if isinstance(s, dict) and "id" in s]
        except (OSError, ValueError, TypeError):
            continue
        if page:
            since[instance] = page[0]["id"]  # the page is newest first
            out += [json.dumps(s | {"instance": instance}) for s in reversed(page)]
    return out, json.dumps(since, sort_keys=True)


def wikipedia_changes(cursor: str, most: int = 500, open_: Open = opened) -> tuple[list[str], str]:
    """Up to most changes of the event stream behind the cursor, which is the last event id."""
    headers = {"Accept": "text/event-stream"} | ({"Last-Event-ID": cursor} if cursor else {})
    out = []
    with open_("https://stream.wikimedia.org/v2/stream/recentchange", headers) as answer:
        lines = (line.decode("utf-8", "replace") if isinstance(line, bytes) else line for line in answer)
        for cursor_, event in sse_events(lines):
            cursor = cursor_ or cursor
            out.append(json.dumps(event))
            if len(out) >= most:
                break
    return out, cursor


def dialled(url: str, seconds: float = 60.0):
    """Messages of a web socket until it closes or none comes for so long; it is closed in any case."""
    try:
        from websockets.sync.client import connect
    except ImportError as missing:
        raise RuntimeError("the websockets package is needed to read the firehose") from missing
    with connect(url) as socket, contextlib.suppress(TimeoutError):
        while True:
            yield socket.recv(timeout=seconds)


def bluesky_posts(cursor: str, most: int = 500, connect: Callable[[str], Iterable[str]] = dialled) -> tuple[list[str], str]:
    """Up to most events of the firehose behind the cursor, the time_us of the last one. connect(url) yields messages."""
    url = "wss://jetstream2.us-east.bsky.network/subscribe?wantedCollections=app.bsky.feed.post" + (f"&cursor={cursor}" if cursor else "")
    out, messages = [], connect(url)
    try:
        for message in messages:
            try:
                cursor = str(json.loads(message)["time_us"])
            except (ValueError, KeyError, TypeError):
                continue
            out.append(message)
            if len(out) >= most:
                break
    finally:
        if hasattr(messages, "close"):
            messages.close()
    return out, cursor
