"""What readers ask: feeds, details, series, alerts, health."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertow.config import D
from undertow.operators import tallies

MOST = 200


def item_counts(stories: DataFrame, items: DataFrame) -> DataFrame:
    return stories.join(items.groupBy("story_id").agg(F.count("*").alias("item_count")), "story_id", "left").fillna(0, ["item_count"])


def feed(stories: DataFrame, items: DataFrame, now: int, tab: str = "gap", window_s: int = D.active_s, most: int = 50) -> DataFrame:
    """A tab of the feed: gap, corroborated, primary or weather; any other is gap. Weather stories show under their own tab only."""
    weather = F.array_contains("source_set", "noaa")
    recent = stories.where(F.col("last_seen") > now - window_s)
    shown = {"corroborated": ~weather & (F.col("trust_state") == "corroborated"), "primary": ~weather & (F.col("trust_state") == "primary_backed"), "weather": weather}.get(tab, ~weather)
    order = [F.desc("gap"), F.desc("last_seen")] if tab not in ("corroborated", "primary", "weather") else [F.desc("last_seen")]
    top = recent.where(shown).orderBy(*order, "story_id").limit(min(most, MOST))
    return item_counts(top, items)


def story(stories: DataFrame, items: DataFrame, story_id) -> DataFrame:
    return item_counts(stories.where(F.col("story_id") == story_id), items)


def story_items(items: DataFrame, story_id, most: int = 50, preview: int = 500) -> DataFrame:
    """Newest items of a story, with the start of their text."""
    return items.where(F.col("story_id") == story_id).orderBy(F.desc("ts"), "id").limit(min(most, MOST)).withColumn("text", F.substring("text", 1, preview))


def velocity_series(mentions: DataFrame, entities: list[str], now: int, window_s: int = 86_400, seconds: int = 900) -> DataFrame:
    """bin, n: all mentions of some entities, of the window, in bins."""
    rows = tallies.binned(mentions.where(F.col("entity").isin(entities)), now - window_s, seconds)
    return rows.groupBy("bin").agg(F.sum("n").alias("n"))


def alerts(alert_rows: DataFrame, stories: DataFrame, now: int, window_s: int = 7 * 86_400, most: int = 50) -> DataFrame:
    top = alert_rows.where(F.col("ts") > now - window_s).orderBy(F.desc("ts"), "story_id").limit(min(most, MOST))
    return top.join(stories.select("story_id", "entity_set"), "story_id", "left")


def alerts_after(alert_rows: DataFrame, stories: DataFrame, cursor: int, batch: int = 50) -> DataFrame:
    top = alert_rows.where(F.col("ts") > cursor).orderBy("ts", "story_id").limit(batch)
    return top.join(stories.select("story_id", "entity_set"), "story_id", "left")


def push_message() -> tuple[F.Column, F.Column]:
    """Title and body of a push for an alert with story_id, entity_set, gap, velocity_z and trust_state."""
    names = F.array_join(F.slice(F.coalesce("entity_set", F.array().cast("array<string>")), 1, 5), ", ")
    title = F.concat(F.lit("Developing story: "), F.when(names != "", names).otherwise("unknown entities"))
    body = F.format_string("gap %.1f · velocity z %.1f · %s · story %s", "gap", "velocity_z", "trust_state", F.col("story_id").cast("string"))
    return title, body


def health(state: DataFrame) -> DataFrame:
    """sampling_active, baseline_warming of system_state (key, value JSON): any enricher samples; warming until told otherwise."""
    sampling = F.bool_or(F.col("key").startswith("enrich:") & (F.get_json_object("value", "$.sampling_active") == "true"))
    warm = F.max(F.when(F.col("key") == "score", F.get_json_object("value", "$.baseline_warming")))
    return state.agg(F.coalesce(sampling, F.lit(False)).alias("sampling_active"), F.coalesce(warm == "true", F.lit(True)).alias("baseline_warming"))


def system_state(state: DataFrame) -> DataFrame:
    return state.orderBy("key")


class Degradable:
    """Calls that answer with what they last returned, flagged as stale, while the store fails."""

    def __init__(self):
        self.known: dict = {}

    def __call__(self, key, read: Callable[[], list]) -> tuple[list, bool]:
        """(rows, stale); the error itself where nothing was ever read."""
        try:
            self.known[key] = read()
        except Exception:
            if key not in self.known:
                raise
            return self.known[key], True
        return self.known[key], False


class Notifier:
    """Pushes alerts newer than a cursor, which starts at the newest and moves only behind what was pushed. message() gives
    title and body as columns of an alert with its story's entity_set."""

    def __init__(self, push: Callable[[str, str], None], cursor: int, message: Callable[[], tuple[F.Column, F.Column]] = push_message):
        self.push, self.cursor, self.message = push, cursor, message

    @classmethod
    def at_newest(cls, push: Callable[[str, str], None], alert_rows: DataFrame) -> Notifier:
        return cls(push, alert_rows.agg(F.max("ts")).first()[0] or 0)

    def poll(self, alert_rows: DataFrame, stories: DataFrame, batch: int = 50) -> int:
        """Number pushed. All alerts of a second go together, so none is lost at a batch's end."""
        title, body = self.message()
        last = alert_rows.where(F.col("ts") > self.cursor).orderBy("ts").limit(batch).agg(F.max("ts")).first()[0]
        if last is None:
            return 0
        due = alert_rows.where((F.col("ts") > self.cursor) & (F.col("ts") <= last)).join(stories.select("story_id", "entity_set"), "story_id", "left")
        rows = due.select("ts", title.alias("title"), body.alias("body")).orderBy("ts", "title").collect()  # about a batch
        for i, row in enumerate(rows):
            self.push(row["title"], row["body"])
            if i + 1 == len(rows) or rows[i + 1]["ts"] > row["ts"]:
                self.cursor = row["ts"]  # a failure later repeats only what is newer
        return len(rows)


def http_push(url: str, user: str = "", password: str = "", open_: Callable | None = None, seconds: float = 30.0) -> Callable[[str, str], None]:
    """push(title, body) as a POST of high priority; an answer that is no success is an error."""
    import base64
    import urllib.request

    def push(title: str, body: str) -> None:
        headers = {"Title": title, "Priority": "high", "Tags": "rotating_light"}
        if user:
            headers["Authorization"] = "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()
        request = urllib.request.Request(url, body.encode(), headers, method="POST")
        with (open_ or urllib.request.urlopen)(request, timeout=seconds):
            pass

    return push


class Api:
    """The read API over tables that are read anew for each answer. tables() gives stories, items, mentions, alerts and
    state; each answer is (rows, stale): while a table cannot be read the last answer is given, marked as stale."""

    def __init__(self, tables: Callable[[], dict[str, DataFrame]]):
        self.tables, self.answer = tables, Degradable()

    def stories(self, now: int, tab: str = "gap", window_s: int = D.active_s, most: int = 50) -> tuple[list, bool]:
        return self.answer(("stories", tab, window_s, most), lambda: feed(self._of("stories"), self._of("items"), now, tab, window_s, most).collect())

    def story(self, story_id) -> tuple[list, bool]:
        """The story, none if there is no such, and its newest items."""
        return self.answer(("story", story_id), lambda: [*story(self._of("stories"), self._of("items"), story_id).collect(), *story_items(self._of("items"), story_id).collect()])

    def velocity(self, story_id, now: int, window_s: int = 86_400, seconds: int = 900) -> tuple[list, bool]:
        def read() -> list:
            named = self._of("stories").where(F.col("story_id") == story_id).select("entity_set").first()
            return velocity_series(self._of("mentions"), list(named["entity_set"]) if named else [], now, window_s, seconds).orderBy("bin").collect()

        return self.answer(("velocity", story_id, window_s, seconds), read)

    def alerts(self, now: int, most: int = 50) -> tuple[list, bool]:
        return self.answer(("alerts", most), lambda: alerts(self._of("alerts"), self._of("stories"), now, most=most).collect())

    def health(self) -> tuple[list, bool]:
        return self.answer("health", lambda: health(self._of("state")).collect())

    def state(self) -> tuple[list, bool]:
        return self.answer("state", lambda: system_state(self._of("state")).collect())

    def _of(self, name: str) -> DataFrame:
        return self.tables()[name]
