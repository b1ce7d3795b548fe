"""The store of jobs: records that are saved under an id, taken away by their owner, and go when their time is over.

``job_log`` reads a finished table of events, ``job_log_stream`` the same events as they come, with a record a job in keyed
state and a timer for its end. Both give what became of each job: saved, removed, refused (another user's job, or none
was there) and expired, at the time it was so.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: job, user, kind ("save" or "remove"), at, order (among events of one time), ttl (seconds, null for the store's own).
LOG = "job string, owner string, what string, at timestamp"


def _event(at: float, order: int, user: str, kind: str, ttl: float, held: dict | None, superusers: frozenset[str]) -> tuple[list[tuple[str, str, float]], dict | None]:
    """What an event makes of the record that is held: rows of owner, what and at, and the new record."""
    out = []
    if held is not None and held["until"] <= at:
        out.append((held["owner"], "expired", held["until"]))
        held = None
    if held is not None and (at, order) < (held["at"], held["order"]):
        return out, held  # an event that comes late changes nothing
    if kind == "save":
        if held is not None and held["owner"] != user and user not in superusers:
            return [*out, (user, "refused", at)], held
        owner = user if held is None else held["owner"]
        return [*out, (owner, "saved", at)], {"owner": owner, "at": at, "order": order, "until": at + ttl}
    if held is None or held["owner"] != user and user not in superusers:
        return [*out, (user, "refused", at)], held
    return [*out, (held["owner"], "removed", at)], None


def job_log(events: DataFrame, ttl: float, superusers: frozenset[str] = frozenset()) -> DataFrame:
    """The log of a table of events in order of time, jobs expiring by the time of the last event of all. One pass over each job's sorted events, which holds one record."""
    import pandas as pd

    end = events.agg(F.max("at").alias("end__"))
    slim = events.select(F.col("job").cast("string").alias("job"), F.col("user").cast("string").alias("user"), "kind", F.col("at").cast("double").alias("at"), F.col("order").cast("long").alias("order"), F.coalesce(F.col("ttl").cast("double"), F.lit(float(ttl))).alias("ttl"))
    rows = slim.filter("job is not null and user is not null and at is not null").crossJoin(F.broadcast(end.select(F.col("end__").cast("double"))))  # one row
    dealt = rows.repartition("job").sortWithinPartitions("job", "at", "order")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, last = None, None, 0.0
        for pdf in batches:
            out: list[tuple] = []
            for job, user, kind, at, order, its, end in pdf.itertuples(index=False):
                if job != now:
                    if held is not None and held["until"] <= last:
                        out.append((now, held["owner"], "expired", held["until"]))
                    now, held = job, None
                last = end
                made, held = _event(at, order, user, kind, its, held, superusers)
                out += [(job, *x) for x in made]
            yield pd.DataFrame(out, columns=["job", "owner", "what", "at"])
        if held is not None and held["until"] <= last:
            yield pd.DataFrame([(now, held["owner"], "expired", held["until"])], columns=["job", "owner", "what", "at"])

    return dealt.mapInPandas(run, "job string, owner string, what string, at double").withColumn("at", F.timestamp_micros(F.round(F.col("at") * 1000000).cast("long")))


class _Store(StatefulProcessor):
    """A record a job, and a timer at its end."""

    def __init__(self, ttl: float, superusers: frozenset[str]) -> None:
        self.ttl, self.superusers = ttl, superusers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", "owner string, at double, order long, until double")

    def _held(self) -> dict | None:
        if not self.record.exists():
            return None
        return dict(zip(("owner", "at", "order", "until"), self.record.get(), strict=True))

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        held, out = self._held(), []
        before = None if held is None else held["until"]
        for user, kind, at, order, ttl in pd.concat(list(rows))[["user", "kind", "at", "order", "ttl"]].sort_values(["at", "order"]).itertuples(index=False):
            made, held = _event(at.timestamp(), int(order), user, kind, self.ttl if pd.isna(ttl) else float(ttl), held, self.superusers)
            out += [(key[0], owner, what, pd.Timestamp(round(t * 1e6), unit="us")) for owner, what, t in made]
        after = None if held is None else held["until"]
        if before != after:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            if after is not None:
                self.handle.registerTimer(_millis(after))
        if held is None:
            self.record.clear()
        else:
            self.record.update((held["owner"], held["at"], held["order"], held["until"]))
        yield pd.DataFrame(out, columns=["job", "owner", "what", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        held, out = self._held(), []
        if held is not None and _millis(held["until"]) <= expiredTimerInfo.getExpiryTimeInMs():
            out.append((key[0], held["owner"], "expired", pd.Timestamp(round(held["until"] * 1e6), unit="us")))
            self.record.clear()
        yield pd.DataFrame(out, columns=["job", "owner", "what", "at"])

    def close(self) -> None:
        pass


def _millis(seconds: float) -> int:
    """Timers have whole milliseconds: the first that isn't before the time."""
    return -int(-seconds * 1000 // 1)


def job_log_stream(events: DataFrame, ttl: float, delay: str = "1 hour", superusers: frozenset[str] = frozenset()) -> DataFrame:
    """The same log of a stream of events (of the same columns, ``at`` a timestamp), which may come up to ``delay`` late. Needs the RocksDB state store."""
    slim = events.select(F.col("job").cast("string").alias("job"), F.col("user").cast("string").alias("user"), "kind", "at", F.col("order").cast("long").alias("order"), F.col("ttl").cast("double").alias("ttl"))
    known = slim.filter("job is not null and user is not null and at is not null").withWatermark("at", delay)
    return known.groupBy("job").transformWithStateInPandas(statefulProcessor=_Store(ttl, superusers), outputStructType=LOG, outputMode="Append", timeMode="EventTime")


def live_jobs(events: DataFrame, ttl: float, now: float, user: str | None = None, superusers: frozenset[str] = frozenset()) -> DataFrame:
    """job, user, until of the jobs that are there at ``now`` (seconds): the last event before is a save whose time isn't over. ``user`` sees only theirs, superusers and None all. Events of one owner a job."""
    until = F.col("at").cast("double") + F.coalesce(F.col("ttl").cast("double"), F.lit(float(ttl)))
    last = Window.partitionBy("job").orderBy(F.desc("at"), F.desc("order"))
    before = events.filter(F.col("at").cast("double") <= now).withColumns({"until": until, "r__": F.row_number().over(last)})
    found = before.filter((F.col("r__") == 1) & (F.col("kind") == "save") & (F.col("until") > now)).select("job", "user", "until")
    return found if user is None or user in superusers else found.filter(F.col("user") == user)
