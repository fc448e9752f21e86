"""Incidents: registration, suppression, de-duplication, state and alert payloads."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import instant, iso_utc
from ..operators.local_rows import union_all
from ..operators.prefix_max import greatest_so_far
from ..results import INFO
from .isolate import kept, small

# Ship the de-duplication functions with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: repeats within this many seconds of the last kept incident are duplicates.
DEDUP_SECONDS = 300
# Time chunks of this many windows are walked in parallel.
CHUNK_WINDOWS = 12
# Chunks of a key that one task puts in order; longer histories take more levels.
CHUNKS_PER_GROUP = 64
# Rules without a monitor and with a very short pattern meet every message; this many are broadcast at a time.
RULES_PER_BROADCAST = 1_000
# Length of the runs of characters by which patterns and messages meet.
GRAM = 3


def from_results(results: DataFrame) -> DataFrame:
    """One incident per monitor result, not yet suppressed or de-duplicated.

    An id names a monitor, a table and an instant, so results of the same instant share it. A column ``result_id`` of the
    results, if there is one, stays with the incident and tells them apart.
    """
    own = [c for c in ("result_id",) if c in results.columns]
    hints = (
        F.col("root_cause_hints") if "root_cause_hints" in results.columns else F.array().cast("array<string>")
    )
    detail = F.struct(
        "monitor_id", "monitor_type", "table_name", "alert", "severity", "score", "threshold",
        "message", "details", iso_utc(F.col("ts")).alias("ts"),
    )
    identity = F.concat_ws("|", "monitor_id", "table_name", F.unix_micros("ts").cast("string"))
    no_time, no_text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    return results.select(
        F.sha2(identity, 256).alias("incident_id"),
        "monitor_id",
        "table_name",
        "severity",
        "message",
        F.to_json(detail).alias("detail_json"),
        hints.alias("root_cause_hints"),
        F.concat_ws(":", "monitor_id", "table_name").alias("group_key"),
        "ts",
        F.lit(False).alias("resolved"),
        no_time.alias("resolved_at"),
        F.lit(False).alias("acked"),
        no_time.alias("acknowledged_at"),
        no_text.alias("owner"),
        F.lit(0).alias("escalation_level"),
        no_time.alias("snoozed_until"),
        *own,
    )


def maintenance_hits(incidents: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct incident ids inside a maintenance window (monitor_id or null, starts_at, ends_at)."""
    at = incidents.select("incident_id", "monitor_id", "ts")
    return _sheltered(at, windows).select("incident_id").distinct()


def _sheltered(at: DataFrame, windows: DataFrame) -> DataFrame:
    """The rows of ``at`` (monitor_id, ts and more) inside a window, those inside a named and a general one twice.

    An incident is inside one exactly if, of the windows that have started by then, the one that lasts longest has not
    ended: overlapping windows count as their union, and nothing is laid out over days or paired.
    """
    spans = windows.select("monitor_id", instant("starts_at").alias("ts"), instant("ends_at").alias("_until"))
    own = spans.where("monitor_id IS NOT NULL")
    concerned = at.join(small(own.select("monitor_id").distinct()), "monitor_id", "left_semi").select(at.columns)
    named = greatest_so_far(concerned, own, ["monitor_id"], "ts", "_until")
    general = greatest_so_far(at, spans.where("monitor_id IS NULL").drop("monitor_id"), [], "ts", "_until")
    return named.unionByName(general).where("ts <= _until").select(at.columns)


def ignore_hits(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct incident ids matched by a rule (monitor_id or null, pattern or null, expires_at or null)."""
    return _matched(incidents.select("incident_id", "monitor_id", "message", "ts"), rules).select("incident_id").distinct()


def _matched(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """The rows of ``messages`` (monitor_id, message, ts and more) that a rule matches, some of them several times.

    Rules naming a monitor are joined on it. Of the others, a pattern of ``GRAM`` characters or more meets the messages
    that hold its rarest run of so many characters; a shorter one has to see every message, in groups of
    RULES_PER_BROADCAST.
    """
    rules = rules.select(
        F.col("monitor_id").alias("_for"), F.col("pattern").alias("_pattern"),
        instant("expires_at").alias("_until"),
    ).distinct()
    named = messages.join(
        rules.where("_for IS NOT NULL"), (F.col("_for") == F.col("monitor_id")) & _applies(), "left_semi"
    )
    hits = [named]
    general = rules.where("_for IS NULL").drop("_for")
    long = F.coalesce(F.length("_pattern"), F.lit(0)) >= GRAM
    hits.append(_gram_hits(messages, general.where(long)))
    short = general.where(~long)
    groups = -(-short.count() // RULES_PER_BROADCAST)
    for g in range(groups):
        part = short.where(F.pmod(F.xxhash64("_pattern", "_until"), F.lit(groups)) == g)
        hits.append(messages.join(F.broadcast(part), _applies(), "left_semi"))
    return union_all(hits)


def _applies() -> Column:
    valid = F.col("_until").isNull() | (F.col("ts") <= F.col("_until"))
    return valid & (F.col("_pattern").isNull() | F.col("message").contains(F.col("_pattern")))


def _grams(text: str) -> Column:
    """Distinct runs of ``GRAM`` characters of a text that has one."""
    starts = F.sequence(F.lit(1), F.length(text) - (GRAM - 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(F.col(text), i, F.lit(GRAM))))


def _gram_hits(messages: DataFrame, rules: DataFrame) -> DataFrame:
    """Messages that contain a pattern: an inverted index of the patterns' runs, then a look at the text itself.

    Only runs of a pattern leave the task that reads the message.
    """
    wanted = kept(rules.select("_pattern").distinct().withColumn("_gram", F.explode(_grams("_pattern"))), "runs")
    long = messages.where(F.length("message") >= GRAM)
    said = long.select(F.explode(_grams("message")).alias("_gram")).join(small(wanted.select("_gram").distinct()), "_gram")
    seen = said.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    # a pattern with a run that no message holds is in none of them
    rarest = wanted.join(seen, "_gram", "left").groupBy("_pattern").agg(
        F.min_by("_gram", "_n").alias("_gram"), F.bool_and(F.col("_n").isNotNull()).alias("_all")
    ).where("_all").drop("_all")
    asked = small(rarest.join(rules, "_pattern"))
    return long.select("*", F.explode(_grams("message")).alias("_gram")).join(asked, "_gram").where(_applies()).select(messages.columns)


def _walk(ts: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """Last kept position when the first kept event is at ``start`` (vectorised)."""
    at = start.copy()
    while True:
        ahead = np.searchsorted(ts, ts[at] + window, side="left")
        moving = ahead < len(ts)
        if not moving.any():
            return at
        at = np.where(moving, ahead, at)


# A chunk's map says where it leaves off: entered when events may be kept from ``free`` on, its first kept event is at the
# first of ``_bounds`` that is not before ``free``, and its last one at the same place of ``_exits``. Beyond the last bound
# the chunk keeps nothing. Chunks last many windows, so an entry is less than a window past the start of the chunk.
_MAP = "_key string, _chunk bigint, _bounds array<bigint>, _exits array<bigint>"
_FREE = np.iinfo(np.int64).min


def _short(bounds: np.ndarray, exits: np.ndarray) -> tuple[list[int], list[int]]:
    """The last bound of each run of equal exits says as much as the run."""
    last = np.append(exits[1:] != exits[:-1], True)
    return bounds[last].tolist(), exits[last].tolist()


def _left_at(bounds, exits, free: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    """Last kept times of a chunk entered at ``free``; ``otherwise`` where it keeps nothing."""
    at = np.searchsorted(bounds, free, side="left")
    inside = at < len(bounds)
    return np.where(inside, np.asarray(exits)[np.minimum(at, len(bounds) - 1)], otherwise)


def _chunk_maps(events: DataFrame, window: int) -> DataFrame:
    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf["_ts"].to_numpy())
        chunk = int(pdf["_chunk"].iloc[0])
        limit = chunk * window * CHUNK_WINDOWS + window
        candidates = np.arange(min(len(times), int(np.searchsorted(times, limit, side="left")) + 1))
        bounds, exits = _short(times[candidates], times[_walk(times, candidates, window)])
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_chunk": [chunk], "_bounds": [bounds], "_exits": [exits]})

    return events.groupBy("_key", "_chunk").applyInPandas(transfer, _MAP)


def _composed(maps: DataFrame, level: int, window: int, first: int = 0) -> DataFrame:
    """Maps of groups of ``CHUNKS_PER_GROUP`` neighbours of a level, numbered as chunks of the level above.

    Chunks are counted from ``first`` on.
    """

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        above = int(pdf["_chunk"].iloc[0]) // CHUNKS_PER_GROUP
        # no entry of the group lies beyond this, so bounds after the first one past it are never asked for
        limit = (first + above * CHUNKS_PER_GROUP ** (level + 1)) * window * CHUNK_WINDOWS + window
        bounds, exits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for own_bounds, own_exits in zip(pdf["_bounds"], pdf["_exits"], strict=True):
            own_bounds, own_exits = np.asarray(own_bounds), np.asarray(own_exits)
            exits = _left_at(own_bounds, own_exits, exits + window, exits)
            if not len(bounds) or bounds[-1] < limit:
                fresh = slice(0, int(np.searchsorted(own_bounds, limit, side="left")) + 1)
                bounds, exits = np.append(bounds, own_bounds[fresh]), np.append(exits, own_exits[fresh])
        bounds, exits = _short(bounds, exits)
        return pd.DataFrame({"_key": [pdf["_key"].iloc[0]], "_chunk": [above], "_bounds": [bounds], "_exits": [exits]})

    group = F.floor(F.col("_chunk") / CHUNKS_PER_GROUP)
    return maps.groupBy("_key", group).applyInPandas(compose, _MAP)


def _entries(maps: DataFrame, above: DataFrame, window: int) -> DataFrame:
    """Rows (_key, _chunk, _free) of a level from those of the level above."""

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        free, out = int(pdf["_free"].iloc[0]), []
        for bounds, exits in zip(pdf["_bounds"], pdf["_exits"], strict=True):
            out.append(free)
            i = int(np.searchsorted(np.asarray(bounds), free, side="left"))
            if i < len(bounds):
                free = int(exits[i]) + window
        return pd.DataFrame({"_key": pdf["_key"], "_chunk": pdf["_chunk"], "_free": out})

    group = F.floor(F.col("_chunk") / CHUNKS_PER_GROUP)
    same = maps["_key"].eqNullSafe(above["_above"]) & (group == above["_group"])
    return maps.join(above, same).groupBy("_key", "_group").applyInPandas(descend, "_key string, _chunk bigint, _free bigint")


def _chunk_entries(maps: DataFrame, window: int, start: DataFrame | None) -> DataFrame:
    """From when each chunk may keep events: up the levels by composition, down again with the entries.

    A level puts ``CHUNKS_PER_GROUP`` maps of a key together, so no task sees more of a key than that many short lists,
    however long the key's history is. ``start`` (_key, _free) has the entries of keys with a past.
    """
    own = kept(maps, "chunks")
    first, last = own.agg(F.min("_chunk"), F.max("_chunk")).first()
    first, span = first or 0, (last or 0) - (first or 0)
    levels = [own.withColumn("_chunk", F.col("_chunk") - first)]
    while span := span // CHUNKS_PER_GROUP:
        levels.append(kept(_composed(levels[-1], len(levels) - 1, window, first), "chunks"))
    group = F.floor(F.col("_chunk") / CHUNKS_PER_GROUP)
    top = levels[-1].select("_key", group.alias("_group")).distinct()
    if start is None:
        entries = top.select(F.col("_key").alias("_above"), "_group", F.lit(_FREE).alias("_free"))
    else:
        past = start.select(F.col("_key").alias("_above"), F.col("_free").alias("_past"))
        entries = top.join(past, top["_key"].eqNullSafe(past["_above"]), "left").select(
            F.col("_key").alias("_above"), "_group", F.coalesce("_past", F.lit(_FREE)).alias("_free")
        )
    for level in reversed(levels):
        found = _entries(level, entries, window)
        entries = found.select(F.col("_key").alias("_above"), F.col("_chunk").alias("_group"), "_free")
    return found.withColumn("_chunk", F.col("_chunk") + first)


def _kept_ids(key, ts, chunk, row_id, df: DataFrame, window: int, start: DataFrame | None = None) -> DataFrame:
    """Rows (_key, _ts, _id) of the kept events. See ``kept_rows``."""

    def keep(events: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        events = events.sort_values("_ts")
        times, free, found = events["_ts"].to_numpy(), int(entry["_free"].iloc[0]), []
        i = int(np.searchsorted(times, free, side="left"))
        while i < len(times):
            found.append(i)
            i = int(np.searchsorted(times, times[i] + window, side="left"))
        return events.iloc[found][["_key", "_ts", "_id"]]

    events = (
        df.select(key.alias("_key"), ts.alias("_ts"), chunk.alias("_chunk"), row_id.alias("_id"))
        .groupBy("_key", "_chunk", "_ts")
        .agg(F.min("_id").alias("_id"))
    )
    events = kept(events, "events")
    entries = _chunk_entries(_chunk_maps(events, window), window, start)
    id_type = events.schema["_id"].dataType.simpleString()
    return (
        events.groupBy("_key", "_chunk")
        .cogroup(entries.groupBy("_key", "_chunk"))
        .applyInPandas(keep, f"_key string, _ts bigint, _id {id_type}")
    )


def kept_rows(
    df: DataFrame,
    key: str = "group_key",
    ts: str = "ts",
    row_id: str = "incident_id",
    window_seconds: int = DEDUP_SECONDS,
    last_kept: DataFrame | None = None,
) -> DataFrame:
    """Rows (``row_id``, ``kept_key``, ``kept_micros``) that follow the last *kept* row of their key by the window or more.

    Keeping is a chain (a kept row starts a new window, a dropped one does not), yet no
    key is ever walked in one place. Time is cut into chunks. Each chunk first tells, for
    every moment its predecessor could leave it in, what its own last kept row would be;
    there are at most as many as events in one window. Neighbouring chunks are composed in
    levels, at most CHUNKS_PER_GROUP in a task, the entries come down again, and the kept rows
    follow per chunk. ``last_kept`` (``kept_key``, ``kept_micros``) goes on from earlier rows: those before
    it, out of order, are not kept.
    """
    micros = window_seconds * 1_000_000
    at = F.unix_micros(instant(ts))
    chunk = F.floor(at / F.lit(micros * CHUNK_WINDOWS)).cast("bigint")
    timed = df.where(at.isNotNull())
    start = None
    if last_kept is not None:
        start = last_kept.select(F.col("kept_key").alias("_key"), (F.col("kept_micros") + micros).alias("_free"))
    found = _kept_ids(F.col(key).cast("string"), at, chunk, F.col(row_id), timed, micros, start)
    return found.select(F.col("_id").alias(row_id), F.col("_key").alias("kept_key"), F.col("_ts").alias("kept_micros"))


def mark_duplicates(
    df: DataFrame,
    key: str = "group_key",
    ts: str = "ts",
    row_id: str = "incident_id",
    window_seconds: int = DEDUP_SECONDS,
    last_kept: DataFrame | None = None,
) -> DataFrame:
    """Add ``duplicate``: the row follows the last *kept* row of its key by less than the window.

    A row without a time is never a duplicate.
    """
    found = kept_rows(df, key, ts, row_id, window_seconds, last_kept).select(row_id, F.lit(True).alias("_kept"))
    return (
        df.join(found, row_id, "left")
        .withColumn("duplicate", F.col("_kept").isNull() & F.col(key).isNotNull() & instant(ts).isNotNull())
        .drop("_kept")
    )


def register(
    results: DataFrame,
    maintenance: DataFrame | None = None,
    ignore_rules: DataFrame | None = None,
    dedup_seconds: int | None = DEDUP_SECONDS,
) -> DataFrame:
    """Incidents of monitor results: suppressed, then ignored, then de-duplicated.

    Each step lowers the severity to INFO and puts its tag before the message.
    """
    out = from_results(results)

    def tag(df: DataFrame, hits: DataFrame, label: str, when_hit: bool = True) -> DataFrame:
        """Tag the rows that have their like in ``hits``, or those without."""
        same = [df[c].eqNullSafe(hits[c]) for c in hits.columns]
        marked = df.join(hits.withColumn("_hit", F.lit(True)), same, "left").select(*(df[c] for c in df.columns), "_hit")
        hit = F.col("_hit").isNotNull() if when_hit else F.col("_hit").isNull()
        return marked.withColumns(
            {
                "severity": F.when(hit, F.lit(INFO)).otherwise(F.col("severity")),
                "message": F.when(hit, F.concat(F.lit(f"[{label}] "), "message")).otherwise(F.col("message")),
            }
        ).drop("_hit")

    # Whether a row is hit hangs on these columns alone, so results that share an id are told apart by them.
    if maintenance is not None:
        out = tag(out, small(_sheltered(out.select("monitor_id", "ts"), maintenance).distinct()), "SUPPRESSED")
    if ignore_rules is not None:
        out = tag(out, small(_matched(out.select("monitor_id", "message", "ts"), ignore_rules).distinct()), "IGNORED")
    if dedup_seconds is not None:
        # Tags do not matter for keeping, so only keys and times are walked.
        times = from_results(results).select("group_key", "ts", F.unix_micros("ts").alias("_micros"))
        found = kept_rows(times, row_id="_micros", window_seconds=dedup_seconds)
        found = found.select(F.col("kept_key").alias("group_key"), F.timestamp_micros("kept_micros").alias("ts"))
        out = tag(out, small(found), "DEDUP", when_hit=False)
    return out


def apply_actions(incidents: DataFrame, actions: DataFrame) -> DataFrame:
    """Incident state after an append-only log (incident_id, action, at, actor, until, level).

    Where incidents and log both have a ``result_id``, an entry is for that result alone, else for all that share the id.
    Actions: ``resolve``, ``acknowledge``, ``snooze``, ``escalate``. The latest entry of a
    kind wins; folding is one partial aggregate per incident.
    """
    at = instant("at")
    of = lambda action, value: F.when(F.col("action") == action, value)
    latest = lambda action, value: F.max_by(of(action, value), of(action, at))
    owned = (F.col("action") == "acknowledge") & F.col("actor").isNotNull()
    key = [c for c in ("incident_id", "result_id") if c in incidents.columns and c in actions.columns]
    folded = actions.groupBy(*key).agg(
        F.max(of("resolve", at)).alias("_resolved_at"),
        F.max(of("acknowledge", at)).alias("_acked_at"),
        F.max_by(F.when(owned, F.col("actor")), F.when(owned, at)).alias("_owner"),
        latest("snooze", instant("until")).alias("_until"),
        latest("escalate", F.col("level")).alias("_level"),
    )
    return (
        incidents.join(folded, key, "left")
        .withColumns(
            {
                "resolved": F.col("resolved") | F.col("_resolved_at").isNotNull(),
                "resolved_at": F.coalesce("_resolved_at", "resolved_at"),
                "acked": F.col("acked") | F.col("_acked_at").isNotNull(),
                "acknowledged_at": F.coalesce("_acked_at", "acknowledged_at"),
                "owner": F.coalesce("_owner", "owner"),
                "snoozed_until": F.coalesce("_until", "snoozed_until"),
                "escalation_level": F.coalesce(F.col("_level").cast("int"), F.col("escalation_level")),
            }
        )
        .drop("_resolved_at", "_acked_at", "_owner", "_until", "_level")
    )


def list_incidents(
    incidents: DataFrame, status: str | None = None, monitor_id: str | None = None
) -> DataFrame:
    """Incidents that are ``open`` or ``resolved`` (anything else: all), of one monitor if named."""
    out = incidents
    if status == "open":
        out = out.where(~F.col("resolved"))
    elif status == "resolved":
        out = out.where(F.col("resolved"))
    return out if monitor_id is None else out.where(F.col("monitor_id") == monitor_id)


def open_counts(incidents: DataFrame) -> DataFrame:
    """Rows (monitor_id, open, total)."""
    return incidents.groupBy("monitor_id").agg(
        F.count_if(~F.col("resolved")).alias("open"), F.count(F.lit(1)).alias("total")
    )


@dataclass(frozen=True)
class Channel:
    """``kind``: ``text``, ``json``, ``chat``, ``pager`` or ``webhook``."""

    name: str
    kind: str
    routing_key: str | None = None


def alert_payloads(incidents: DataFrame, channels: Sequence[Channel]) -> DataFrame:
    """Rows (incident_id, channel, kind, payload) for every incident above INFO."""
    severity, message, monitor = F.col("severity"), F.col("message"), F.col("monitor_id")
    hints = F.col("root_cause_hints")
    quoted = F.concat(
        F.lit("["),
        F.array_join(F.transform(hints, lambda h: F.concat(F.lit('"'), F.regexp_replace(h, r'(["\\])', r"\\$1"), F.lit('"'))), ", "),
        F.lit("]"),
    )
    lines = F.array_join(F.transform(hints, lambda h: F.concat(F.lit("\n  └─ "), h)), "")
    whole = F.to_json(F.struct(*incidents.columns))
    bodies = {
        "text": lambda c: F.concat(
            F.format_string(
                "[%s] [%s] %s — monitor=%s hints=%s", iso_utc(F.col("ts")), severity, message, monitor, quoted
            ),
            lines,
        ),
        "json": lambda c: whole,
        "chat": lambda c: F.to_json(
            F.struct(F.format_string("[%s] %s — monitor=%s", severity, message, monitor).alias("text"))
        ),
        "pager": lambda c: F.to_json(
            F.struct(
                F.lit(c.routing_key).alias("routing_key"),
                F.lit("trigger").alias("event_action"),
                F.struct(
                    message.alias("summary"), F.lit("critical").alias("severity"), monitor.alias("source")
                ).alias("payload"),
            )
        ),
        "webhook": lambda c: whole,
    }
    sent = [
        F.struct(
            F.lit(c.name).alias("channel"), F.lit(c.kind).alias("kind"), bodies[c.kind](c).alias("payload")
        )
        for c in channels
    ]
    return incidents.where(severity != INFO).select("incident_id", F.inline(F.array(*sent)))
