"""The object lifecycle: a transition table, folds over triggers, scans by policy, use cases.

A fold is a composition of functions from state to state. Triggers are dealt by
ranges of (object, time), each of about ``PIECE`` of them; those of an object in a
range are composed to one function, and an object's few functions then in order,
so that an object with any number of events meets no task in one array.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import hashing
from tessera.model import STATES, TRANSITIONS
from tessera.operators import store


#: Triggers of a range.
PIECE = 50_000


class GuardDenied(Exception):
    """A guard said no, and the caller asked to hear of it."""


@dataclass
class Registry:
    """Transitions by (trigger, from); guards are conditions on a row, all of which must hold."""

    rows: dict[tuple[str, str], str] = field(default_factory=dict)
    guards: dict[tuple[str, str], list[Column]] = field(default_factory=dict)
    actions: dict[tuple[str, str], list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def on(self, trigger: str) -> _On:
        return _On(self, trigger)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t, a, b) for (t, a), b in self.rows.items()], "trigger string, from_state string, to_state string")

    def next_state(self, state: Column, trigger: Column) -> Column:
        """The state after; the same where nothing is registered or a guard says no."""
        out = None
        for (t, a), b in self.rows.items():
            test = (trigger == t) & (state == a)
            for g in self.guards.get((t, a), []):
                test = test & F.coalesce(g, F.lit(False))
            out = F.when(test, b) if out is None else out.when(test, b)
        return state if out is None else out.otherwise(state)


@dataclass
class _On:
    registry: Registry
    trigger: str
    state: str = ""

    def from_(self, state: str) -> _On:
        self.state = state
        return self

    def to(self, state: str) -> _On:
        key = (self.trigger, self.state)
        if key in self.registry.rows:
            raise ValueError(f"{key} is registered already")
        self.registry.rows[key] = state
        return self

    def guard(self, test: Column) -> _On:
        self.registry.guards.setdefault((self.trigger, self.state), []).append(test)
        return self

    def do(self, action: Callable[[DataFrame], DataFrame]) -> _On:
        self.registry.actions.setdefault((self.trigger, self.state), []).append(action)
        return self


def default_registry(archive: Column | None = None, expire: Column | None = None) -> Registry:
    """The default transitions; policies guard Archive and Expire where given."""
    out = Registry()
    for trigger, a, b in TRANSITIONS:
        step = out.on(trigger).from_(a).to(b)
        policy = {"Archive": archive, "Expire": expire}.get(trigger)
        if policy is not None:
            step.guard(policy)
    return out


def fire(rows: DataFrame, registry: Registry, trigger: str | Column, throw: bool = False) -> DataFrame:
    """``rows`` with the state after ``trigger``, the former state and whether it moved; actions change the rows that did."""
    t = F.lit(trigger) if isinstance(trigger, str) else trigger
    after = rows.withColumn("from_state", F.col("state")).withColumn("state", registry.next_state(F.col("state"), t))
    after = after.withColumn("moved", F.col("state") != F.col("from_state"))
    if throw and isinstance(trigger, str):
        known = [a for (x, a) in registry.guards if x == trigger]
        if not after.where(F.col("from_state").isin(known) & ~F.col("moved")).isEmpty():
            raise GuardDenied(trigger)
    if isinstance(trigger, str):
        for (x, a), actions in registry.actions.items():
            if x == trigger:
                for action in actions:
                    moved = F.col("moved") & (F.col("from_state") == a)
                    after = action(after.where(moved)).unionByName(after.where(~moved))
    return after


def transition_log(moved: DataFrame, trigger: str | Column) -> DataFrame:
    """A topic and a log line for every row that ``fire`` moved."""
    t = F.lit(trigger) if isinstance(trigger, str) else trigger
    rows = moved.where("moved")
    return rows.select("content_hash", hashing.topic(t).alias("topic"), hashing.transition_line("from_state", t, "state").alias("line"))


def triggers_of_events(events: DataFrame) -> DataFrame:
    """(object_id, ts, seq, trigger) from the test table ``events``."""
    usual = {"signup": "Put", "view": "Index", "click": "Audit", "purchase": "Publish", "error": "Archive"}
    fifth = {"signup": "Restore", "view": "Expire", "click": "Delete", "purchase": "Purge"}
    t = None
    for names, test in ((fifth, F.col("event_id") % 5 == 0), (usual, F.lit(True))):
        for kind, trigger in names.items():
            when = test & (F.col("event_type") == kind)
            t = F.when(when, trigger) if t is None else t.when(when, trigger)
    return events.select(F.col("user_id").alias("object_id"), "ts", F.col("event_id").alias("seq"), t.alias("trigger"))


def _step(transitions) -> Column:
    """trigger -> the array of what each state becomes, states by their place."""
    triggers = sorted({t for t, _, _ in transitions})
    place = {s: i for i, s in enumerate(STATES)}
    pairs = []
    for t in triggers:
        after = list(range(len(STATES)))
        for x, a, b in transitions:
            if x == t:
                after[place[a]] = place[b]
        pairs += [F.lit(t), F.array(*map(F.lit, after))]
    return F.create_map(*pairs)


def fold(steps: DataFrame, initial: DataFrame | None = None, transitions=TRANSITIONS, start: str = "Pending") -> DataFrame:
    """(object_id, state, n_steps): the state of each object after its triggers in the order of (ts, seq).

    ``initial`` has (object_id, state) of objects seen before; the others start from ``start``.
    """
    same = F.array(*map(F.lit, range(len(STATES))))
    ranges = max(1, -(-steps.count() // PIECE))
    dealt = steps.select("object_id", "ts", "seq", "trigger").repartitionByRange(ranges, "object_id", "ts", "seq")
    table = dealt.select("object_id", F.spark_partition_id().alias("piece"), F.struct("ts", "seq", "trigger").alias("e"))
    sorted_ = F.array_sort(F.collect_list("e"))
    pieces = table.groupBy("object_id", "piece").agg(sorted_.alias("es"), F.count("*").alias("n"))
    pieces = pieces.withColumn("step", _step(transitions))
    after = F.aggregate("es", same, lambda f, e: F.when(F.map_contains_key(F.col("step"), e["trigger"]), F.transform(f, lambda s: F.get(F.element_at(F.col("step"), e["trigger"]), s))).otherwise(f))
    pieces = pieces.select("object_id", "n", F.struct("piece", after.alias("f")).alias("d"))
    objects = pieces.groupBy("object_id").agg(F.array_sort(F.collect_list("d")).alias("ds"), F.sum("n").alias("n_steps"))
    if initial is None:
        first = F.lit(start)
    else:
        objects = objects.join(initial.select("object_id", F.col("state").alias("__was")), "object_id", "left")
        first = F.coalesce("__was", F.lit(start))
    names = F.array(*map(F.lit, STATES))
    began = F.array_position(names, first).cast("int") - 1
    ended = F.aggregate("ds", began, lambda s, d: F.get(d["f"], s))
    return objects.select("object_id", F.get(names, ended).alias("state"), "n_steps")


def versions(saves: DataFrame) -> DataFrame:
    """(content_hash, state, version) from (content_hash, state, seq): the last state saved and how many were."""
    return saves.groupBy("content_hash").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("version"))


def load_states(hashes: DataFrame, states: DataFrame) -> DataFrame:
    """The stored state of each hash, Pending where none is."""
    return hashes.join(states.select("content_hash", "state"), "content_hash", "left").withColumn("state", F.coalesce("state", F.lit("Pending")))


def sync_index(entries: DataFrame, moved: DataFrame, as_of: datetime) -> DataFrame:
    """Entries with the states (and tiers, if given) of ``moved``; blank hashes are skipped."""
    names = [c for c in ("content_hash", "state", "tier") if c in moved.columns]
    return store.patch(entries, moved.where(F.length(F.trim("content_hash")) > 0).select(*names), as_of)


def scan(entries: DataFrame, archive: Column, expire: Column) -> DataFrame:
    """What the policies ask of available objects, in all namespaces: (content_hash, namespace_id, trigger)."""
    trigger = F.when(expire, "Expire").when(archive, "Archive")
    rows = entries.where("state = 'Available'").withColumn("trigger", trigger)
    return rows.where("trigger is not null").select("content_hash", "namespace_id", "trigger")


def put(entries: DataFrame, blocks: DataFrame, puts: DataFrame, as_of: datetime, moderated: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store contents (namespace_id, content, ..): the new blocks, the entries after, and the result of each put.

    The last of equal contents in a batch (by ``seq``, if it has one) makes the
    row. A blank namespace is an error. Rows that ``moderated`` refuses are rolled
    back: their block is kept, and an entry that was there before stays.
    """
    if not puts.where("namespace_id is null or trim(namespace_id) = ''").isEmpty():
        raise ValueError("a put needs a namespace")
    rows = puts.withColumn("content_hash", hashing.content_hash("content")).withColumn("size_bytes", F.octet_length("content").cast("long"))
    rows = rows.withColumn("ok", F.lit(True) if moderated is None else F.coalesce(moderated, F.lit(False)))
    known = blocks.select("content_hash", F.lit(True).alias("known"))
    fresh = rows.select("content_hash", "content").dropDuplicates(["content_hash"]).join(known, "content_hash", "left_anti")
    good = rows.where("ok").withColumn("state", F.lit("Available"))
    if "seq" in puts.columns:
        good = store.latest(good, [F.col("seq")])
    made = store.rows_of_puts(good, as_of)
    result = rows.join(known, "content_hash", "left").select("content_hash", "size_bytes", F.col("ok").alias("succeeded"), F.coalesce("known", F.lit(False)).alias("deduplicated"))
    return blocks.unionByName(fresh.select(*blocks.columns)), store.upsert(entries, made), result


def get(entries: DataFrame, blocks: DataFrame, requests: DataFrame, offset: int = 0, length: int = -1) -> DataFrame:
    """(content_hash, content, length, content_type) of each requested hash; no content where it isn't available."""
    found = entries.where("state = 'Available'").select("content_hash", "content_type").join(blocks.select("content_hash", "content"), "content_hash")
    out = requests.select("content_hash").join(found, "content_hash", "left")
    part = hashing.byte_range("content", offset, length)
    return out.select("content_hash", part.alias("content"), F.octet_length(part).cast("long").alias("length"), "content_type")


def command(entries: DataFrame, hashes: DataFrame, trigger: str, as_of: datetime, tier: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fire Delete, Archive, Restore or Purge for hashes: the entries after, and whether each reached its target.

    Archive also sets the tier. Hashes without an entry are taken as Available.
    """
    targets = {b for t, _, b in TRANSITIONS if t == trigger}
    now = hashes.select("content_hash").distinct().join(entries.select("content_hash", "state"), "content_hash", "left")
    now = now.withColumn("state", F.coalesce("state", F.lit("Available")))
    after = fire(now, default_registry(), trigger)
    change = after.where("moved").select("content_hash", "state", *([F.lit(tier).alias("tier")] if tier else []))
    return store.patch(entries, change, as_of), after.select("content_hash", "state", F.col("state").isin(*targets).alias("succeeded"))


def delete(entries: DataFrame, hashes: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return command(entries, hashes, "Delete", as_of)


def archive(entries: DataFrame, hashes: DataFrame, as_of: datetime, tier: str = "Cold") -> tuple[DataFrame, DataFrame]:
    return command(entries, hashes, "Archive", as_of, tier)


def restore(entries: DataFrame, hashes: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return command(entries, hashes, "Restore", as_of)


def observe(moved: DataFrame, observers: list[Callable[[DataFrame], None]], fail_fast: bool = False) -> list[Exception]:
    """Tell observers of the rows that moved. One that fails doesn't keep the others from hearing, unless asked to."""
    failed: list[Exception] = []
    rows = moved.where("moved")
    for hear in observers:
        try:
            hear(rows)
        except Exception as e:  # noqa: BLE001  whatever an observer raises
            if fail_fast:
                raise
            failed.append(e)
    return failed


def persist(save: Callable[[], None], retries: int = 3, backoff: float = 0.05) -> int:
    """Run ``save`` again after an error, up to ``retries`` times; returns how many tries it took."""
    for attempt in range(retries + 1):
        try:
            save()
            return attempt + 1
        except Exception:  # noqa: BLE001  the last one is raised
            if attempt == retries:
                raise
            time.sleep(backoff * (attempt + 1))
    raise AssertionError
