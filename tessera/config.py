"""Options and their validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta


@dataclass
class PoolOptions:
    pool_id: str = ""
    root_path: str = ""
    tier: str = "Hot"
    capacity_bytes: int | None = None
    priority: int = 0
    enabled: bool = True


@dataclass
class PipelineOptions:
    buffer_size: int = 64 * 1024
    max_batch_size: int = 64
    read_timeout: timedelta = timedelta(seconds=30)
    write_timeout: timedelta = timedelta(seconds=60)
    enable_zero_copy: bool = True
    max_concurrency: int = 64


@dataclass
class ChunkingOptions:
    enabled: bool = False
    chunk_size_bytes: int = 8 * 1024 * 1024


@dataclass
class StorageOptions:
    pools: list[PoolOptions] = field(default_factory=list)
    pipeline: PipelineOptions = field(default_factory=PipelineOptions)
    chunking: ChunkingOptions = field(default_factory=ChunkingOptions)
    hash_algorithm: str = "SHA-256"
    deduplication: str = "Global"
    verify_after_write: bool = False


@dataclass
class StateMachineOptions:
    throw_on_guard_denied: bool = False
    fail_fast_on_observer_error: bool = False
    transition_timeout: timedelta = timedelta(seconds=30)
    audit_denied_transitions: bool = True
    max_optimistic_retries: int = 3
    retry_backoff: timedelta = timedelta(milliseconds=50)


@dataclass
class ShardingOptions:
    enabled: bool = False
    shard_count: int = 1


@dataclass
class IndexOptions:
    consistency: str = "Strong"
    default_page_size: int = 100
    max_page_size: int = 1000
    sharding: ShardingOptions = field(default_factory=ShardingOptions)


@dataclass
class BackupTargetOptions:
    target_id: str = ""
    type: str = "local"
    root_path: str | None = None
    enabled: bool = True


@dataclass
class BackupScheduleOptions:
    schedule_id: str = ""
    cron: str = ""
    kind: str = "Incremental"
    target_id: str = ""
    namespace_id: str | None = None
    enabled: bool = True


@dataclass
class BackupOptions:
    targets: list[BackupTargetOptions] = field(default_factory=list)
    schedules: list[BackupScheduleOptions] = field(default_factory=list)
    default_target_id: str | None = None
    max_concurrency: int = 4
    max_retries: int = 3


@dataclass
class ReplicationOptions:
    factor: int = 3
    write_quorum: int = 2
    read_quorum: int = 2


@dataclass
class ClusterOptions:
    role: str = "Hybrid"
    node_id: str = ""
    advertise_address: str | None = None
    seed_nodes: list[str] = field(default_factory=list)
    replication: ReplicationOptions = field(default_factory=ReplicationOptions)


@dataclass
class LifecycleOptions:
    scan_interval: timedelta = timedelta(minutes=5)
    scan_batch_size: int = 1000
    archive_after: timedelta | None = None
    delete_after: timedelta | None = None


@dataclass
class Options:
    state_machine: StateMachineOptions = field(default_factory=StateMachineOptions)
    storage: StorageOptions = field(default_factory=StorageOptions)
    index: IndexOptions = field(default_factory=IndexOptions)
    backup: BackupOptions = field(default_factory=BackupOptions)
    cluster: ClusterOptions = field(default_factory=ClusterOptions)
    lifecycle: LifecycleOptions = field(default_factory=LifecycleOptions)


@dataclass(frozen=True)
class Problem:
    domain: str
    field: str
    message: str


def validate(options: Options | None) -> list[Problem]:
    """What is wrong with the options; nothing if they are valid."""
    if options is None:
        return [Problem("root", "options", "options are missing")]
    out: list[Problem] = []

    def need(holds: bool, domain: str, name: str, message: str) -> None:
        if not holds:
            out.append(Problem(domain, name, message))

    machine, storage, index, backup, cluster, life = options.state_machine, options.storage, options.index, options.backup, options.cluster, options.lifecycle
    need(machine.transition_timeout > timedelta(0), "state_machine", "transition_timeout", "must be above zero")
    need(machine.max_optimistic_retries >= 0, "state_machine", "max_optimistic_retries", "can't be negative")
    on = [p for p in storage.pools if p.enabled]
    need(bool(on), "storage", "pools", "at least one enabled pool is needed")
    need(all(p.root_path.strip() for p in on), "storage", "root_path", "enabled pools need a root path")
    need(len({p.pool_id for p in on}) == len(on), "storage", "pool_id", "ids of enabled pools must differ")
    need(storage.pipeline.buffer_size > 0, "storage", "buffer_size", "must be above zero")
    need(storage.pipeline.max_concurrency > 0, "storage", "max_concurrency", "must be above zero")
    need(index.default_page_size <= index.max_page_size, "index", "default_page_size", "can't exceed the maximum")
    need(index.max_page_size > 0, "index", "max_page_size", "must be above zero")
    need(index.sharding.shard_count > 0, "index", "shard_count", "must be above zero")
    known = {t.target_id for t in backup.targets}
    for s in backup.schedules:
        need(s.target_id in known, "backup", "schedules", f"schedule {s.schedule_id!r} names an unknown target")
    need(backup.default_target_id is None or backup.default_target_id in known, "backup", "default_target_id", "names an unknown target")
    r = cluster.replication
    need(r.write_quorum + r.read_quorum > r.factor, "cluster", "replication", "quorums must overlap")
    need(bool(cluster.node_id.strip()), "cluster", "node_id", "must not be blank")
    if life.archive_after is not None and life.delete_after is not None:
        need(life.archive_after < life.delete_after, "lifecycle", "archive_after", "must come before delete_after")
    return out


class Notifier:
    """Tells subscribers of new options."""

    def __init__(self, options: Options):
        self.current, self._subscribers = options, {}

    def subscribe(self, hear: Callable[[Options], None]) -> Callable[[], None]:
        """Returns a function that ends the subscription."""
        key = object()
        self._subscribers[key] = hear
        return lambda: self._subscribers.pop(key, None) and None

    def reload(self, options: Options) -> list[Problem]:
        """Invalid options change nothing."""
        problems = validate(options)
        if not problems:
            self.current = options
            for hear in list(self._subscribers.values()):
                hear(options)
        return problems
