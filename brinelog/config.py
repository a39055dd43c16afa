"""Settings of a store: defaults, a JSON file, environment variables, explicit values - later ones win."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, fields, replace

log = logging.getLogger("brinelog")
PREFIX = "BRINELOG_"
LEVELS = {"debug", "info", "warn", "error"}
#: Accepted so that configuration files can be shared; Spark's own settings decide these things here.
UNUSED = ("max_build_buffer_mb", "cache_index_blocks", "max_open_files", "compaction_max_concurrent", "shutdown_timeout_ms", "stats_sampling_interval_ms", "doctor_bundle_max_mb")


@dataclass(frozen=True)
class Config:
    data_dir: str = "./data"
    sst_dir: str = ""
    manifest_path: str = ""
    # what is kept in memory before it becomes a run
    memtable_max_bytes: int = 64 << 20
    max_immutable_tables: int = 4
    memtable_size_overhead_bytes_per_entry: int = 32
    # layout of runs
    block_size: int = 8192
    restart_interval: int = 16
    bloom_false_positive: float = 0.01
    compression: str = "snappy"
    # log
    wal_segment_roll_bytes: int = 128 << 20
    wal_fsync_every_n: int = 1
    # compaction
    size_tiered_fan_in: int = 4
    size_tiered_size_ratio: float = 2.0
    tombstone_grace_seconds: int = 86400
    l0_compaction_trigger: int = 8
    l0_stop_writes: int = 20
    compaction_max_concurrent: int = 1
    compaction_io_mb_per_s: int = 0
    # service
    bg_tick_ms: int = 500
    http_listen_addr: str = "127.0.0.1:9090"
    metrics_enabled: bool = True
    log_level: str = "info"
    publish_log_level: str = "info"
    shutdown_timeout_ms: int = 5000
    stats_sampling_interval_ms: int = 1000
    doctor_bundle_max_mb: int = 10
    max_build_buffer_mb: int = 32
    block_cache_mb: int = 64
    cache_index_blocks: bool = True
    max_open_files: int = 1024

    @property
    def runs_dir(self) -> str:
        return self.sst_dir or os.path.join(self.data_dir, "runs")

    @property
    def manifest_file(self) -> str:
        return self.manifest_path or os.path.join(self.data_dir, "MANIFEST.json")

    @property
    def log_dir(self) -> str:
        return os.path.join(self.data_dir, "wal")

    def with_values(self, values: dict[str, object]) -> Config:
        """A copy with some settings replaced; texts are converted, unknown names are reported and passed over."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        good: dict[str, object] = {}
        for name, value in values.items():
            if name not in kinds:
                log.warning("unknown setting %s", name)
                continue
            if kinds[name] is bool and isinstance(value, str):
                value = value.strip().lower() in ("1", "true", "yes", "on")
            good[name] = kinds[name](value)
        out = replace(self, **good)
        out.check()
        return out

    def check(self) -> None:
        from .errors import InvalidArgument

        if self.memtable_max_bytes < 1 or self.block_size < 1 or self.restart_interval < 1:
            raise InvalidArgument("sizes must be positive")
        if not 0 < self.bloom_false_positive < 1:
            raise InvalidArgument("bloom_false_positive lies between 0 and 1")
        if self.log_level not in LEVELS or self.publish_log_level not in LEVELS:
            raise InvalidArgument(f"a log level is one of {sorted(LEVELS)}")
        if self.compression not in ("off", "none", "snappy", "lz4", "zstd", "gzip"):
            raise InvalidArgument(f"unknown compression {self.compression}")

    @property
    def codec(self) -> str:
        return {"off": "none", "lz4": "lz4_raw"}.get(self.compression, self.compression)

    def text(self) -> str:
        return "\n".join(f"{k} = {v}" for k, v in sorted(asdict(self).items()))


def load(path: str | None = None, env: dict[str, str] | None = None, **explicit: object) -> Config:
    """Settings from a file (if it is there), the environment (BRINELOG_NAME) and explicit values."""
    values: dict[str, object] = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            values |= json.load(f)
    known = {f.name for f in fields(Config)}
    for name, value in (os.environ if env is None else env).items():
        if name.startswith(PREFIX) and name[len(PREFIX) :].lower() in known:
            values[name[len(PREFIX) :].lower()] = value
    return Config().with_values(values | explicit)
