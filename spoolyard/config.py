"""Queue configuration, checked when it is made."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import INVALID_SHARDS, NOT_IMPLEMENTED, QueueError

LOCAL, GLOBAL = "LOCAL", "GLOBAL"
TYPES = {"string": str, "long": int, "int": int, "json": str}
DEFAULT_SHARDS = 64
RECORD_TTL_S = 2_592_000
META_TTL_S = 5_184_000
BACKENDS = ("parquet",)


@dataclass(frozen=True)
class QueueConfig:
    queue_id: str
    data_type: str = "string"
    shards: int = DEFAULT_SHARDS
    dedupe: bool = True
    record_ttl: int = RECORD_TTL_S
    meta_ttl: int = META_TTL_S
    #: Whether counters and pointers of a shard expire when nothing touches them for meta_ttl; they never do by default.
    meta_expires: bool = False
    client_id: str = "client"
    farm_id: str | None = None
    scope: str = LOCAL
    data_set: str = "data"
    meta_set: str = "meta"
    backend: str = "parquet"

    def __post_init__(self):
        for name in ("queue_id", "client_id", "data_set", "meta_set"):
            if not (getattr(self, name) or "").strip():
                raise ValueError(f"{name} must not be blank")
        if self.data_type not in TYPES:
            raise ValueError(f"data_type must be one of {sorted(TYPES)}")
        if self.record_ttl < -2 or self.meta_ttl < -2:
            raise ValueError("a time to live is -2 or more seconds")
        if self.backend not in BACKENDS:
            raise NotImplementedError(f"backend {self.backend}")
        if self.scope == GLOBAL:
            raise QueueError(NOT_IMPLEMENTED, "scope GLOBAL")
        object.__setattr__(self, "shards", max(1, self.shards))

    @property
    def sharded(self) -> bool:
        return self.shards > 1

    def accepts(self, data: object) -> bool:
        """Exact type equality: a bool is no number, null is nothing."""
        if type(data) is not TYPES[self.data_type]:
            return False
        bits = {"int": 31, "long": 63}.get(self.data_type)
        return bits is None or -(1 << bits) <= data < 1 << bits


def check_shards(stored: int | None, configured: int) -> int:
    """The shard count to store: the larger one. Shrinking, or sharding an unsharded queue, is refused."""
    configured = max(1, configured)
    if stored is None:
        return configured
    if stored > configured:
        raise QueueError(INVALID_SHARDS, "Cannot decrease shards of a queue.")
    if stored <= 1 < configured:
        raise QueueError(INVALID_SHARDS, "Cannot convert unsharded to sharded queue.")
    return max(stored, configured)
