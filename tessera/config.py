"""Settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    block_rows: int = 10_000
    replication: int = 3
    machines: int = 10
    group_blocks: int = 10
    shuffle_weight: int = 3
    sample_rows: int = 1_000_000
    small_table: int = 10_000
    #: Rows that one task may sort for an exact median; larger groups are narrowed first.
    median_rows: int = 5_000_000


DEFAULT = Settings()
