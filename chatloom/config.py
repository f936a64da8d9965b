"""Tunable sizes and limits, passed to operators by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions import fixed
from .operators.retrieval import EXTRACTION_LIMITS, SECTION_LIMITS


@dataclass(frozen=True)
class Config:
    """Defaults of the reference behaviour; change a copy with ``dataclasses.replace``."""

    extraction_version: int = fixed.EXTRACTION_VERSION
    l1_group_size: int = fixed.L1_GROUP_SIZE
    l2_group_size: int = fixed.L2_GROUP_SIZE
    l3_group_size: int = fixed.L3_GROUP_SIZE
    l3_start: int = fixed.L3_START
    stability_buffer: int = fixed.STABILITY_BUFFER
    checkpoint_interval: int = fixed.CHECKPOINT_INTERVAL
    checkpoint_keep: int = fixed.CHECKPOINT_KEEP
    vector_top_k: int = 100
    vector_threshold: float = 0.2
    section_limits: tuple = SECTION_LIMITS
    extraction_limits: dict = field(default_factory=lambda: dict(EXTRACTION_LIMITS))
    token_cap: int | None = None  # 4096 keeps the head and tail of very long fields

    def __post_init__(self):
        if not fixed.L1_GROUP_MIN <= self.l1_group_size <= fixed.L1_GROUP_MAX:
            raise ValueError("l1_group_size must be between 2 and 50")
        if not fixed.L2_GROUP_MIN <= self.l2_group_size <= fixed.L2_GROUP_MAX:
            raise ValueError("l2_group_size must be between 4 and 200")
        if not 10 <= self.vector_top_k <= 200:
            raise ValueError("vector_top_k must be between 10 and 200")
