"""Schemas of the tables that operators pass on, and validated settings."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Roles a turn may have.
ROLES = ("system", "user", "assistant", "tool")
SOURCE_TYPES = ("pdf", "markdown", "code", "text")

TURNS = "array<struct<role:string,content:string>>"
#: ord is explicit: a table has no order of its own.
CONVERSATION = f"conv_id string, source_chunk_id string, ord bigint, turns {TURNS}, reasoning_trace string, confidence_score double, judge_overall double"
METADATA = "struct<source_type:string,file_path:string,file_name:string,title:string,author:string,language:string,repository_url:string,module_path:string,section_headers:array<string>,page_number:int,line_start:int,line_end:int,custom_tags:map<string,string>>"
CHUNK = f"chunk_id string, content string, metadata {METADATA}, tokens int, embedding array<double>"


def _need(holds: bool, what: str) -> None:
    if not holds:
        raise ValueError(what)


@dataclass(frozen=True)
class ChunkConfig:
    """Size splitting: ``0 <= overlap < size``."""

    size: int = 1000
    overlap: int = 200
    mode: str = "auto"
    child_size: int = 256
    child_overlap: int = 50
    lead_chars: int = 300
    breakpoint: str = "percentile"
    threshold: float = 75.0

    def __post_init__(self) -> None:
        _need(self.size > 0, "size must be positive")
        _need(0 <= self.overlap < self.size, "overlap must be at least 0 and below size")
        _need(0 <= self.child_overlap < self.child_size, "child overlap must be at least 0 and below child size")
        _need(self.mode in ("auto", "markdown", "recursive", "code", "semantic", "parent_child", "late"), f"unknown chunker: {self.mode}")
        _need(self.breakpoint in ("percentile", "gradient", "fixed"), f"unknown breakpoint mode: {self.breakpoint}")


@dataclass(frozen=True)
class IngestConfig:
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    tables: str = "both"
    context_prefix: bool = False
    embed: bool = False
    pii: bool = False
    redact: bool = True
    structured: bool = False

    def __post_init__(self) -> None:
        _need(self.tables in ("markdown", "sentences", "both"), f"unknown table mode: {self.tables}")


@dataclass(frozen=True)
class SplitConfig:
    """Ratios of a split; they sum to 1 within a hundredth."""

    train: float = 0.9
    validation: float = 0.05
    test: float = 0.05
    seed: int = 42

    def __post_init__(self) -> None:
        _need(min(self.train, self.validation, self.test) >= 0, "ratios must not be negative")
        _need(abs(self.train + self.validation + self.test - 1) <= 0.01, "ratios must sum to 1.0")


@dataclass(frozen=True)
class EvalThresholds:
    min_mean_confidence: float = 0.5
    min_valid_rate: float = 0.8
    max_contamination_rate: float = 0.1
    min_judge_overall: float = 5.0
