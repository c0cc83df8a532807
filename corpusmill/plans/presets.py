"""Presets: settings of whole jobs for common kinds of sources."""

from __future__ import annotations

from dataclasses import dataclass

from corpusmill.schema import ChunkConfig, IngestConfig


@dataclass(frozen=True)
class Preset:
    description: str
    ingest: IngestConfig
    mode: str
    layouts: tuple[str, ...]


PRESETS = {
    "documentation": Preset("manuals and guides, by headers", IngestConfig(ChunkConfig(1000, 200, "markdown"), context_prefix=True), "teach", ("sharegpt", "jsonl")),
    "code": Preset("repositories, by definitions", IngestConfig(ChunkConfig(1500, 200)), "debug", ("chatml", "jsonl")),
    "papers": Preset("long prose, by similarity of sentences", IngestConfig(ChunkConfig(1200, 200, "semantic")), "explain", ("sharegpt", "alpaca")),
    "retrieval": Preset("small children with their parents, embedded", IngestConfig(ChunkConfig(1200, 100, "parent_child"), context_prefix=True, embed=True), "rag_qa", ("rag_qa",)),
    "private": Preset("sources with personal data, redacted", IngestConfig(pii=True), "qa", ("hf_messages",)),
    "preference": Preset("several answers to a source, for preference training", IngestConfig(), "constitutional", ("dpo", "kto", "grpo")),
}
