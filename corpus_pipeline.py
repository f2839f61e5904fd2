"""From raw documents to training sequences; the stages are those of ``turnmill.llm.pipeline``."""

from turnmill.llm.pipeline import (
    ORACLE_SQL,
    STAGES,
    benchmark_decontamination,
    line_deduplication,
    minhash_near_dedup,
    quality_classifier,
    run,
    sequence_packing,
)

__all__ = ["ORACLE_SQL", "STAGES", "benchmark_decontamination", "line_deduplication", "minhash_near_dedup", "quality_classifier", "run", "sequence_packing"]
