"""Frozen parameters. Values that the study leaves open are ours and are marked so."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Config:
    """One frozen version; a change makes a new version, never a new meaning of an old one."""

    version: str = "m0.1"
    schema_version: str = "v1.1"
    # chunks, in words
    chunk_target: int = 180
    chunk_cap: int = 240
    short_words: int = 40
    brief_words: int = 80
    # BM25 (ours: tokenizer, k1, b and the smoothed idf)
    token_pattern: str = r"[\p{L}\p{N}]+"
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_variant: str = "smoothed"
    # retrieval (k of the fusion is the study's; top_k and radius are ours)
    rrf_k: int = 60
    top_k: int = 10
    neighbor_radius: int = 1
    context_budgets: tuple[int, ...] = (800, 1200, 1800)
    qa_blocks: int = 5
    min_evidence: int = 3
    sample_share: float = 0.1
    # dense stand-in: hashed terms, not an embedding model (ours)
    dense_dim: int = 64
    # a block is at layout risk from so many mathematical signs in a thousand characters on (ours)
    formula_per_mille: float = 20.0
    inactive_dimensions: tuple[str, ...] = ("D03",)
    expected_documents: int = 5
    dimensions: tuple[str, ...] = tuple(f"D{i:02d}" for i in range(1, 11))
    # priority index weights (ours), by scheme: scarcity, momentum, lack of integration
    weights: dict = field(default_factory=lambda: {"primary": (0.4, 0.3, 0.3), "equal": (1 / 3, 1 / 3, 1 / 3), "scarcity": (0.6, 0.2, 0.2)})
    bootstrap_draws: int = 200
    seed: int = 42

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def next_version(self, version: str, **changes) -> Config:
        if version == self.version:
            raise ValueError("a changed configuration needs a new version")
        return replace(self, version=version, **changes)


CONFIG = Config()

# The four states of a missing label, which stay apart and are never null, and the decisions of a review.
NOT_STATED, NOT_ADDRESSED, NOT_CONSIDERED, INSUFFICIENT, UNAVAILABLE = "Not_Stated_In_Text", "Not_Addressed", "Not_Considered", "insufficient_evidence", "evidence_unavailable"
MISSING_STATES = (NOT_STATED, NOT_ADDRESSED, NOT_CONSIDERED, INSUFFICIENT, UNAVAILABLE)
DECISIONS = ("accept", "revise", "reject", "insufficient_evidence")
# Arms of the ablation as arm, coverage pass, retrieval channel, critic.
ARMS = (
    ("G0", False, "direct", False),
    ("G1", False, "dense", False),
    ("G2", False, "bm25", False),
    ("G3", False, "hybrid", False),
    ("G4", True, "hybrid", False),
    ("G5", True, "hybrid", True),
)
# The controls beside them, the direct arm under the budget of the others and the reviewed arm after one round.
CONTROLS = (("G0-budget", False, "budget", False), ("G5-round", True, "hybrid", True))
