"""Every knob in one frozen object, passed explicitly to whatever needs it."""

from dataclasses import dataclass, field

# Defaults a run must share to give the same results.
REFUSAL_TEXT = (
    "The retrieved filing excerpts do not contain enough information "
    "to answer this question."
)

TARGET_SECTIONS = {
    "1": "Item 1. Business",
    "1A": "Item 1A. Risk Factors",
    "3": "Item 3. Legal Proceedings",
    "7": "Item 7. Management's Discussion and Analysis",
    "7A": "Item 7A. Quantitative and Qualitative Disclosures About Market Risk",
}

MODEL_ALIASES = {
    "haiku": "claude-haiku-4-5",
    "sonnet": "claude-sonnet-4-6",
    "opus": "claude-opus-4-8",
    "minilm": "cross-encoder/ms-marco-MiniLM-L-6-v2",
    "bge": "BAAI/bge-reranker-base",
}


def model_name(alias: str) -> str:
    """Shorthand to full model name; anything else is taken verbatim."""
    return MODEL_ALIASES.get(alias, alias)


@dataclass(frozen=True)
class Settings:
    tickers: tuple = ("TSLA", "AAPL", "NVDA")
    # ticker -> names it goes by in questions; the first is its display name
    companies: dict = field(
        default_factory=lambda: {"TSLA": ("Tesla",), "AAPL": ("Apple",), "NVDA": ("NVIDIA",)}
    )

    chunk_size: int = 1000
    chunk_overlap: int = 150
    chunk_min_size: int = 200
    section_min_chars: int = 500

    top_k: int = 5
    pool: int = 50
    eval_depth: int = 10

    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rare_fraction: float = 0.01
    rrf_k: int = 60
    fusion: str = "rrf"
    mmr_lambda: float = 0.7

    seed_pool: int = 12
    seed_chars: int = 320
    max_aspects: int = 6
    max_subqueries: int = 5

    judge_pool: int = 20
    judge_negatives: int = 8
    judge_chars: int = 1200
    rubric_version: int = 2
    judge_min_recovery: float = 0.90
    judge_max_false_accept: float = 0.15

    refuse_floor: float = 0.52
    refuse_grey: float = 0.58

    embedding_model: str = "BAAI/bge-small-en-v1.5"
    query_prefix: str = "Represent this sentence for searching relevant passages: "
    answer_model: str = "claude-opus-4-8"
    rewrite_model: str = "claude-haiku-4-5"
    rerank_model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"

    user_agent: str = ""
    fetch_delay: float = 0.15
    fetch_timeout: float = 30.0

    def __post_init__(self):
        for knob in ("chunk_size", "top_k", "pool", "eval_depth", "rrf_k", "judge_pool"):
            if getattr(self, knob) <= 0:
                raise ValueError(f"{knob} must be positive")
        if self.fusion not in ("rrf", "interleave"):
            raise ValueError(f"unknown fusion {self.fusion!r}")
