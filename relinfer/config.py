"""Model dimensions, sampling settings and the size bounds used by the plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

# A table or matrix is broadcast only if its size, computed from the model
# configuration or from a limit, stays below this; otherwise it is joined.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


@dataclass(frozen=True)
class ModelConfig:
    """Shape and constants of a decoder-only transformer."""

    hidden: int
    n_layers: int
    head_dim: int
    n_heads: int
    n_kv_heads: int
    ffn_dim: int
    vocab_size: int
    rms_eps: float = 1e-5
    rope_theta: float = 100000.0
    exp_clamp: float = 50.0
    rep_window: int = 64
    protected_tokens: int = 16
    stop_tokens: tuple[int, ...] = (0, 2)
    # Embedded in place of an id outside the vocabulary; without it such an id is an error.
    unk_token: int | None = None

    def __post_init__(self):
        if self.n_heads % self.n_kv_heads:
            raise ValueError("n_heads must be a multiple of n_kv_heads")
        if self.head_dim % 2:
            raise ValueError("head_dim must be even")

    @property
    def gqa_group(self) -> int:
        return self.n_heads // self.n_kv_heads

    @property
    def q_dim(self) -> int:
        return self.n_heads * self.head_dim

    @property
    def kv_dim(self) -> int:
        return self.n_kv_heads * self.head_dim

    @property
    def score_scale(self) -> float:
        return self.head_dim**-0.5

    def matrix_shapes(self) -> dict[str, tuple[int, int]]:
        """Stored shape (rows, width) of every tensor; `o` and `down` are input-major."""
        return {
            "emb": (self.vocab_size, self.hidden),
            "q": (self.q_dim, self.hidden),
            "k": (self.kv_dim, self.hidden),
            "v": (self.kv_dim, self.hidden),
            "o": (self.q_dim, self.hidden),
            "gate": (self.ffn_dim, self.hidden),
            "up": (self.ffn_dim, self.hidden),
            "down": (self.ffn_dim, self.hidden),
            "out": (self.vocab_size, self.hidden),
            "norm": (1, self.hidden),
            "ffn_norm": (1, self.hidden),
            "out_norm": (1, self.hidden),
        }

    def matrix_bytes(self, tensor: str) -> int:
        rows, width = self.matrix_shapes()[tensor]
        return rows * width * 8


@dataclass(frozen=True)
class SamplingParams:
    """Sampling settings; the defaults are the reference's."""

    temp: float = 0.8
    top_p: float = 0.9
    top_k: int = 40
    min_p: float = 0.1
    rep_pen: float = 1.2
    max_pos: int = 2048

    def __post_init__(self):
        if self.temp <= 0:
            raise ValueError("temp must be positive")
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.rep_pen <= 0:
            raise ValueError("rep_pen must be positive")

    def greedy(self) -> "SamplingParams":
        return replace(self, top_k=1)


# The dimensions of the larger of the two published models.
MODEL_135M = ModelConfig(
    hidden=576, n_layers=30, head_dim=64, n_heads=9, n_kv_heads=3,
    ffn_dim=1536, vocab_size=49152,
)

# Closed-form model for tests and queries (see sources.weights.formula_model).
TINY = ModelConfig(
    hidden=12, n_layers=2, head_dim=8, n_heads=6, n_kv_heads=2,
    ffn_dim=16, vocab_size=256,
)
