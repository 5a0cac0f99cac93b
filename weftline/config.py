"""Settings of the duplicate search."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DedupConfig:
    """n hashes in bands of ``rows``; thresholds and weights of the pair score.

    ``score_mode``: ``intended`` scores candidates of one brand,
    ``as_written`` gives them distance 0.  ``order``: whether the last or the
    first word of a permutation is kept.  ``delimiter``: between the values of
    a band's bucket; an empty one gives the ambiguous bucket names.
    """

    n: int = 1050
    rows: int = 5
    seed: int = 1
    alpha: float = 0.6
    beta: float = 0.0
    gamma: float = 0.75
    epsilon: float = 0.5
    mu: float = 0.65
    delta: float = 0.4
    score_mode: str = "intended"
    order: str = "last"
    delimiter: str = "-"
    drop_empty: bool = False
    prime: int = 2147483647
    empty_value: int = 10000

    def __post_init__(self):
        if not 0 < self.rows <= self.n:
            raise ValueError("rows must lie between 1 and n")
        if self.score_mode not in ("intended", "as_written") or self.order not in ("last", "first"):
            raise ValueError("unknown score_mode or order")

    @property
    def bands(self) -> int:
        return self.n // self.rows

    @property
    def band_rows(self) -> int:
        """Rows per band as split; may exceed the rows asked for."""
        return self.n // self.bands

    @property
    def threshold(self) -> float:
        return (1 / self.bands) ** (1 / self.rows)

    def coefficients(self) -> list[tuple[int, int]]:
        """Seeded (a, b) of the permutations a + b x mod prime, b never 0."""
        out, x = [], self.seed * 2654435761 % self.prime
        for _ in range(self.n):
            x = (48271 * x + 11) % self.prime
            a = x
            x = (48271 * x + 11) % self.prime
            out.append((a, x % (self.prime - 1) + 1))
        return out
