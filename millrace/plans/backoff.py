"""Waiting times between tries."""

from __future__ import annotations

from dataclasses import dataclass

from ..errors import ConfigError


@dataclass(frozen=True)
class Backoff:
    tries: int = 10
    initial_ms: int = 500
    most_ms: int = 30_000
    jitter: bool = True

    def wait_ms(self, attempt: int) -> int | None:
        """Milliseconds before a try (from 0); None when the tries are used up.  Jitter is up to a fifth either way, the same for the same try."""
        if attempt >= self.tries:
            return None
        plain = min(self.initial_ms << min(attempt, 64), self.most_ms)
        return min(int(plain * (1 + spread(attempt))), self.most_ms) if self.jitter else plain

    def wait_or_fail(self, attempt: int) -> int:
        wait = self.wait_ms(attempt)
        if wait is None:
            raise ConfigError(f"retries exhausted after {self.tries} attempt(s)")
        return wait


def spread(attempt: int) -> float:
    """A number in [-0.2, 0.2] from the published SplitMix64 generator."""
    word = (1 << 64) - 1
    z = (attempt + 0x9E3779B97F4A7C15) & word
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * factor) & word
    return (z ^ (z >> 31)) / word * 0.4 - 0.2
