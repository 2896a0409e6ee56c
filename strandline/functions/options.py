"""Values that a run is configured with, checked before any work."""

from __future__ import annotations

import math


def items(text: str | None) -> list[str]:
    """The parts between commas, stripped; empty ones are passed over."""
    return [part for part in map(str.strip, (text or "").split(",")) if part]


def mix(text: str, sources: tuple[str, ...]) -> dict[str, float]:
    """Shares such as ``te=0.35,markov=0.35,background=0.3``: one for each source, none negative, 1 together."""
    pairs = [part.partition("=")[::2] for part in items(text)]
    out = {name.strip(): float(share) for name, share in pairs}
    if {*out} != {*sources} or len(pairs) != len(out):
        raise ValueError(f"{text!r} must name each of {sources} once")
    return dict(zip(out, shares(out.values(), text), strict=True))


def fractions(text: str, count: int = 3) -> tuple[float, ...]:
    out = tuple(map(float, items(text)))
    if len(out) != count:
        raise ValueError(f"{text!r} must have {count} numbers")
    return shares(out, text)


def shares(values, what: object) -> tuple[float, ...]:
    """The values, if none is negative and their sum is 1 within a millionth."""
    out = tuple(values)
    if any(not math.isfinite(x) or x < 0 for x in out) or abs(sum(out) - 1) > 1e-6:
        raise ValueError(f"{what!r}: shares must not be negative, and sum to 1")
    return out


def settings(width: int, stride: int, dev_fraction: float, holdout: list[str], dev: list[str], present: list[str]) -> None:
    """Raises for the first setting that is out of its domain."""
    problems = {
        f"width {width} must be a positive multiple of 128": width > 0 and width % 128 == 0,
        f"stride {stride} must lie within 1 and the width": 1 <= stride <= width,
        f"the dev share {dev_fraction} must lie between 0 and 1": 0 < dev_fraction < 1,
        f"chromosomes in two roles: {sorted({*holdout} & {*dev})}": not {*holdout} & {*dev},
        "no chromosome is left to train on": bool({*present} - {*holdout} - {*dev}),
    }
    for problem, holds in problems.items():
        if not holds:
            raise ValueError(problem)


def pool_sizes(positives: dict[str, float], share: float, train: float = 2.0, others: float = 4.0) -> dict[str, int]:
    """Candidates to draw for each pool: the expected positives times a source's share times a reserve, rounded up."""
    return {pool: math.ceil(n * share * (train if pool == "train" else others)) for pool, n in positives.items()}
