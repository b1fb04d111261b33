"""Run modes of the code engine."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    mode: str = "standard"
    near: bool = True
    threshold: float = 0.86
    min_lines: int = 12
    window_lines: int = 40
    window_step: int = 20
    max_comparisons: int = 200_000
    top_k: int = 20
    cost: str = "medium"


def profile_for(mode: str = "standard", base: Profile = Profile()) -> Profile:
    """exact skips near pairs; deep lowers the limits and looks at more."""
    if mode == "exact":
        return replace(base, mode=mode, near=False, max_comparisons=0, cost="low")
    if mode == "deep":
        return replace(
            base, mode=mode, threshold=min(base.threshold, 0.82), min_lines=min(base.min_lines, 8), window_lines=min(base.window_lines, 30), window_step=min(base.window_step, 10),
            max_comparisons=max(base.max_comparisons, 1_000_000), top_k=max(base.top_k, 100), cost="high",
        )
    if mode != "standard":
        raise ValueError(f"unknown mode {mode}")
    return replace(base, mode=mode)
