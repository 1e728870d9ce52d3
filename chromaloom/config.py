"""Typed options, read from ``name = value`` files without evaluating code."""

from __future__ import annotations

import ast
import dataclasses
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of the engine. A file may set any field; unknown names raise."""

    # Thresholds, neighbourhoods, grid widths and palettes on which results depend.
    min_dist: int = 1024
    k: int = 100
    near_cis: int = 5_000_000
    expand: int = 2_000_000
    local_expand: int = 1_000_000
    shuffle: int = 80
    grid_small: int = 500_000
    grid_high: int = 1_000_000
    grid_increase: int = 500_000
    grid_step_iter: int = 40
    max_resolution: int = 400
    min_points: int = 1000
    min_shuffle_rows: int = 2000
    proposal_share: float = 0.5
    decay_regularization: float = 5.0
    correction_factor: float = 0.25
    feature_range: int = 25_000
    feature_resolution: int = 500
    feature_min_dist: int = 200_000
    feature_max_dist: int = 1_000_000
    score_filter: float = 30.0
    score_pal_zero: str = "lightgrey"
    score_pal_pos: tuple[str, ...] = ("lightgrey", "pink", "red", "orange", "yellow")
    score_pal_neg: tuple[str, ...] = ("lightgrey", "lightblue", "blue", "black")
    score_pal_pos_breaks: tuple[int, ...] = (15, 25, 45, 60, 85)
    score_pal_neg_breaks: tuple[int, ...] = (15, 20, 50, 85)
    track_colors: tuple[str, ...] = ("#42413F", "#E69F00", "#56B4E9", "#009E73", "#F0E442", "#0072B2", "#D55E00", "#CC79A7")
    annotation_colors: tuple[str, ...] = ("#CC79A7", "#D55E00", "#0072B2", "#F0E442", "#009E73", "#56B4E9", "#E69F00", "#42413F")

    @classmethod
    def from_file(cls, path: str, base: EngineConfig | None = None, reset: bool = False) -> EngineConfig:
        """``base`` with the file's values for fields that ``base`` leaves at their default, or for all of them with ``reset``."""
        base = base or cls()
        found = {}
        for line in Path(path).read_text().splitlines():
            line = line.strip()
            if not line or line[0] == "#":
                continue
            name, eq, value = line.partition("=")
            name = name.strip()
            if not eq or "#" in name or name in found:
                raise ValueError(f"{'repeated name' if name in found else 'no ='} in {path}: {line}")
            found[name] = _parsed(value.strip())
        defaults = cls()
        unknown = found.keys() - {f.name for f in dataclasses.fields(cls)}
        if unknown:
            raise ValueError(f"unknown options in {path}: {sorted(unknown)}")
        return base.with_overrides(**{k: v for k, v in found.items() if reset or getattr(base, k) == getattr(defaults, k)})

    def dump(self, path: str) -> None:
        """Writes a file that ``from_file`` reads back."""
        Path(path).write_text("".join(f"{f.name} = {getattr(self, f.name)!r}\n" for f in dataclasses.fields(self)))

    def with_overrides(self, **values) -> EngineConfig:
        return dataclasses.replace(self, **values)

    def get(self, name: str):
        return getattr(self, name)

    def get_list(self, name: str) -> list:
        value = getattr(self, name)
        return [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value)


def _parsed(value: str):
    """A literal, in whose strings a # may stand, or else plain text; a comment may follow."""
    try:
        return ast.literal_eval(value)
    except (ValueError, SyntaxError):
        return value.split("#", 1)[0].strip()
