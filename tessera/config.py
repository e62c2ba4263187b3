"""Settings of searches and of the collision index."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Surrogate:
    """Poles until so many, or until they cover a share; how many of them are tried first."""

    pole_limits: tuple[tuple[int, float], ...] = ((100, 0.0), (20, 0.75), (10, 0.9))
    ff_poles: int = 2
    ff_piers: int = 0


@dataclass(frozen=True)
class Search:
    """The search's defaults."""

    samples: int = 5_000
    local: float = 0.2
    simplify: float | None = 0.001
    concavity: tuple[float, float] | None = (0.01, 0.01)
    separation: float | None = None
    seed: int | None = None
    depth: int = 5
    threshold: int = 16
    surrogate: Surrogate = field(default_factory=Surrogate)

    @classmethod
    def parse(cls, text: str) -> Search:
        """Of a JSON object; keys that are missing keep their defaults, unknown ones are ignored."""
        raw = json.loads(text)
        names = {"n_samples": "samples", "ls_frac": "local", "poly_simpl_tolerance": "simplify", "narrow_concavity_cutoff": "concavity", "min_item_separation": "separation", "prng_seed": "seed"}
        got = {to: tuple(v) if isinstance(v := raw[of], list) else v for of, to in names.items() if of in raw}
        cde = raw.get("cde_config", {})
        got |= {to: cde[of] for of, to in (("quadtree_depth", "depth"), ("cd_threshold", "threshold")) if of in cde}
        if "item_surrogate_config" in cde:
            s = cde["item_surrogate_config"]
            got["surrogate"] = Surrogate(tuple(map(tuple, s.get("n_pole_limits", Surrogate.pole_limits))), s.get("n_ff_poles", 2), s.get("n_ff_piers", 0))
        return cls(**{k: v for k, v in got.items() if k in {f.name for f in fields(cls)}})
