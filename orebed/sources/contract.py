"""What a configuration must say before a production run: rules as data, judged on the driver."""

from __future__ import annotations

import os
from collections.abc import Callable
from typing import Any

# Settings that a production run must have, by dotted name.
EXACT: dict[str, Any] = {
    "grid.dx": 25.0,
    "grid.dy": 25.0,
    "grid.dz": 2.0,
    "reporting_grid.dx": 50.0,
    "reporting_grid.dy": 50.0,
    "reporting_grid.dz": 2.0,
    "variogram.total_sill": 1.0,
    "simulation.n_real": 100,
    "classification_benchmark.relative_error_limit": 0.15,
    "classification_benchmark.confidence_interval": 0.90,
}
ON = ("domains.hard_boundaries", "domains.categorical_simulation", "variogram.normalize_total_sill", "variogram.shared_directional_model", "simulation.require_full_neighborhood", "classification_benchmark.enabled")
OFF = ("variogram.nested_structures.enabled", "calibration.enabled", "internal_validation.enabled")
DECLARED = ("variogram.nested_structures.enabled",)
BLANK = ("calibration.reference_data", "internal_validation.model_csv")
ALIKE = (("grid.origin_xyz", "reporting_grid.origin_xyz"), ("simulation.search_radius_m", "domains.search_radius_m"))
GROUPS = {"fresh_graphitic", "weathered_graphitic", "host_waste"}
DIRECTIONS = {"along_strike", "down_dip", "normal_to_plane"}


def setting(config: dict, name: str, default: Any = None) -> Any:
    """The value under a dotted name; the default where a part of the name is absent or null."""
    for part in name.split("."):
        config = config.get(part) if isinstance(config, dict) else None
        if config is None:
            return default
    return config


def _turn(a: float, b: float) -> float:
    """The angle between two azimuths, at most 180."""
    d = abs(float(a) - float(b)) % 360
    return min(d, 360 - d)


def faults(config: dict) -> list[str]:
    """All rules that the configuration breaks, in their order; none for a production configuration."""
    get: Callable[..., Any] = lambda n, d=None: setting(config, n, d)
    out = [f"{n} must be {v}" for n, v in EXACT.items() if abs(float(get(n, 0)) - v) > 1e-9]
    out += [f"{n} must be on" for n in ON if not get(n)]
    out += [f"{n} must be declared" for n in DECLARED if n.rpartition(".")[2] not in (get(n.rpartition(".")[0]) or {})]
    out += [f"{n} must be off" for n in OFF if get(n)]
    out += [f"{n} must be blank" for n in BLANK if str(get(n, "")).strip()]
    out += [f"{a} and {b} must be the same" for a, b in ALIKE if list(get(a, [])) != list(get(b, []))]
    if not GROUPS <= set(get("domains.canonical_groups", {})):
        out.append(f"domains.canonical_groups must have {sorted(GROUPS)}")
    directions = {d["name"]: d for d in get("variogram.directions", []) if isinstance(d, dict) and d.get("name")}
    if not DIRECTIONS <= set(directions):
        return out + [f"variogram.directions must have {sorted(DIRECTIONS)}"]
    along, down = directions["along_strike"], directions["down_dip"]
    axes = {
        "along_strike must follow the strike": _turn(along.get("azimuth", 0), get("orebody.strike_deg", 0)),
        "along_strike must be level": abs(float(along.get("dip", 999))),
        "down_dip must follow the dip direction": _turn(down.get("azimuth", 0), get("orebody.dip_direction_deg", 0)),
        "down_dip must dip as the orebody": abs(float(down.get("dip", 999)) - float(get("orebody.dip_deg", 0))),
    }
    return out + [rule for rule, degrees in axes.items() if degrees > 1]


def require_production(config: dict, path: str, output: str, profile: str | None = None, root: str = ".") -> None:
    """Raise unless the run keeps the configuration's ``workflow_contract``; without one everything goes.

    A profile starts from the canonical configuration and writes elsewhere;
    nothing more is asked of it.  The variable that the contract names in
    ``allow_noncanonical_with_env`` lifts all rules of other runs.
    """
    contract = config.get("workflow_contract") or {}
    if not contract:
        return
    same = lambda a, b: os.path.abspath(a) == os.path.abspath(os.path.join(root, b))
    own_paths = bool(contract.get("require_canonical_paths", True))
    # Where a contract that names no places has them.
    right_config = same(path, contract.get("canonical_config_path", "config/main_config.yaml"))
    right_output = same(output, contract.get("canonical_output_dir", "output/a3_categorical_25_50_nr100"))
    if profile:
        if own_paths and not right_config:
            raise ValueError(f"profile {profile} must start from the canonical configuration")
        if right_output:
            raise ValueError(f"profile {profile} can't write to the canonical folder")
        return
    lifted = str(contract.get("allow_noncanonical_with_env") or "").strip()
    if lifted and os.environ.get(lifted, "").lower() in ("1", "true", "yes"):
        return
    if own_paths and not (right_config and right_output):
        raise ValueError(f"not the canonical {'output' if right_config else 'configuration'} path")
    if found := faults(config):
        raise ValueError("; ".join(found))
