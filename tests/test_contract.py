import copy

import pytest

from orebed.sources import contract

GOOD = {
    "workflow_contract": {"canonical_config_path": "c.yaml", "canonical_output_dir": "out", "allow_noncanonical_with_env": "OREBED_ANY_WORKFLOW"},
    "domains": {"hard_boundaries": True, "categorical_simulation": True, "canonical_groups": dict.fromkeys(contract.GROUPS, []), "search_radius_m": [9, 5, 2]},
    "grid": {"dx": 25, "dy": 25.0, "dz": 2, "origin_xyz": [0, 0, 0]},
    "reporting_grid": {"dx": 50, "dy": 50, "dz": 2, "origin_xyz": [0, 0, 0]},
    "variogram": {"normalize_total_sill": True, "total_sill": 1, "shared_directional_model": True, "nested_structures": {"enabled": False}, "directions": [{"name": "along_strike", "azimuth": 359.5, "dip": 0}, {"name": "down_dip", "azimuth": 90, "dip": 60}, {"name": "normal_to_plane"}]},
    "orebody": {"strike_deg": 0.2, "dip_direction_deg": 90.5, "dip_deg": 60},
    "simulation": {"search_radius_m": [9, 5, 2], "require_full_neighborhood": True, "n_real": 100},
    "classification_benchmark": {"enabled": True, "relative_error_limit": 0.15, "confidence_interval": 0.9},
}


def broken(name, value):
    c = copy.deepcopy(GOOD)
    *path, last = name.split(".")
    at = c
    for p in path:
        at = at.setdefault(p, {})
    at[last] = value
    return c


def test_production_configuration_passes():
    assert contract.faults(GOOD) == []
    contract.require_production(GOOD, "c.yaml", "out")
    contract.require_production({}, "any", "any")


@pytest.mark.parametrize("name,value", [("grid.dx", 10), ("simulation.n_real", None), ("domains.hard_boundaries", False), ("variogram.nested_structures", {}), ("variogram.nested_structures.enabled", True), ("calibration.reference_data", "x.csv"), ("reporting_grid.origin_xyz", [1, 0, 0]), ("domains.canonical_groups", {}), ("variogram.directions", []), ("orebody.strike_deg", 2), ("orebody.dip_deg", 58)])
def test_each_rule_is_found(name, value):
    assert len(contract.faults(broken(name, value))) == 1


def test_paths_profiles_and_the_way_out(monkeypatch):
    for path, out, profile in (("d.yaml", "out", None), ("c.yaml", "else", None), ("c.yaml", "out", "p"), ("d.yaml", "else", "p")):
        with pytest.raises(ValueError):
            contract.require_production(GOOD, path, out, profile)
    contract.require_production(broken("grid.dx", 1), "c.yaml", "else", "p")
    monkeypatch.setenv("OREBED_ANY_WORKFLOW", "yes")
    contract.require_production(broken("grid.dx", 1), "d.yaml", "else")
