"""Configuration: defaults with overrides by well or dataset, merged deeply."""

from __future__ import annotations

import copy

#: Fixed values of the interpretation (rules of thumb, to be reviewed for a field).
WELL = {
    "vsh": {"method": "older", "use_percentiles": True, "gr_clean_percentile": 5, "gr_shale_percentile": 95, "gr_clean_override": None, "gr_shale_override": None},
    "phit": {"rhob_matrix": 2.65, "rhob_fluid": 1.0},
    "phie": {"compute_density_neutron_crosscheck": True},
    "swe": {"a": 1.0, "m": 2.0, "n": 2.0, "rw": 0.05},
    "perm_tixier": {"swirr": None, "swirr_default": 0.25},
    "vvolc": {"rhob_threshold": 2.7, "nphi_threshold": 0.15, "gr_shale_fraction": 0.6, "rhob_scale_min": 2.7, "rhob_scale_max": 2.9},
    "zones": {"vsh_max": 0.4, "phie_min": 0.08, "swe_reservoir_max": 0.65, "swe_pay_max": 0.5},
    "dptm": {"enabled": True, "vendor_min_valid_fraction": 0.8},
}
SEISMIC = {
    "attributes": {"normalize_low_percentile": 2, "normalize_high_percentile": 98},
    "vsh_proxy": {"enabled": True},
    "phie_proxy": {"enabled": True},
    "swe_proxy": {"bright_spot_percentile": 90},
}
TIE = {"tie_search_max_shift_ms": 100, "max_tie_search_radius_m": 1000}


def merged(base: dict, over: dict | None) -> dict:
    """base with the values of over, level by level; neither is changed."""
    out = copy.deepcopy(base)
    for k, v in (over or {}).items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(path: str) -> dict:
    """A YAML file; an empty one is {}."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def for_key(config: dict, section: str, key: str, base: dict) -> dict:
    """base, then the file's defaults, then the overrides of one well or dataset."""
    return merged(merged(base, config.get("defaults")), (config.get(section) or {}).get(key))


def well_config(key: str = "", config: dict | None = None) -> dict:
    return for_key(config or {}, "wells", key, WELL)


def seismic_config(key: str = "", config: dict | None = None) -> dict:
    return for_key(config or {}, "datasets", key, SEISMIC)
