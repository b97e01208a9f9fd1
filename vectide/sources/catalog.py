"""Data set catalogs and configuration files: flat JSON objects."""

from __future__ import annotations

import json

ROLES = ("base", "query", "learn", "groundtruth", "manifest")


def load_config(path: str) -> dict:
    """A flat JSON object; nested values are refused, of a repeated key the first holds."""
    with open(path, encoding="utf-8") as f:
        pairs = json.load(f, object_pairs_hook=list)
    if not isinstance(pairs, list) or any(isinstance(v, list) for _, v in pairs):
        raise ValueError(f"{path} must be one flat object")
    out: dict = {}
    for k, v in pairs:
        out.setdefault(k.replace("_", "-"), v)
    return out


def load_catalog(path: str) -> dict[str, dict[str, str]]:
    """{profile: {role: path}} of keys ``profile.role``."""
    with open(path, encoding="utf-8") as f:
        flat = json.load(f)
    out: dict[str, dict[str, str]] = {}
    for key, value in flat.items():
        profile, _, role = key.rpartition(".")
        out.setdefault(profile, {})[role] = value
    return out


def resolve(given: dict, config: dict | None = None, profile: dict | None = None, input_role: str = "base", defaults: dict | None = None) -> dict:
    """Options by precedence: given, then config, profile, defaults; the command's role of the profile is its input."""
    from_profile = dict(profile or {})
    if input_role in from_profile:
        from_profile.setdefault("input", from_profile[input_role])
    out: dict = {}
    for layer in (given, config or {}, from_profile, defaults or {}):
        for k, v in layer.items():
            if v is not None:
                out.setdefault(k, v)
    return out
