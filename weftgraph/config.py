"""Settings: nested dictionaries with ablation profiles merged over a base."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with over's values; dictionaries merge, anything else is replaced."""
    out = dict(base)
    for key, value in over.items():
        old = out.get(key)
        out[key] = deep_merge(old, value) if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return out


def with_profile(settings: Mapping[str, Any], profile: str | None) -> dict[str, Any]:
    """Settings under one of their ``ablation`` profiles (None: as they are)."""
    if profile is None:
        return dict(settings)
    profiles = settings.get("ablation", {})
    if profile not in profiles:
        raise KeyError(f"no profile {profile!r}; there are {sorted(profiles)}")
    return deep_merge(settings, profiles[profile])
