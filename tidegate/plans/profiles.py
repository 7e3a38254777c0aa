"""Profiles: an ordered stage list from YAML, checked completely before any job runs."""

from __future__ import annotations

import copy
from collections.abc import Callable, Mapping
from typing import Any

from tidegate.errors import ResourceError
from tidegate.model import ATTACK_STAGE, RULE_STAGE, SEMANTIC_STAGE
from tidegate.plans.stages import Stage, attack_stage, rule_stage, semantic_stage
from tidegate.sources.banks import load_yaml, packaged

PROFILES = ("default", "clinical", "full")

_registry: dict[str, Callable[..., Stage]] = {
    RULE_STAGE: rule_stage,
    SEMANTIC_STAGE: semantic_stage,
    ATTACK_STAGE: attack_stage,
}


def register(name: str, factory: Callable[..., Stage]) -> None:
    """Make a custom stage available to profiles; only registered names can be built."""
    _registry[name] = factory


def registered() -> list[str]:
    return sorted(_registry)


def load_profile(profile: str | Mapping[str, Any] = "full") -> dict[str, Any]:
    """A shipped profile by name, a YAML file by path, or a mapping as it is."""
    if isinstance(profile, Mapping):
        return copy.deepcopy(dict(profile))
    path = packaged(f"profiles/{profile}.yaml") if profile in PROFILES else profile
    document = load_yaml(path)
    if not isinstance(document, dict):
        raise ResourceError(f"profile {profile}")
    return document


def override(profile: dict[str, Any], changes: Mapping[str, Any]) -> dict[str, Any]:
    """Dotted overrides, e.g. ``{"stages.1.threshold": 0.9}``."""
    for dotted, value in changes.items():
        *parents, last = dotted.split(".")
        node: Any = profile
        try:
            for key in parents:
                node = node[int(key)] if isinstance(node, list) else node[key]
            node[int(last) if isinstance(node, list) else last] = value
        except (KeyError, IndexError, ValueError, TypeError) as exc:
            raise ResourceError(f"override {dotted}", exc) from exc
    return profile


def build(
    profile: str | Mapping[str, Any] = "full",
    overrides: Mapping[str, Any] | None = None,
    banks: Mapping[str, str] | None = None,
    inject: Mapping[str, Mapping[str, Any]] | None = None,
) -> list[Stage]:
    """Stages in profile order.

    ``banks`` gives bank file paths by name (crisis, malign, patterns). ``inject`` gives Python
    arguments per stage name: a prediction source, a classifier factory, a label map.
    """
    document = override(load_profile(profile), overrides or {})
    chosen = [_factory(place, spec) for place, spec in enumerate(document.get("stages") or [])]
    stages = []
    for name, factory, given in chosen:
        files = (banks or {}) if name == RULE_STAGE else {}
        stages.append(_made(name, factory, {**files, **given, **(inject or {}).get(name, {})}))
    return stages


def _factory(place: int, spec: Mapping[str, Any]) -> tuple[str, Callable[..., Stage], dict[str, Any]]:
    """Name, factory and arguments of one entry of a profile; every entry is looked up before any is built."""
    given = dict(spec)
    name = given.pop("stage", None)
    if name not in _registry:
        raise ResourceError(f"stage {place} of the profile: {name!r} is none of {registered()}")
    return name, _registry[name], given


def _made(name: str, factory: Callable[..., Stage], arguments: Mapping[str, Any]) -> Stage:
    try:
        return factory(**arguments)
    except (TypeError, ValueError, ArithmeticError) as exc:
        raise ResourceError(f"arguments of stage {name}", exc) from exc
