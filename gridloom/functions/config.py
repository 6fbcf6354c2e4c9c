"""Configuration trees on the driver: inheritance, merging, overrides, evaluation defaults."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

import yaml


def parse_scalar(text: str) -> bool | int | float | str:
    """true/false, then an integer, then a number, else the text."""
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """Mappings merge by key; anything else is replaced. Neither input changes."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(out.get(key), dict) and isinstance(value, dict)
        out[key] = merge(out[key], value) if both else copy.deepcopy(value)
    return out


def override(config: dict[str, Any], settings: list[str]) -> dict[str, Any]:
    """``a.b=value`` settings; every part before the last must be there."""
    out = copy.deepcopy(config)
    for setting in settings:
        path, sign, value = setting.partition("=")
        if not sign:
            raise ValueError(f"not key=value: {setting}")
        *parents, leaf = path.split(".")
        node = out
        for name in parents:
            node = node[name]
        node[leaf] = parse_scalar(value)
    return out


def load(path: str | Path, overrides: list[str] | None = None) -> dict[str, Any]:
    """A YAML mapping on top of those its ``_base_`` names (one or more, relative to it; later ones win)."""

    def read(at: Path, above: tuple[Path, ...]) -> dict[str, Any]:
        at = at.resolve()
        if at in above:
            raise ValueError(f"configurations inherit in a circle: {at}")
        tree = yaml.safe_load(at.read_text()) or {}
        if not isinstance(tree, dict):
            raise ValueError(f"not a mapping: {at}")
        bases = tree.pop("_base_", [])
        out: dict[str, Any] = {}
        for base in [bases] if isinstance(bases, str) else bases:
            out = merge(out, read(at.parent / base, (*above, at)))
        return merge(out, tree)

    return override(read(Path(path), ()), overrides or [])


# Evaluation settings where a configuration has none.
EVALUATION = {
    "enabled": True, "every_epochs": 5, "heavy_every_epochs": 25, "n_plot_per_group": 25, "n_per_class_heavy": 50, "gen_batch_size": None, "guidance_scale": 0.0,
    "sampler": "ddpm", "seed": 123, "real_seed": 123, "profile_bins": 96, "psd_bins": 96,
}
PROXY_CLASSIFIER = {"enabled": True, "max_train_per_class": 2000, "C": 1.0, "solver": "lbfgs", "max_iter": 200}


def evaluation(config: dict[str, Any]) -> dict[str, Any]:
    """The evaluation settings with defaults; the light count is the plotted count unless it is set."""
    given = config.get("evaluation") or {}
    own = {**EVALUATION, **given, "proxy_classifier": {**PROXY_CLASSIFIER, **(given.get("proxy_classifier") or {})}}
    own.setdefault("n_per_class_light", own["n_plot_per_group"])
    for key in ("n_per_class_light", "n_per_class_heavy", "profile_bins", "psd_bins"):
        if int(own[key]) <= 0:
            raise ValueError(f"{key} must be positive")
    return own
