"""Rules of users as JSON files."""

from __future__ import annotations

import json
import os
import re
import warnings

from ..schema import CONFIDENCES, SEVERITIES

EXAMPLES = {
    "internal-endpoint.json": {
        "id": "internal-endpoint", "name": "Internal endpoint", "description": "An address of the inner network", "severity": "medium", "extensions": [".js", ".ts", ".py"],
        "patterns": [{"regex": r"https?://(?:10|192\.168)\.[\d.]+", "message": "An inner address"}],
    },
    "debug-output.json": {
        "id": "debug-output", "name": "Debug output", "description": "Secrets must not be logged", "severity": "low", "extensions": ["*"],
        "patterns": [{"regex": r"(?:console\.log|print)\([^)]*(?:password|token|secret)", "message": "A secret is logged"}],
    },
    "todo-security.json": {
        "id": "todo-security", "name": "Open security work", "description": "Work left open", "severity": "info", "extensions": ["*"],
        "patterns": [{"regex": r"(?:TODO|FIXME).{0,40}security", "message": "Open work"}],
    },
}


def validate(rule: object) -> list[str]:
    """What is wrong with a rule."""
    if not isinstance(rule, dict):
        return ["not an object"]
    out = [f"no {k}" for k in ("id", "name", "description", "severity", "extensions", "patterns") if not rule.get(k)]
    if rule.get("id") and not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", str(rule["id"])):
        out.append("id is not in kebab case")
    if rule.get("severity") and rule["severity"] not in SEVERITIES:
        out.append("unknown severity")
    if rule.get("confidence") and rule["confidence"] not in CONFIDENCES:
        out.append("unknown confidence")
    for i, p in enumerate(rule.get("patterns") or []):
        try:
            re.compile(p["regex"])
        except (re.error, KeyError, TypeError):
            out.append(f"pattern {i} has no valid regex")
    return out


def load(folder: str) -> list[dict]:
    """All valid rules of a folder; invalid ones are named in a warning and left out. Only id and patterns are indispensable."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if not name.endswith(".json"):
            continue
        try:
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                got = json.load(f)
        except (OSError, ValueError) as e:
            warnings.warn(f"{name}: {e}", stacklevel=2)
            continue
        for rule in got if isinstance(got, list) else [got]:
            wrong = [w for w in validate(rule) if w in ("not an object", "no id", "no patterns") or w.startswith("pattern ")]
            if wrong:
                warnings.warn(f"{name}: {', '.join(wrong)}", stacklevel=2)
            else:
                out.append(rule)
    return out


def create(folder: str, rule: dict) -> str:
    """Write a rule; it must be valid and new."""
    rule = {"confidence": "medium", "extensions": ["*"], **rule}
    if wrong := validate(rule):
        raise ValueError(", ".join(wrong))
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{rule['id']}.json")
    if os.path.exists(path):
        raise ValueError(f"{path} is there already")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rule, f, indent=2)
    if rule["id"] not in {r["id"] for r in load(folder)}:
        raise ValueError("the rule cannot be read back")
    return path


def write_examples(folder: str) -> list[str]:
    """Example rules that are not there yet."""
    os.makedirs(folder, exist_ok=True)
    out = []
    for name, rule in EXAMPLES.items():
        path = os.path.join(folder, name)
        if not os.path.exists(path):
            with open(path, "w", encoding="utf-8") as f:
                json.dump(rule, f, indent=2)
            out.append(path)
    return out
