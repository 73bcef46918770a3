"""Settings of a verification run, their templates and fingerprint."""

from __future__ import annotations

import hashlib
import json
import warnings
from dataclasses import asdict, dataclass

from probatio.model import AGENTS

#: YAML keys that change nothing.
INERT = ("enable_llm_validation", "complexity_threshold", "enable_profiling")


@dataclass(frozen=True)
class Settings:
    """What decides a report. ``mode``: intended, or compat with published runs."""

    agents: tuple[str, ...] = AGENTS
    min_score: float = 0.85
    entropy_floor: float = 3.5
    check_dependencies: bool = True
    max_line: int = 88
    word_boundary_crypto: bool = False
    mode: str = "intended"

    def __post_init__(self):
        if self.mode not in ("intended", "compat"):
            raise ValueError(f"unknown mode {self.mode}")
        asked = AGENTS if "all" in self.agents else self.agents
        object.__setattr__(self, "agents", tuple(a for a in AGENTS if a in asked))

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


TEMPLATES = {
    "default": Settings(),
    "strict": Settings(min_score=0.95, entropy_floor=3.0),
    "security": Settings(agents=("security", "correctness")),
    "performance": Settings(agents=("performance", "correctness")),
}


def from_mapping(spec: dict) -> Settings:
    """Settings of a parsed YAML or JSON document; unknown names are ignored."""
    known: dict = {}
    agents = spec.get("enabled_agents", spec.get("agents"))
    if isinstance(agents, dict):
        configs, agents = agents, [a for a, own in agents.items() if (own or {}).get("enabled", True)]
    else:
        configs = spec.get("agent_configs", {})
    if agents is not None:
        known["agents"] = tuple(agents)
    for own in configs.values():
        for key in own or {}:
            if key in INERT:
                warnings.warn(f"{key} has no effect", stacklevel=2)
    security = configs.get("security") or {}
    if "min_entropy_threshold" in security:
        known["entropy_floor"] = float(security["min_entropy_threshold"])
    if "check_dependencies" in security:
        known["check_dependencies"] = bool(security["check_dependencies"])
    style = configs.get("style") or {}
    if "max_line_length" in style:
        known["max_line"] = int(style["max_line_length"])
    thresholds = spec.get("thresholds", {})
    if "overall_min_score" in thresholds:
        known["min_score"] = float(thresholds["overall_min_score"])
    return Settings(**known)


def load(path: str) -> Settings:
    """Settings of a JSON file, or of a YAML file where a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if path.endswith(".json"):
        return from_mapping(json.loads(source))
    import yaml

    return from_mapping(yaml.safe_load(source) or {})
