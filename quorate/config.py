"""Settings of a run, with what the environment says over the defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

#: Environment variables of the settings, and words that switch off, fixed values.
VARIABLES = {"version": "PROMPT_VERSION", "mode": "MODE", "resume": "REPRENDRE", "per_entity": "LIMITE_PAR_ENTREPRISE", "threshold": "SEUIL_VARIATION_PCT", "batch_size": "BATCH_TAILLE_MAX", "timeout_s": "BATCH_TIMEOUT", "poll_s": "BATCH_POLL_INTERVAL"}
OFF = ("0", "false", "False")


@dataclass(frozen=True)
class EngineConfig:
    version: str | None = None
    mode: str = "sync"
    resume: bool = True
    per_entity: int | None = None
    least_mentions: int = 2
    classifier_mentions: int = 3
    threshold: float = 5.0
    batch_size: int = 1000
    timeout_s: int = 86_400
    poll_s: int = 30

    def overlaid(self, env: Mapping[str, str] | None = None) -> EngineConfig:
        """With the variables that are set and not empty; a value that is no number raises."""
        env = os.environ if env is None else env
        kinds = {f.name: str(f.type) for f in fields(self)}
        read = lambda name, v: v not in OFF if "bool" in kinds[name] else float(v) if "float" in kinds[name] else int(v) if "int" in kinds[name] else v
        return replace(self, **{name: read(name, env[var]) for name, var in VARIABLES.items() if env.get(var)})
