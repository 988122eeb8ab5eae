"""The decision log: what was decided about a column or a run, as JSON lines to any number of sinks."""

from __future__ import annotations

import json
import logging
from datetime import datetime, timezone
from pathlib import Path
from typing import Any, Protocol

_log = logging.getLogger(__name__)


class Sink(Protocol):
    def write(self, decision: dict) -> None: ...


class JsonLines:
    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)

    def write(self, decision: dict) -> None:
        with self.path.open("a", encoding="utf-8") as f:
            f.write(json.dumps(decision, ensure_ascii=False, default=str) + "\n")


class DecisionLog:
    """A sink that fails is reported and does not keep the others, or the run, from going on."""

    def __init__(self, sinks: list[Sink] | None = None):
        self.sinks = list(sinks or [])

    def log(self, agent_name: str, action: str, input_value: Any = None, output_value: Any = None, confidence: float | None = None, upload_id: int | None = None, details: dict | None = None) -> dict:
        decision = {
            "timestamp": datetime.now(timezone.utc).isoformat(), "agent_name": agent_name, "action": action, "input": input_value, "output": output_value,
            "confidence": confidence, "upload_id": upload_id, "details": details or {},
        }
        for sink in self.sinks:
            try:
                sink.write(decision)
            except Exception:
                _log.exception("A decision sink failed.")
        return decision
