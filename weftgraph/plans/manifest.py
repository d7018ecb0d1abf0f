"""Which steps of a build are done: a small JSON file on the driver's side."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path


class Manifest:
    """Completed steps with times; run() goes on from where a build stopped."""

    def __init__(self, path: str) -> None:
        self.path = Path(path)
        self.state: dict = json.loads(self.path.read_text()) if self.path.exists() else {"steps": {}}

    def done(self, step: str) -> bool:
        return bool(self.state["steps"].get(step, {}).get("completed"))

    def mark(self, step: str, seconds: float) -> None:
        self.state["steps"][step] = {"completed": True, "duration": round(seconds, 3), "timestamp": time.time()}
        self.state["last_completed_step"] = step
        self.path.write_text(json.dumps(self.state, indent=1))

    def run(self, steps: Sequence[tuple[str, Callable[[], object]]], first: int | str = 0, last: int | None = None, again: bool = False, needs: Mapping[str, Sequence[str]] | None = None) -> list[str]:
        """Run steps first..last that are not done, in order; the first failure ends it.

        first is a place or a step's name: then that step and all after it run
        anew. needs lists files or folders that must be there, with something in
        them, before a step.
        """
        steps, ran = list(steps), []
        if isinstance(first, str):
            first, again = [name for name, _ in steps].index(first), True
        for name, step in steps[first : None if last is None else last + 1]:
            if self.done(name) and not again:
                continue
            if lacking := [x for x in (needs or {}).get(name, ()) if not _filled(Path(x))]:
                raise FileNotFoundError(f"{name} needs {', '.join(lacking)}")
            began = time.perf_counter()
            step()
            self.mark(name, time.perf_counter() - began)
            ran.append(name)
        return ran


def _filled(path: Path) -> bool:
    return any(path.iterdir()) if path.is_dir() else path.is_file() and path.stat().st_size > 0
