"""Steps with dependencies: order, gates, input hashes and skipping what is unchanged."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Step:
    name: str
    run: Callable[..., DataFrame | None]
    needs: tuple[str, ...] = ()
    settings: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()


def code_version() -> str:
    """A hash of this package's source: steps run again when it changes."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha256()
    for folder, dirs, files in os.walk(root):
        dirs.sort()
        for name in sorted(f for f in files if f.endswith(".py")):
            with open(os.path.join(folder, name), "rb") as f:
                h.update(f.read())
    return h.hexdigest()


@dataclass
class Workflow:
    """A registry of steps; status maps a step to done, stale, failed or blocked, with the hash of its inputs."""

    steps: dict[str, Step] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    hashes: dict[str, str] = field(default_factory=dict)
    fingerprint: Callable[[str], str] | None = None  # what tells one state of an input from another
    version: str = field(default_factory=code_version)

    def step(self, name: str, needs: tuple[str, ...] = (), settings: tuple[str, ...] = (), inputs: tuple[str, ...] = ()) -> Callable:
        def add(run: Callable) -> Callable:
            self.steps[name] = Step(name, run, needs, settings, inputs)
            return run

        return add

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """Steps in an order that respects their needs, with all they need; cycles are errors."""
        out: list[str] = []
        busy: set[str] = set()

        def visit(name: str) -> None:
            if name in out:
                return
            if name in busy:
                raise ValueError(f"{name} needs itself")
            busy.add(name)
            for n in self.steps[name].needs:
                visit(n)
            out.append(name)

        for name in wanted or self.steps:
            visit(name)
        return out

    def input_hash(self, name: str, config: dict) -> str:
        s = self.steps[name]
        seen = {"settings": {k: config.get(k) for k in s.settings}, "needs": {n: self.hashes.get(n) for n in s.needs}, "version": self.version, "inputs": {i: self.fingerprint(i) if self.fingerprint else None for i in s.inputs}}
        return hashlib.sha256(json.dumps(seen, sort_keys=True, default=str).encode()).hexdigest()

    def blocked(self, name: str, config: dict) -> list[str]:
        """Settings of a step that have no value yet."""
        return [k for k in self.steps[name].settings if config.get(k) is None]

    def run(self, config: dict, wanted: list[str] | None = None, force: bool = False) -> dict[str, str]:
        for name in self.order(wanted):
            if self.blocked(name, config) or any(self.status.get(n) not in ("done", "unchanged") for n in self.steps[name].needs):
                self.status[name] = "blocked"
                continue
            h = self.input_hash(name, config)
            if not force and self.hashes.get(name) == h and self.status.get(name) in ("done", "unchanged"):
                self.status[name] = "unchanged"
                continue
            try:
                self.steps[name].run(config)
                self.status[name], self.hashes[name] = "done", h
            except Exception:
                self.status[name] = "failed"
                raise
            finally:
                for later in self.below(name):
                    if later in self.hashes and self.status.get(later) in ("done", "unchanged"):
                        self.status[later] = "stale"
        return self.status

    def below(self, name: str) -> set[str]:
        """All steps that need a step, directly or through others."""
        out, front = set(), {name}
        while front:
            front = {later for later, s in self.steps.items() if front & set(s.needs)} - out
            out |= front
        return out
