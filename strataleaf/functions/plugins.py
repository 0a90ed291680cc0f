"""What can be plugged in, by kind and name."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

# Kinds of plug-ins.
KINDS = ("parser", "verifier", "agent", "graph_builder", "storage", "policy", "synthesizer")


class Plugins:
    """A registry; a later plug-in of one kind and name replaces the earlier one."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}

    def _of(self, kind: str) -> dict[str, Callable]:
        if kind not in self._known:
            raise ValueError(f"no kind of plug-in: {kind}")
        return self._known[kind]

    def register(self, kind: str, name: str, plugin: Callable) -> None:
        self._of(kind)[name] = plugin

    def names(self, kind: str) -> list[str]:
        return sorted(self._of(kind))

    def call(self, kind: str, name: str, *args: Any, **kwargs: Any) -> Any:
        found = self._of(kind).get(name)
        if found is None:
            raise KeyError(f"no {kind} named {name}")
        return found(*args, **kwargs)


plugins = Plugins()
