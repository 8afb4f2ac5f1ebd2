"""Named registries, through which users add estimators, losses, reward functions, parsers and readers."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from typing import Any


class Registry:
    """Names to callables; a name is taken once."""

    def __init__(self, kind: str):
        self.kind = kind
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
        def add(f: Callable[..., Any]) -> Callable[..., Any]:
            if self._known.setdefault(name, f) is not f:
                raise ValueError(f"{self.kind} {name!r} is taken")
            return f

        return add

    def get(self, name: str) -> Callable[..., Any]:
        if name not in self._known:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


ADVANTAGES = Registry("advantage estimator")
LOSSES = Registry("policy loss")
REWARDS = Registry("reward function")
PARSERS = Registry("tool parser")


def load_function(path: str, name: str, **bound: Any) -> Callable[..., Any]:
    """A function from a Python file, with keyword arguments bound; register it as a pandas UDF to use it in SQL."""
    spec = importlib.util.spec_from_file_location("loaded_function", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    f = getattr(module, name, None)
    if not callable(f):
        raise AttributeError(f"{path} has no function {name!r}")
    if not bound:
        return f
    return lambda *args, **kwargs: f(*args, **(bound | kwargs))
