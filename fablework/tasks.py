"""Tasks by name: which handler runs, with which arguments."""

from __future__ import annotations

from collections.abc import Callable

#: Other names under which callers know a task.
ALIASES = {"questeval": "metric_questeval", "bookscore": "metric_bookscore"}


class Registry:
    """Handlers take a DataFrame of chunks and keyword arguments, and return a DataFrame."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, dict]] = {}

    def add(self, name: str, handler: Callable, **kwargs) -> None:
        self._known[name] = (handler, kwargs)

    def get(self, name: str) -> tuple[Callable, dict]:
        name = ALIASES.get(name, name)
        if name not in self._known:
            raise ValueError(f"unknown task {name}")
        return self._known[name]

    def run(self, name: str, chunks):
        handler, kwargs = self.get(name)
        return handler(chunks, **kwargs)
