"""Named components and linear pipelines of them."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable

from spotlake.model import Assay

READERS: dict[str, Callable] = {}
COMPONENTS: dict[str, Callable] = {}


def reader(name: str) -> Callable:
    def note(f: Callable) -> Callable:
        READERS[name] = f
        return f

    return note


def component(name: str) -> Callable:
    """Register f(assay, **options) -> assay under name. Calling the registered factory with options gives f of the assay alone."""

    def note(f: Callable) -> Callable:
        def factory(*args, **options):
            return functools.partial(_call, f, args, options)

        signature = inspect.signature(f)
        factory.__signature__ = signature.replace(parameters=list(signature.parameters.values())[1:])
        factory.__doc__ = f.__doc__
        COMPONENTS[name] = factory
        return f

    return note


def _call(f: Callable, args: tuple, options: dict, assay: Assay) -> Assay:
    return f(assay, *args, **options)


class Pipeline:
    """A reader and components in order. Everything stays lazy until a table of the result is used."""

    def __init__(self, reader: str | Callable = "read", **options):
        if isinstance(reader, str) and reader not in READERS:
            raise ValueError(f"no reader is called {reader!r}")
        self.reader = functools.partial(READERS[reader] if isinstance(reader, str) else reader, **options)
        self.components: list[tuple[str, Callable[[Assay], Assay]]] = []

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.components]

    def add_pipe(self, what: str | Callable, name: str | None = None, after: str | int | None = None, before: str | int | None = None, first: bool = False, last: bool = False, **options) -> None:
        """Put a component (by registered name, or a function of an assay) at the end, or where at most one of the others says."""
        if sum(x is not None and x is not False for x in (after, before, first or None, last or None)) > 1:
            raise ValueError("give at most one of after, before, first and last")
        if isinstance(what, str):
            if what not in COMPONENTS:
                raise ValueError(f"no component is called {what!r}")
            name, made = name or what, COMPONENTS[what](**options)
        else:
            name, made = name or getattr(what, "__name__", repr(what)), functools.partial(what, **options) if options else what
        if name in self.names:
            raise ValueError(f"there is already a pipe called {name!r}")
        at = len(self.components)
        if first:
            at = 0
        elif after is not None:
            at = self._place(after) + 1
        elif before is not None:
            at = self._place(before)
        self.components.insert(at, (name, made))

    def _place(self, anchor: str | int) -> int:
        if isinstance(anchor, int):
            if not -len(self.components) <= anchor < len(self.components):
                raise ValueError(f"there is no pipe {anchor}")
            return anchor % len(self.components)
        if anchor not in self.names:
            raise ValueError(f"there is no pipe called {anchor!r}")
        return self.names.index(anchor)

    def remove_pipe(self, name: str) -> None:
        if not self.components:
            raise ValueError("the pipeline is empty")
        del self.components[self._place(name)]

    def __call__(self, data, **options) -> Assay | list[Assay]:
        """One assay, or a list of them if the data hold several."""
        done = []
        for assay in self.reader(data, **options):
            for _, run in self.components:
                assay = run(assay)
            done.append(assay)
        return done[0] if len(done) == 1 else done
