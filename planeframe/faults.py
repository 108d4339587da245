"""Failures on purpose, to try what a plan does when a source fails."""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Mapping
from typing import Any

from .errors import KernelValidationError


class FlakySource:
    """A source whose given calls (numbered from 1 for each operation) raise ``error``; all else is the inner source's.

    An unnamed error is an ``OSError``, which the engine takes for a failure of the source.
    """

    def __init__(self, inner: Any, failing: Mapping[str, Collection[int]], error: Exception | None = None):
        if not failing or any(n < 1 for calls in failing.values() for n in calls):
            raise KernelValidationError("name operations and the numbers of their failing calls, from 1")
        if unknown := set(failing) - set(inner.descriptor.capabilities):
            raise KernelValidationError(f"the source has no {sorted(unknown)}")
        self.inner, self.failing, self.error = inner, {k: frozenset(v) for k, v in failing.items()}, error or OSError("a fault on purpose")
        self.calls: Counter[str] = Counter()

    def __getattr__(self, name: str) -> Any:
        what = getattr(self.inner, name)
        if name not in self.failing:
            return what

        def call(*args: Any) -> Any:
            self.calls[name] += 1
            if self.calls[name] in self.failing[name]:
                raise self.error
            return what(*args)

        return call
