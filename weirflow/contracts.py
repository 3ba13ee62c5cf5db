"""Closed parameter records.

A record is a frozen dataclass that takes exactly its own fields. ``of`` builds one from a
mapping and rejects unknown keys, keys that could carry code, values JSON cannot hold, and
whatever the record's own ``check`` rejects. Nothing in a parameter is ever evaluated.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields
from typing import Any


class ContractError(ValueError):
    """A parameter record is not what its operation allows."""


#: Keys that no parameter may have at any depth: fixed values.
RESERVED_KEYS = frozenset(
    ("shell", "command", "cmd", "python", "python_code", "script", "sql", "import_path", "entrypoint", "executable")
)


def reject_code(value: Any) -> None:
    """Raise if a parameter value holds a reserved key or something JSON cannot hold."""
    if isinstance(value, Mapping):
        taken = RESERVED_KEYS.intersection(value)
        if taken:
            raise ContractError(f"reserved parameter: {min(taken)}")
        for key, item in value.items():
            if not isinstance(key, str):
                raise ContractError("parameter keys must be strings")
            reject_code(item)
    elif isinstance(value, (list, tuple)):
        for item in value:
            reject_code(item)
    elif isinstance(value, float):
        if not math.isfinite(value):
            raise ContractError("numbers must be finite")
    elif value is not None and not isinstance(value, (str, int, bool, Record)):
        raise ContractError("parameters must be JSON values")


class Record:
    """Base of the parameter records; subclasses are frozen dataclasses."""

    @classmethod
    def of(cls, value: Any):
        if isinstance(value, cls):
            return value
        if not isinstance(value, Mapping):
            raise ContractError(f"{cls.__name__} needs a mapping")
        reject_code(value)
        known = {f.name for f in fields(cls)}
        needed = {f.name for f in fields(cls) if f.default is MISSING and f.default_factory is MISSING}
        if extra := set(value) - known:
            raise ContractError(f"unknown parameter: {min(extra)}")
        if absent := needed - set(value):
            raise ContractError(f"missing parameter: {min(absent)}")
        return cls(**value)

    def __post_init__(self) -> None:
        self.check()

    def check(self) -> None:
        """Raise ContractError if the values do not fit together."""

    def _set(self, name: str, value: Any) -> None:
        object.__setattr__(self, name, value)

    def _need(self, ok: bool, message: str) -> None:
        if not ok:
            raise ContractError(message)

    def _names(self, name: str, least: int = 0) -> None:
        """The field is a tuple of at least so many non-empty strings."""
        value = getattr(self, name)
        self._need(isinstance(value, (list, tuple)), f"{name} must be a list of names")
        self._need(all(isinstance(x, str) and x for x in value), f"{name} must be a list of names")
        self._need(len(value) >= least, f"{name} needs at least {least} names")
        self._set(name, tuple(value))

    def _one_of(self, name: str, *choices: str) -> None:
        self._need(getattr(self, name) in choices, f"{name} must be one of {', '.join(choices)}")

    def _whole(self, name: str, least: int | None = None, most: int | None = None) -> None:
        value = getattr(self, name)
        ok = isinstance(value, int) and not isinstance(value, bool)
        ok = ok and (least is None or value >= least) and (most is None or value <= most)
        self._need(ok, f"{name} must be a whole number" + (f" from {least}" if least is not None else "") + (f" to {most}" if most is not None else ""))

    def _records(self, name: str, kind: type, least: int = 0) -> None:
        value = getattr(self, name)
        self._need(isinstance(value, (list, tuple)) and len(value) >= least, f"{name} needs at least {least} entries")
        self._set(name, tuple(kind.of(x) for x in value))


def record(cls):
    return dataclass(frozen=True)(cls)
