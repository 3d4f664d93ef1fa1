"""Problems with code, severity and path, one by one or many at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from enum import Enum


class Severity(Enum):
    INFO = 0
    WARNING = 1
    ERROR = 2


class Action(Enum):
    """What a stage does about a problem with media."""

    STOP = "stop"
    SKIP = "skip"
    RETRY = "retry"
    IGNORE = "ignore"


STAGES = ("input", "probe", "demuxer", "decoder", "filter", "encoder", "muxer", "output", "config", "resolver", "routing", "pipeline")


@dataclass(frozen=True)
class Item:
    code: str
    message: str
    path: tuple[str, ...] = ()
    severity: Severity = Severity.ERROR

    def under(self, *path: str) -> Item:
        return replace(self, path=(*path, *self.path))

    def __str__(self) -> str:
        at = ".".join(self.path)
        return f"{at}: {self.message}" if at else self.message


class Problems(ValueError):
    """All problems of a step. Several raised ones can be joined into one."""

    def __init__(self, items: Iterable[Item]) -> None:
        self.items = tuple(items)
        super().__init__("; ".join(map(str, self.items)))

    @property
    def fatal(self) -> bool:
        return any(i.severity is Severity.ERROR for i in self.items)


class MediaError(ValueError):
    """A problem in a stage, and what is to be done about it."""

    def __init__(self, stage: str, action: Action, message: str, cause: BaseException | None = None) -> None:
        if stage not in STAGES:
            raise ValueError(f"no stage {stage!r}")
        super().__init__(f"{stage}: {message}")
        self.stage, self.action = stage, action
        self.__cause__ = cause


def items_of(error: BaseException | None) -> Iterator[Item]:
    """The items of an error, of those grouped in it and of what caused it."""
    if error is None:
        return
    if isinstance(error, Problems):
        yield from error.items
    elif isinstance(error, BaseExceptionGroup):
        for e in error.exceptions:
            yield from items_of(e)
    else:
        yield Item(getattr(error, "code", type(error).__name__), str(error), (error.stage,) if hasattr(error, "stage") else ())
    if error.__cause__:
        yield from items_of(error.__cause__)


def check(items: Iterable[Item]) -> None:
    found = list(items)
    if any(i.severity is Severity.ERROR for i in found):
        raise Problems(found)
