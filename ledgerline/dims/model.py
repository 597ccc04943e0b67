"""Plain records that describe the output template."""

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Line:
    key: str
    label: str
    how: str
    tags: tuple = ()
    prefer_nonzero: bool = False
    pinned: bool = False
    latest: bool = False
    instant: bool = False
    omit: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Section:
    id: str
    title: str
    tab: str | None = None
    kind: str | None = None
    after: str | None = None
    instant: bool = False
    lines: tuple = ()


def fetched(key, label, *tags, **flags):
    return Line(key, label, "fetched", tuple(tags), **flags)


def computed(key, label):
    return Line(key, label, "computed")


def market(key, label):
    return Line(key, label, "market")


def manual(key, label):
    return Line(key, label, "manual")


def section(id, title, **kw):
    return Section(id, title, **kw)
