"""Column roles of a panel."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Which column plays which part; operators take the pieces they need."""

    row_id: str = "row_id"
    keys: tuple[str, ...] = ()
    time: str | None = None
    codes: tuple[str, ...] = ()
    amounts: tuple[str, ...] = ()
    floats: tuple[str, ...] = ()
    ints: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    #: (latitude, longitude) column pairs in degrees
    points: tuple[tuple[str, str], ...] = ()
    label: str | None = None
    extra: dict = field(default_factory=dict)

    @property
    def numerics(self) -> tuple[str, ...]:
        return self.amounts + self.floats + self.ints
