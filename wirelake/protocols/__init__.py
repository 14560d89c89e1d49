"""Protocols' fields by attribute: ``from wirelake.protocols import IP, TCP``; ``IP.src == "192.0.2.7"``, ``TCP.port.in_([80])``.

The catalog is data, one text for each protocol, that is read when the protocol is first used. ``python -m wirelake.protocols write``
makes it from a dissector's dump of its fields.
"""

from __future__ import annotations

from functools import cache
from importlib.resources import files

from wirelake.expr import FieldRef
from wirelake.protocols.catalog import attribute, module_name, read_catalog


class Protocol:
    """Fields as attributes; ``packet[TCP]`` or ``TCP(packet)`` reads the typed values of a raw packet (field name to occurrences)."""

    def __init__(self, abbrev: str, title: str, table: dict[str, tuple[str, str, bool]]):
        self._abbrev, self._title, self._table = abbrev, title, table

    def __getattr__(self, name: str) -> FieldRef:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._table:
            raise AttributeError(f"{self._abbrev} has no field {name!r}")
        ref = FieldRef(*self._table[name])
        self.__dict__[name] = ref
        return ref

    def __dir__(self):
        return sorted(self._table)

    def __call__(self, packet) -> View:
        return View(self, packet)

    def __repr__(self) -> str:
        return f"<{self._title} ({self._abbrev}), {len(self._table)} fields>"


class View:
    """Typed values of one packet: a single field's first occurrence or None, all occurrences of others."""

    def __init__(self, protocol: Protocol, packet):
        self._protocol, self._packet = protocol, packet

    def __getattr__(self, name: str):
        from wirelake.ftypes import field_type

        ref = getattr(self._protocol, name)
        raw, parse = self._packet.get(ref.name) or (), field_type(ref.ftype).parse
        return tuple(map(parse, raw)) if ref.multi else parse(raw[0]) if raw else None


@cache
def names() -> tuple[str, ...]:
    """Module names of all protocols in the catalog."""
    return tuple(sorted(p.name[:-4] for p in files(__name__).joinpath("data").iterdir() if p.name.endswith(".txt")))


@cache
def protocol(name: str) -> Protocol:
    """A protocol by its dissector's name (``tcp``)."""
    at = files(__name__).joinpath("data").joinpath(f"{module_name(name)}.txt")
    if not at.is_file():
        raise LookupError(f"no protocol {name!r} in the catalog")
    c = read_catalog(at.read_text(encoding="utf-8"))
    return Protocol(c.abbrev, c.title, {attribute(a, c.abbrev): (a, t, m) for a, t, m in c.fields})


def __getattr__(name: str) -> Protocol:
    if name.isupper() and name.lower() in names():
        return protocol(name.lower())
    raise AttributeError(f"no protocol {name!r} in the catalog")
