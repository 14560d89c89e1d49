"""The catalog of fields, and how it is made from a dissector's dump (``-G fields``)."""

from __future__ import annotations

import hashlib
import keyword
import re
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path

GENERATOR = "wirelake catalog 1"


@dataclass(frozen=True)
class DumpedField:
    title: str
    abbrev: str
    ftype: str
    parent: str


@dataclass(frozen=True)
class Dump:
    protocols: Mapping[str, str]
    fields: tuple[DumpedField, ...]
    warnings: tuple[str, ...]


def parse_dump(text: str) -> Dump:
    """P lines (title, name) and F lines (title, name, type, parent, ...), parted by tabs. The first of a name counts; odd lines are told."""
    protocols: dict[str, str] = {}
    found: dict[str, DumpedField] = {}
    warnings: list[str] = []
    widths = {"P": 3, "F": 8}
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip():
            continue
        kind, *rest = line.split("\t")
        if kind not in widths:
            warnings.append(f"line {n}: neither a protocol nor a field: {kind!r}")
        elif len(rest) + 1 != widths[kind]:
            warnings.append(f"line {n}: {len(rest) + 1} columns, not {widths[kind]}")
        elif rest[1] in (protocols if kind == "P" else found):
            warnings.append(f"line {n}: {rest[1]!r} a second time")
        elif kind == "P":
            protocols[rest[1]] = rest[0]
        else:
            found[rest[1]] = DumpedField(*rest[:4])
    return Dump(protocols, tuple(found.values()), tuple(warnings))


def _identifier(text: str, digit: str, dash: str) -> str:
    s = re.sub(r"[^0-9A-Za-z]", "_", text)
    s = f"{digit}_{s}" if s[0].isdigit() else f"{dash}{s}" if s[0] == "_" else s
    return f"{s}_" if keyword.iskeyword(s) else s


def attribute(abbrev: str, parent: str) -> str:
    """The Python name of a field: without its protocol, other signs as _."""
    if not abbrev:
        raise ValueError("a field without a name")
    own = abbrev.removeprefix(f"{parent}.")
    return _identifier(own or abbrev, "f", "f")


def module_name(abbrev: str) -> str:
    if not abbrev:
        raise ValueError("a protocol without a name")
    return _identifier(abbrev.lower(), "p", "p")


def chosen(fields: Iterable[DumpedField], parent: str) -> tuple[list[DumpedField], list[str]]:
    """One field for each attribute: the first, but a field with data before a mere marker (FT_NONE), which it replaces in its place."""
    by: dict[str, DumpedField] = {}
    warnings = []
    for f in fields:
        name = attribute(f.abbrev, parent)
        have = by.setdefault(name, f)
        if have is not f:
            better = have.ftype == "FT_NONE" != f.ftype
            by[name] = f if better else have
            warnings.append(f"{name}: {by[name].abbrev} rather than {(have if better else f).abbrev}")
    return list(by.values()), warnings


@dataclass(frozen=True)
class ProtocolCatalog:
    abbrev: str
    title: str
    fields: tuple[tuple[str, str, bool], ...]


def write_catalog(c: ProtocolCatalog, header: Iterable[str] = ()) -> str:
    """Lines of a type and its fields; a leading dot stands for the protocol's name, a trailing * for several occurrences."""
    by: dict[str, list[str]] = {}
    for abbrev, ftype, multi in c.fields:
        own = abbrev[len(c.abbrev) :] if abbrev.startswith(f"{c.abbrev}.") else abbrev
        by.setdefault(ftype, []).append(own + "*" * multi)
    return "".join(f"# {h}\n" for h in header) + f"{c.abbrev} {c.title}\n" + "".join(f"{t}: {' '.join(sorted(xs))}\n" for t, xs in sorted(by.items()))


def stubs(catalogs: Iterable[ProtocolCatalog]) -> str:
    """A type stub of ``wirelake.protocols`` for editors and type checkers: a class for each protocol, with its fields and what they hold."""
    out = ["from wirelake.expr import FieldRef", "", "class Protocol:", "    def __call__(self, packet) -> object: ...", "", "def names() -> tuple[str, ...]: ...", "def protocol(name: str) -> Protocol: ..."]
    for c in catalogs:
        name = module_name(c.abbrev).upper()
        kept, _ = chosen((DumpedField("", a, t, c.abbrev) for a, t, _ in c.fields), c.abbrev)
        multi = {a for a, _, m in c.fields if m}
        out += ["", f"class _{name}(Protocol):", f'    """{c.title}"""'.replace("\\", ""), *[f"    {attribute(f.abbrev, c.abbrev)}: FieldRef  # {f.abbrev} {f.ftype}{'[]' if f.abbrev in multi else ''}" for f in kept], "", f"{name}: _{name}"]
    return "\n".join(out) + "\n"


def read_catalog(text: str) -> ProtocolCatalog:
    first, *rest = [x for x in text.splitlines() if x and not x.startswith("#")]
    abbrev, _, title = first.partition(" ")
    fields = []
    for line in rest:
        ftype, _, names = line.partition(": ")
        for n in names.split(" "):
            own = n.removesuffix("*")
            fields.append((abbrev + own if own.startswith(".") else own, ftype, n.endswith("*")))
    return ProtocolCatalog(abbrev, title, tuple(fields))


def canonical(dump: str) -> str:
    """The dump's lines in order, so that it doesn't depend on the order in which plug-ins load."""
    return "".join(f"{x}\n" for x in sorted(dump.splitlines()) if x.strip())


def header(dump: str, version: str, plugins: str = "") -> list[str]:
    """What a catalog was made from and by."""
    own = sorted("\t".join(x.split("\t")[:3]) for x in plugins.splitlines() if x.strip())
    return [f"dissector: {version}", f"dump: {hashlib.sha256(canonical(dump).encode()).hexdigest()}", f"plug-ins: {hashlib.sha256(chr(10).join(own).encode()).hexdigest()[:12] if own else 'none'}", f"made by: {GENERATOR}"]


@dataclass(frozen=True)
class Config:
    version: str
    protocols: tuple[str, ...]
    multi: frozenset[str]


def load_config(path: str | Path) -> Config:
    """TOML: ``version``, ``protocols`` and ``multi`` (fields that occur several times, which dumps don't tell)."""
    x = tomllib.loads(Path(path).read_text())
    for k, kind in (("version", str), ("protocols", list), ("multi", list)):
        if not isinstance(x.get(k), kind):
            raise ValueError(f"{path}: {k} has to be a {kind.__name__}")
    for k in ("protocols", "multi"):
        if not all(isinstance(v, str) for v in x[k]) or len(set(x[k])) < len(x[k]):
            raise ValueError(f"{path}: {k} are names, each once")
    return Config(x["version"], tuple(x["protocols"]), frozenset(x["multi"]))


def generate(config: Config, dump: str, plugins: str = "") -> tuple[dict[str, str], list[str]]:
    """File names and texts of the catalog, and warnings."""
    d = parse_dump(canonical(dump))
    out: dict[str, str] = {}
    warnings = list(d.warnings)
    by: dict[str, list[DumpedField]] = {}
    for f in d.fields:
        by.setdefault(f.parent, []).append(f)
    for p in config.protocols:
        if p not in d.protocols:
            raise ValueError(f"the dump has no protocol {p!r}")
        name = f"{module_name(p)}.txt"
        if name in out:
            raise ValueError(f"two protocols would be {name}")
        fields, more = chosen(by.get(p, ()), p)
        warnings += more
        out[name] = write_catalog(ProtocolCatalog(p, d.protocols[p], tuple((f.abbrev, f.ftype, f.abbrev in config.multi) for f in fields)), header(dump, config.version, plugins))
    return out, warnings


def drifted(made: Mapping[str, str], folder: str | Path) -> list[str]:
    """Files that are missing, differ or don't belong."""
    have = {p.name: p.read_text(encoding="utf-8") for p in Path(folder).glob("*.txt")}
    return [f"{n}: missing" for n in sorted(made.keys() - have)] + [f"{n}: differs" for n in sorted(made.keys() & have) if made[n] != have[n]] + [f"{n}: not in the configuration" for n in sorted(have.keys() - made)]
