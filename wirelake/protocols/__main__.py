"""``python -m wirelake.protocols check|write|stubs``: the catalog against a dissector's fields, and its type stub."""

from __future__ import annotations

import argparse
import subprocess
import sys
from pathlib import Path

from wirelake.protocols.catalog import drifted, generate, load_config, read_catalog, stubs
from wirelake.sources.process import program, version


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="python -m wirelake.protocols")
    a.add_argument("command", choices=("check", "write", "stubs"))
    a.add_argument("--config", default="catalog.toml")
    a.add_argument("--folder", default=str(Path(__file__).with_name("data")))
    a.add_argument("--dissector")
    a.add_argument("--stub", default=str(Path(__file__).with_name("__init__.pyi")))
    o = a.parse_args(argv)
    if o.command == "stubs":
        have = [read_catalog(p.read_text(encoding="utf-8")) for p in sorted(Path(o.folder).glob("*.txt"))]
        Path(o.stub).write_text(stubs(have), encoding="utf-8")
        print(f"{len(have)} protocols in {o.stub}")
        return 0
    try:
        config, tool = load_config(o.config), program(o.dissector)
        said = version(tool)
        if config.version not in said:
            raise ValueError(f"the dissector is {said!r}, the configuration is for {config.version}")
        dump = lambda what: subprocess.run([tool, "-G", what], check=True, capture_output=True, text=True).stdout
        made, warnings = generate(config, dump("fields"), dump("plugins"))
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    if o.command == "write":
        for name, text in made.items():
            (Path(o.folder) / name).write_text(text, encoding="utf-8")
        print(f"{len(made)} protocols written")
        return 0
    for m in (wrong := drifted(made, o.folder)):
        print(m, file=sys.stderr)
    return int(bool(wrong))


if __name__ == "__main__":
    raise SystemExit(main())
