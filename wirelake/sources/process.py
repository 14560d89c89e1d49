"""A dissector program as a line source; runs where the task runs."""

from __future__ import annotations

import os
import subprocess
import threading
from collections import deque
from collections.abc import Iterator, Sequence

from wirelake.errors import DissectorError, DissectorNotFoundError
from wirelake.expr import FieldRef

COLUMN, OCCURRENCE = "\x1f", "\x1e"


def program(explicit: str | None = None) -> str:
    return explicit or os.environ.get("TSHARK") or "tshark"


def fields_arguments(refs: Sequence[FieldRef]) -> list[str]:
    out = ["-T", "fields"]
    for r in refs:
        out += ["-e", r.name]
    return [*out, "-E", f"separator={COLUMN}", "-E", f"aggregator={OCCURRENCE}", "-E", "occurrence=a", "-E", "quote=n"]


def command(tool: str, capture: str, display: str | None, refs: Sequence[FieldRef] | None) -> list[str]:
    """The program's arguments: one line of fields for each packet, or everything as JSON lines where ``refs`` is None."""
    return [tool, "-r", capture, *(["-Y", display] if display is not None else []), *(["-T", "ek"] if refs is None else fields_arguments(refs))]


def version(tool: str, timeout: float = 30) -> str:
    """The program's version line."""
    try:
        said = subprocess.run([tool, "--version"], capture_output=True, text=True, timeout=timeout, check=True).stdout
    except (OSError, subprocess.SubprocessError) as e:
        raise DissectorNotFoundError(f"{tool!r} doesn't tell its version: {e}") from e
    first = said.strip().splitlines()
    if not first:
        raise DissectorError(f"{tool!r} tells no version")
    return first[0].strip()


def lines(argv: Sequence[str], patience: float = 3) -> Iterator[str]:
    """The output's lines; a failure is raised at the end, an early stop of the reader is none."""
    try:
        p = subprocess.Popen(list(argv), stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    except OSError as e:
        raise DissectorNotFoundError(f"{argv[0]!r} can't be run: {e}") from e
    last: deque[bytes] = deque(maxlen=256)
    reader = threading.Thread(target=lambda: last.extend(p.stderr), daemon=True)
    reader.start()
    try:
        for raw in p.stdout:
            yield raw.decode("utf-8", "replace").rstrip("\r\n")
        code = p.wait()
        reader.join(patience)
        if code:
            raise DissectorError(f"{argv[0]} ended with {code}: {b''.join(last).decode('utf-8', 'replace').strip()}")
    finally:
        if p.poll() is None:
            p.terminate()
            try:
                p.wait(patience)
            except subprocess.TimeoutExpired:
                p.kill()
                p.wait()
        p.stdout.close()
