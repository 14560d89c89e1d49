import stat
import sys

import pytest

from wirelake.protocols import DNS, IP, TCP, names, protocol
from wirelake.protocols.__main__ import main
from wirelake.protocols.catalog import attribute, chosen, generate, load_config, module_name, parse_dump, read_catalog, write_catalog

DUMP = "P\tInternet Protocol\tip\nP\tInternet Protocol\tip\nF\tSource\tip.src\tFT_IPv4\tip\t\t0x0\t\nF\tPort\tip.port\tFT_UINT16\tip\tBASE_DEC\t0x0\t\nF\tMark\tip.a-b\tFT_NONE\tip\t\t0x0\t\nF\tData\tip.a.b\tFT_UINT8\tip\t\t0x0\t\nF\tshort\nX\ty\n"


def test_fields():
    assert (IP.src.name, IP.src.ftype, IP.src.multi) == ("ip.src", "FT_IPv4", False)
    assert TCP.port.multi and DNS.qry_name.multi and not TCP.srcport.multi and (TCP.port == 80).field.name == "tcp.port"
    assert len(names()) == 37 and sum(len(dir(protocol(n))) for n in names()) == 13_138
    for bad in (lambda: IP.nothing, lambda: IP._x):
        with pytest.raises(AttributeError):
            bad()
    with pytest.raises(LookupError):
        protocol("nothing")
    with pytest.raises(ImportError):
        from wirelake.protocols import NOTHING  # noqa: F401


def test_views():
    packet = {"ip.src": ("10.0.0.1",), "tcp.port": ("1", "2"), "tcp.srcport": ("1", "9")}
    assert str(IP(packet).src) == "10.0.0.1" and IP(packet).dst is None and TCP(packet).port == (1, 2) and TCP(packet).srcport == 1 and DNS(packet).qry_name == ()


def test_names_of_attributes():
    assert [attribute(a, "ip") for a in ("ip.src", "ip", "ip.", "other.x", "ip.6to4", "ip._x", "ip.class", "ip.é")] == ["src", "ip", "ip_", "other_x", "f_6to4", "f_x", "class_", "f_"]
    assert module_name("6LoWPAN") == "p_6lowpan" and module_name("import") == "import_"
    with pytest.raises(ValueError):
        attribute("", "ip")


def test_dump():
    d = parse_dump(DUMP)
    assert dict(d.protocols) == {"ip": "Internet Protocol"} and [f.abbrev for f in d.fields] == ["ip.src", "ip.port", "ip.a-b", "ip.a.b"] and len(d.warnings) == 3
    kept, warnings = chosen(d.fields, "ip")
    assert [f.abbrev for f in kept] == ["ip.src", "ip.port", "ip.a.b"] and len(warnings) == 1


def test_make_and_check(tmp_path, capsys):
    (tmp_path / "c.toml").write_text('version = "4.6"\nprotocols = ["ip"]\nmulti = ["ip.port"]\n')
    made, _ = generate(load_config(tmp_path / "c.toml"), DUMP)
    c = read_catalog(made["ip.txt"])
    assert ("ip.port", "FT_UINT16", True) in c.fields and read_catalog(write_catalog(c)) == c
    tool = tmp_path / "tool"
    tool.write_text(f"#!{sys.executable}\nimport sys\nprint('T 4.6.6' if '--version' in sys.argv else '' if 'plugins' in sys.argv else {DUMP!r}, end='')\n")
    tool.chmod(tool.stat().st_mode | stat.S_IEXEC)
    out = tmp_path / "out"
    out.mkdir()
    run = lambda cmd: main([cmd, "--config", str(tmp_path / "c.toml"), "--folder", str(out), "--dissector", str(tool)])
    assert run("check") == 1 and run("write") == 0 and run("check") == 0
    (out / "stray.txt").write_text("x y\n")
    (out / "ip.txt").write_text("x y\n")
    assert run("check") == 1 and "stray.txt" in capsys.readouterr().err
    (tmp_path / "c.toml").write_text('version = "9"\nprotocols = ["ip"]\nmulti = []\n')
    assert run("check") == 2
    for bad in ('version = 3\nprotocols=[]\nmulti=[]\n', 'version = "1"\nprotocols=["a","a"]\nmulti=[]\n'):
        (tmp_path / "c.toml").write_text(bad)
        with pytest.raises(ValueError):
            load_config(tmp_path / "c.toml")


def test_stubs(tmp_path, capsys):
    import ast

    at = tmp_path / "protocols.pyi"
    assert main(["stubs", "--stub", str(at)]) == 0
    classes = {n.name: {x.target.id for x in n.body if isinstance(x, ast.AnnAssign)} for n in ast.parse(at.read_text()).body if isinstance(n, ast.ClassDef)}
    assert classes["_TCP"] == set(dir(TCP)) and classes["_DNS"] == set(dir(DNS)) and len(classes) == 38
    assert "    port: FieldRef  # tcp.port FT_UINT16[]\n" in at.read_text()


def test_data_tell_their_origin():
    from importlib.resources import files

    assert all(p.read_text(encoding="utf-8").startswith("# ") for p in files("wirelake.protocols").joinpath("data").iterdir())
