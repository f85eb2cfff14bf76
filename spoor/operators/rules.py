"""The registry of risk indicators: predicates over attributes, by family."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from spoor.functions.attributes import basename, cmd_token, ends_with, first_key, is_executable, stem, text_of

#: Fixed values of the rules.
TRUSTED = ("c:/windows", "c:/program files", "c:/program files (x86)", "/windows/system32", "/windows/syswow64")
WRITABLE = ("/temp/", "/tmp/", "/appdata/", "/roaming/", "/local/temp", "/local/temp/", "/downloads/", "/desktop/", "/programdata/", "/users/")
ENCODING = ("-enc", "-e ", "frombase64", "base64", "certutil -urlcache", "iex(", "new-object net.webclient", "downloadstring", "-w hidden")
RECON = ("whoami", "net user", "net localgroup", "net group", "net view", "systeminfo", "tasklist", "query user", "reg query", "ipconfig /all")
PERSISTENCE = (r"\run" + "\\", r"\runonce" + "\\", "image file execution options", r"\services" + "\\", r"currentversion\run")
DISGUISE = (".exe.", ".bat.", ".cmd.", ".scr.", ".ps1.")
WRITABLE_CODE = ("PAGE_EXECUTE_READWRITE", "PAGE_EXECUTE_WRITECOPY", "RWX", "EXECUTE_READWRITE")
REMOTE_SWITCH = r"(?i)\b(?:--?connect|--?host|--?server|nc(?:\.exe)?)\s+(\d{1,3}(?:\.\d{1,3}){3})(?::(\d{1,5}))?\b"
IP_PORT = r"\b(\d{1,3}(?:\.\d{1,3}){3}):(\d{1,5})\b"
ACCESS_MASK = 0x1F0FFF | 0x0020 | 0x0008


class Indicator(NamedTuple):
    code: str
    family: str
    weight: int
    strong: bool
    predicate: Callable[[Column], Column]
    template: Callable[[Column], Column]


def any_in(value: Column, markers: tuple[str, ...]) -> Column:
    """One pass over the text for all markers."""
    quoted = ("".join(c if c.isalnum() else "\\" + c for c in m) for m in markers)
    return value.rlike("|".join(quoted))


def _slashes(value: Column) -> Column:
    return F.lower(F.translate(text_of(value), "\\", "/"))


def is_user_writable(path: Column) -> Column:
    p = _slashes(path)
    return ~any_in(p, TRUSTED) & any_in(p, WRITABLE)


def _mask(value: Column) -> Column:
    bare = F.trim(text_of(value))
    return F.when(bare.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(bare, 3, 20), 16, 10).cast("long")).when(bare.rlike("^(?:0+|[1-9][0-9]{0,17})$"), bare.cast("long"))


def _name_differs(a: Column) -> Column:
    path, name = first_key(a, "path"), F.lower(first_key(a, "name"))
    base = basename(_slashes(path))
    return path.isNotNull() & name.isNotNull() & base.contains(".") & (name != "") & (stem(base) != stem(_slashes(name))) & ~name.contains(base) & ~base.contains(name)


def _command(a: Column) -> Column:
    return text_of(first_key(a, "cmd", "commandline"))


def _recon(a: Column) -> Column:
    return F.lower(F.trim(_command(a))).rlike("(?:^| )(?:" + "|".join(RECON) + ")")


def _listening(a: Column) -> Column:
    state, port = F.lower(text_of(first_key(a, "state", "status"))), F.trim(first_key(a, "local_port", "localport"))
    return (state.contains("listen") | state.contains("bound")) & F.coalesce(port.try_cast("int") >= 1024, F.lit(False))


def _remote(a: Column) -> Column:
    ip = F.lower(text_of(first_key(a, "remote_ip", "remoteip")))
    return (ip != "") & ~ip.rlike("^(?:127\\.|::|0\\.0\\.0\\.0)")


def _with(prefix: str, *keys: str) -> Callable[[Column], Column]:
    return lambda a: F.concat(F.lit(prefix), text_of(first_key(a, *keys)))


_file = lambda a: text_of(first_key(a, "name", "path"))
#: Codes, weights and reason texts.
REGISTRY: list[Indicator] = [
    Indicator("PSL-01", "pslist", 2, False, lambda a: first_key(a, "path").isNotNull() & is_executable(first_key(a, "name")) & is_user_writable(first_key(a, "path")), _with("process executable in user-writable path: ", "path")),
    Indicator("PSL-02", "pslist", 1, False, _name_differs, lambda a: F.concat(F.lit("process name does not match its on-disk path: "), text_of(first_key(a, "path")), F.lit(" vs "), text_of(first_key(a, "name")))),
    Indicator("CMD-01", "cmdline", 3, True, lambda a: _command(a).rlike(REMOTE_SWITCH) | _command(a).rlike(IP_PORT), _with("command line embeds a remote endpoint: ", "cmd")),
    Indicator("CMD-02", "cmdline", 3, True, _recon, _with("command line contains a recon/administration command: ", "cmd")),
    Indicator("CMD-03", "cmdline", 2, False, lambda a: any_in(F.lower(_command(a)), ENCODING), _with("command line uses obfuscation/encoding: ", "cmd")),
    Indicator("CMD-04", "cmdline", 1, False, lambda a: is_executable(cmd_token(_command(a))) & is_user_writable(cmd_token(_command(a))), _with("command line references an executable in a user-writable path: ", "cmd")),
    Indicator("FS-01", "filescan", 2, False, lambda a: is_executable(_file(a)) & is_user_writable(_file(a)), _with("file is an executable in a user-writable path: ", "name")),
    Indicator("FS-02", "filescan", 1, False, lambda a: any_in(F.lower(_file(a)), DISGUISE), _with("file name suggests disguise: ", "name")),
    Indicator("NS-01", "netscan", 3, True, _remote, lambda a: F.concat(F.lit("outbound network connection to non-loopback address: "), text_of(first_key(a, "remote_ip")), F.lit(":"), text_of(first_key(a, "remote_port")))),
    Indicator("NS-02", "netscan", 2, False, _listening, _with("listening socket on non-default port: ", "local_port")),
    Indicator("DL-01", "dlllist", 2, False, lambda a: ends_with(_file(a), ("dll", "exe")) & is_user_writable(_file(a)), _with("library loaded from a user-writable path: ", "name")),
    Indicator("HD-01", "handles", 2, False, lambda a: F.coalesce(_mask(first_key(a, "granted_access", "access", "mask")).bitwiseAND(ACCESS_MASK) != 0, F.lit(False)), lambda a: F.lit("process handle with elevated access to another process")),
    Indicator("MF-01", "malfind", 3, True, lambda a: F.lit(True), lambda a: F.lit("injected memory region detected by windows.malfind")),
    Indicator("MF-02", "malfind", 2, False, lambda a: any_in(F.upper(text_of(first_key(a, "protection", "vad_protection"))), WRITABLE_CODE), _with("memory region with RWX/executable-write protection: ", "protection")),
    Indicator("PK-01", "printkey", 2, False, lambda a: any_in(F.lower(text_of(first_key(a, "key", "path", "name"))), PERSISTENCE), _with("registry key suggests persistence: ", "key")),
]


def register_indicator(code: str, family: str, weight: int, strong: bool, predicate: Callable[[Column], Column], template: Callable[[Column], Column]) -> None:
    """Add a rule; the predicate and the template take the attributes column."""
    REGISTRY.append(Indicator(code, family, weight, strong, predicate, template))


def families() -> list[str]:
    return sorted({i.family for i in REGISTRY})


def matched(family: Column, attributes: Column) -> Column:
    """Array of (code, weight, strong, reason) of the rules that hold, in registry order."""
    none = F.lit(None).cast("struct<code:string,weight:int,strong:boolean,reason:string>")
    one = lambda i: F.when((family == i.family) & i.predicate(attributes), F.struct(F.lit(i.code).alias("code"), F.lit(i.weight).alias("weight"), F.lit(i.strong).alias("strong"), i.template(attributes).alias("reason"))).otherwise(none)
    return F.array_compact(F.array(*(one(i) for i in REGISTRY)))
