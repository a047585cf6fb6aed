"""Archives: what they hold, and taking files out, also of archives within archives."""

from __future__ import annotations

import gzip
import os
import shutil
import subprocess
import tarfile
import zipfile
from collections.abc import Iterable

# File extensions and the first bytes of formats.
INTERNAL = ("tar", "tar.gz", "tgz", "zip", "gz")
SYSTEM = ("rar", "7z")
EXTENSIONS = INTERNAL + SYSTEM
MAGIC = (
    (b"PK\x03\x04", "zip"),
    (b"Rar!", "rar"),
    (b"7z\xbc\xaf\x27\x1c", "7z"),
    (b"\x1f\x8b", "gz"),
    (b"II*\x00", "tif"),
    (b"MM\x00*", "tif"),
    (b"\x00\x00\x27\x0a", "shp"),
)


def sniffed(path: str) -> str | None:
    """The extension that a file's first bytes stand for."""
    with open(path, "rb") as file:
        head = file.read(512)
    for magic, name in MAGIC:
        if head.startswith(magic):
            return name
    return "tar" if head[257:262] == b"ustar" else None


def with_extension(path: str) -> str:
    """Give a file without an extension the one that its content stands for (zip if unknown); returns its new path."""
    if os.path.splitext(path)[1]:
        return path
    new = f"{path}.{sniffed(path) or 'zip'}"
    os.replace(path, new)
    return new


def archive_type(path: str) -> str | None:
    low = path.lower()
    return next((e for e in sorted(EXTENSIONS, key=len, reverse=True) if low.endswith(f".{e}")), None)


def is_archive(path: str) -> bool:
    return archive_type(path) is not None


def members(path: str) -> list[str]:
    """Names of the files (not folders) in an archive."""
    kind = archive_type(path)
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            return [n for n in z.namelist() if not n.endswith("/")]
    if kind in ("tar", "tar.gz", "tgz"):
        with tarfile.open(path) as t:
            return [m.name for m in t.getmembers() if m.isfile()]
    if kind == "gz":
        return [os.path.basename(path)[: -len(".gz")]]
    if kind in SYSTEM:
        return listed(subprocess.run([_tool(kind), "-slt", "l", path], capture_output=True, text=True, check=True).stdout)
    raise ValueError(f"{path} is not a known kind of archive")


def listed(text: str) -> list[str]:
    """Names of files in the technical listing of a 7z program: blocks of ``Name = value`` below a line of dashes."""
    _, _, blocks = text.partition("\n----------\n")
    found = []
    for block in blocks.split("\n\n"):
        told = dict(line.split(" = ", 1) for line in block.splitlines() if " = " in line)
        if "Path" in told and told.get("Folder", "-") != "+" and not told.get("Attributes", "").startswith("D"):
            found.append(told["Path"].replace("\\", "/"))
    return found


def _tool(kind: str) -> str:
    for name in ("7z", "7za", "7zr") + (("unrar",) if kind == "rar" else ()):
        if found := shutil.which(name):
            return found
    raise RuntimeError(f"a program for .{kind} archives is needed (7z)")


def _safe(folder: str, name: str) -> str:
    path = os.path.normpath(os.path.join(folder, name))
    if not path.startswith(os.path.abspath(folder) + os.sep):
        raise ValueError(f"{name} would leave the folder")
    return path


def extract(path: str, folder: str, wanted: Iterable[str] | None = None) -> list[str]:
    """Take out the ``wanted`` members (by name or last component; all if None); returns the files' paths."""
    folder = os.path.abspath(folder)
    os.makedirs(folder, exist_ok=True)
    names = None if wanted is None else set(wanted)
    take = lambda n: names is None or n in names or os.path.basename(n) in names
    kind, out = archive_type(path), []
    if kind == "zip":
        with zipfile.ZipFile(path) as z:
            for n in z.namelist():
                if not n.endswith("/") and take(n):
                    to = _safe(folder, n)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with z.open(n) as source, open(to, "wb") as target:
                        shutil.copyfileobj(source, target)
                    out.append(to)
    elif kind in ("tar", "tar.gz", "tgz"):
        with tarfile.open(path) as t:
            for m in t.getmembers():
                if m.isfile() and take(m.name):
                    to = _safe(folder, m.name)
                    os.makedirs(os.path.dirname(to), exist_ok=True)
                    with t.extractfile(m) as source, open(to, "wb") as target:
                        shutil.copyfileobj(source, target)
                    out.append(to)
    elif kind == "gz":
        to = os.path.join(folder, members(path)[0])
        if take(os.path.basename(to)):
            with gzip.open(path) as source, open(to, "wb") as target:
                shutil.copyfileobj(source, target)
            out.append(to)
    elif kind in SYSTEM:
        subprocess.run([_tool(kind), "x", "-y", f"-o{folder}", path], check=True, capture_output=True)
        out = [os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if take(f)]
    else:
        raise ValueError(f"{path} is not a known kind of archive")
    return out


def extract_nested(path: str, folder: str, wanted: Iterable[str] | None = None, depth: int = 5) -> list[str]:
    """As ``extract``; archives inside are opened too, until all that is wanted is found."""
    names = None if wanted is None else {os.path.basename(w) for w in wanted}
    inside = members(path)
    inner = [m for m in inside if is_archive(m)]
    have = {os.path.basename(m) for m in inside}
    out = extract(path, folder, None if names is None else names & have) if names is None or names & have else []
    missing = None if names is None else names - have
    if inner and depth and (missing is None or missing):
        for one in extract(path, folder, inner):
            found = extract_nested(one, folder, missing, depth - 1)
            out = [p for p in out if p != one] + found
            if missing is not None:
                missing -= {os.path.basename(p) for p in found}
                if not missing:
                    break
    return out


def folders_of(names: Iterable[str]) -> list[str]:
    """Names that are folders of others."""
    prefixes: dict[str, int] = {}
    for n in names:
        parts = n.rstrip("/").split("/")
        for k in range(1, len(parts) + 1):
            prefixes["/".join(parts[:k])] = prefixes.get("/".join(parts[:k]), 0) + 1
    return sorted(p for p, n in prefixes.items() if n > 1)
