"""From an address to data: validate what is there, fetch, unpack, choose a reader, load, conform.

What is needed is decided by which of address, archive and target are given; files that the manifest finds OK are not
fetched again, also if they lie in one of the shared input folders.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from cairnflow.functions import digest
from cairnflow.operators import manifest as m
from cairnflow.sources import archives, download, readers

MANIFEST = "CHECKSUMS.txt"


@dataclass
class Source:
    """Where data comes from: any of an address, an archive and a target file; ``also``: None (all), "similar", or names."""

    url: str | None = None
    archive: str | None = None
    target: str | None = None
    also: str | list[str] | None = None
    checksum: dict[str, str] = field(default_factory=dict)


@dataclass
class Ingested:
    files: list[str]
    target: str
    fetched: bool
    result: list[dict]


def names_of(source: Source) -> Source:
    """Fill in the names that follow from others: an address that ends in an archive's name is that archive."""
    archive, target = source.archive, source.target
    if source.url and not archive and not target:
        name = download.file_name_of(source.url)
        if archives.is_archive(name) or not os.path.splitext(name)[1]:
            archive = name
        else:
            target = name
    elif source.url and not archive and target:
        name = download.file_name_of(source.url)
        if archives.is_archive(name) and os.path.basename(target) != name:
            archive = name
    return Source(source.url, archive, target, source.also, source.checksum)


def _local_manifest(folder: str) -> dict[str, tuple[str, str, str]]:
    """A small manifest file as a dict: file -> (checksum, size, algorithm)."""
    path = os.path.join(folder, MANIFEST)
    found: dict[str, tuple[str, str, str]] = {}
    if os.path.exists(path):
        with open(path) as file:
            lines = [line.split() for line in file.read().splitlines() if line.strip()]
        names = [n.strip('"') for n in lines[0]] if lines else []
        for line in lines[1:]:
            row = dict(zip(names, (v.strip('"') for v in line)))
            found[row["file"]] = (row.get("checksum", ""), row.get("filesize", ""), row.get("algorithm", m.DEFAULT_ALGORITHM))
    return found


def _write_manifest(folder: str, rows: dict[str, tuple[str, str, str]]) -> None:
    path = os.path.join(folder, MANIFEST)
    with open(f"{path}.new", "w") as file:
        file.write('"file" "checksum" "filesize" "algorithm"\n')
        for name in sorted(rows):
            file.write(" ".join(f'"{v}"' for v in (name, *rows[name])) + "\n")
    os.replace(f"{path}.new", path)


def check(folder: str, names: Iterable[str], quick: bool = False) -> list[dict]:
    """Each name against the folder's manifest: OK, FAIL, or None if the file or its row is missing."""
    known, out = _local_manifest(folder), []
    for name in names:
        path = os.path.join(folder, name)
        row = {"result": None, "expectedFile": name, "actualFile": name if os.path.exists(path) else None}
        if name in known and os.path.isfile(path):
            checksum, size, algorithm = known[name]
            ok = size == str(os.path.getsize(path)) and (quick or checksum == digest.file_hash(path, algorithm))
            row["result"] = "OK" if ok else "FAIL"
        elif os.path.isdir(path):
            row["result"] = "OK"
        out.append(row)
    return out


def record(folder: str, names: Iterable[str], algorithm: str = m.DEFAULT_ALGORITHM) -> None:
    """Put files in the folder's manifest, in place of older rows."""
    rows = _local_manifest(folder)
    for name in names:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            rows[name] = (digest.file_hash(path, algorithm), str(os.path.getsize(path)), algorithm)
    _write_manifest(folder, rows)


def purge(folder: str, level: int, source: Source) -> None:
    """Drop manifest rows by role, see ``manifest.PURGE``."""
    if not level:
        return
    rows = _local_manifest(folder)
    roles = {"target": {source.target}, "archive": {source.archive}, "also": set(source.also) if isinstance(source.also, list) else set()}
    gone = set(rows) if m.PURGE[level] == ("all",) else {f for role in m.PURGE[level] for f in roles[role]}
    _write_manifest(folder, {k: v for k, v in rows.items() if k not in gone})


def _needed(source: Source, archive_path: str | None) -> list[str] | None:
    """Names to take out of the archive: None for all."""
    if source.target is None or archive_path is None:
        return None
    base = os.path.basename(source.target)
    if source.also is None:
        return None
    if source.also == "similar":
        stem = os.path.splitext(base)[0]
        return [x for x in archives.members(archive_path) if os.path.splitext(os.path.basename(x))[0] == stem] or [base]
    return [base, *map(os.path.basename, source.also)]


def acquire(source: Source, folder: str, input_paths: Iterable[str] = (), own: Callable | None = None, quick: bool = False, overwrite: bool = False, purge_level: int = 0, algorithm: str = m.DEFAULT_ALGORITHM) -> Ingested:
    """The source's files in ``folder``, fetched and unpacked only where they aren't there and OK."""
    source = names_of(source)
    folder = os.path.abspath(folder)
    os.makedirs(folder, exist_ok=True)
    purge(folder, purge_level, source)
    also = source.also if isinstance(source.also, list) else []
    wanted = [n for n in [source.target, *also] if n]

    def ok(names: list[str]) -> bool:
        return bool(names) and all(r["result"] == "OK" for r in check(folder, names, quick))

    for pool in input_paths:
        for name in [*wanted, *([source.archive] if source.archive else [])]:
            there, here = os.path.join(pool, name), os.path.join(folder, name)
            if os.path.isfile(there) and (overwrite or not os.path.exists(here)) and (name not in _local_manifest(pool) or check(pool, [name], quick)[0]["result"] == "OK"):
                download.link_or_copy(there, here)
                record(folder, [name], algorithm)

    fetched, files = False, []
    if not overwrite and ok(wanted):
        files = [os.path.join(folder, n) for n in wanted]
    elif source.archive or (source.url and not source.target):
        archive = os.path.join(folder, source.archive)
        if overwrite or not (os.path.exists(archive) and check(folder, [source.archive], quick)[0]["result"] != "FAIL"):
            if not source.url:
                raise FileNotFoundError(archive)
            archive = archives.with_extension(download.fetch(source.url, folder, source.archive, own))
            fetched = True
            _verify(folder, os.path.basename(archive), source, quick)
            record(folder, [os.path.basename(archive)], algorithm)
        files = archives.extract_nested(archive, folder, _needed(source, archive))
    elif source.url:
        path = os.path.join(folder, source.target)
        if overwrite or check(folder, [source.target], quick)[0]["result"] != "OK":
            if not (os.path.exists(path) and source.target not in _local_manifest(folder)) or overwrite:
                path = download.fetch(source.url, folder, source.target, own)
                fetched = True
        _verify(folder, source.target, source, quick)
        files = [path]
    else:
        files = [os.path.join(folder, n) for n in wanted]
        if absent := [f for f in files if not os.path.exists(f)]:
            raise FileNotFoundError(absent[0])
    names = [os.path.relpath(f, folder) for f in files]
    record(folder, names, algorithm)
    target = next((f for f in files if source.target and os.path.basename(f) == os.path.basename(source.target)), None)
    if source.target and target is None:
        raise FileNotFoundError(f"{source.target} is not among {names}")
    return Ingested(files, target or (readers.choose(files)[0] if any(readers.extension_of(f) in readers.READERS for f in files) else files[-1]), fetched, check(folder, names, True))


def _verify(folder: str, name: str, source: Source, quick: bool) -> None:
    """A file that was just fetched must have the checksum that the source, or the manifest, gives it."""
    path = os.path.join(folder, name)
    if name in source.checksum and digest.file_hash(path, "sha256") != source.checksum[name]:
        os.remove(path)
        raise ValueError(f"{name} does not have the expected checksum; the file was removed")
    if name in _local_manifest(folder) and check(folder, [name], quick)[0]["result"] == "FAIL":
        raise ValueError(f"{name} differs from the manifest; purge its row if the new file is right")


def _load(spark, reader: Callable, path: str, options: dict):
    return reader(spark, path, **options)


def ingest(spark, source: Source, folder: str, reader: Callable | None | bool = None, to=None, store=None, options: dict | None = None, conform_settings: dict | None = None, **settings):
    """Acquire, load, and conform where a target is given.

    ``reader``: a function (spark, path) of your own; False returns the path. ``store``: loading is memoised by the
    files' content.
    """
    got = acquire(source, folder, **settings)
    if reader is False:
        return got.target
    call = reader or readers.choose([got.target] if readers.extension_of(got.target) in readers.READERS else got.files)[1]
    if store is not None:
        from cairnflow.plans.memo import memo

        checksums = {os.path.basename(f): digest.file_hash(f) for f in got.files if os.path.isfile(f)}
        loaded = memo(_load, spark, call, got.target, options or {}, store=store, omit=("spark", "path"), function_name="ingest", extra=checksums).value
    else:
        loaded = call(spark, got.target, **(options or {}))
    if to is not None or conform_settings:
        from cairnflow.operators.conform import conform

        loaded = conform(loaded, to, **(conform_settings or {}))
    return loaded
