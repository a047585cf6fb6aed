"""Getting files from elsewhere: local files, http(s) and ftp, listings of folders, or a caller's own function."""

from __future__ import annotations

import os
import re
import shutil
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from cairnflow.messages import retry

#: Schemes that are refused, with the reason.
REFUSED = {"dropbox.com": "links to Dropbox pages", "onedrive.live.com": "links to OneDrive pages"}
#: Schemes handled by callers' functions: scheme -> function(url, path).
FETCHERS: dict[str, Callable[[str, str], None]] = {}


def register(scheme: str, fetch: Callable[[str, str], None]) -> None:
    """A function for more kinds of addresses, such as a cloud drive's."""
    FETCHERS[scheme] = fetch


def scheme_of(url: str) -> str:
    return urllib.parse.urlsplit(url).scheme or "file"


def file_name_of(url: str) -> str:
    return os.path.basename(urllib.parse.unquote(urllib.parse.urlsplit(url).path))


def exists(url: str, timeout: float = 5.0) -> bool:
    if scheme_of(url) == "file":
        return os.path.exists(urllib.parse.urlsplit(url).path or url)
    try:
        with urllib.request.urlopen(urllib.request.Request(url, method="HEAD"), timeout=timeout) as answer:
            return answer.status < 400
    except (urllib.error.URLError, OSError, ValueError):
        return False


def _fetch(url: str, path: str) -> None:
    scheme = scheme_of(url)
    if scheme in FETCHERS:
        FETCHERS[scheme](url, path)
    elif scheme == "file":
        source = urllib.parse.unquote(urllib.parse.urlsplit(url).path) if url.startswith("file:") else url
        link_or_copy(source, path)
    elif scheme in ("http", "https", "ftp"):
        with urllib.request.urlopen(url, timeout=60) as answer, open(path, "wb") as file:
            shutil.copyfileobj(answer, file)
            expected = answer.headers.get("Content-Length")
        if expected and os.path.getsize(path) < 0.2 * int(expected):
            raise OSError(f"{url}: got {os.path.getsize(path)} of {expected} bytes")
    else:
        raise ValueError(f"no way to fetch {scheme} addresses; register one")


def fetch(url: str, folder: str, name: str | None = None, own: Callable[[str, str], str | None] | None = None, tries: int = 2) -> str:
    """Fetch to ``folder``; returns the file's path. ``own(url, path)`` replaces the built-in ways."""
    for host, what in REFUSED.items():
        if host in urllib.parse.urlsplit(url).netloc:
            raise ValueError(f"{what} give no files; use a direct link or a function of your own")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name or file_name_of(url) or "download")
    part = f"{path}.part"

    def once() -> str:
        made = own(url, part) if own else _fetch(url, part)
        if made and made != part:
            return made
        os.replace(part, path)
        return path

    return retry(once, retries=tries)


def listing(url: str, pattern: str | None = None) -> list[str]:
    """Files that a folder address (with a trailing slash) links to."""
    if scheme_of(url) == "file":
        folder = urllib.parse.urlsplit(url).path or url
        names = sorted(f for f in os.listdir(folder) if os.path.isfile(os.path.join(folder, f)))
        found = [os.path.join(folder, n) for n in names]
    else:
        with urllib.request.urlopen(url, timeout=60) as answer:
            text = answer.read().decode("utf-8", "replace")
        found = [urllib.parse.urljoin(url, h) for h in re.findall(r'href="([^"?#]+)"', text) if not h.endswith("/")]
    return [f for f in found if pattern is None or re.search(pattern, os.path.basename(f))]


def link_or_copy(source: str, target: str, symlinks: bool = False) -> str:
    """Hard link, else a symbolic link (if allowed), else a copy. Returns which."""
    os.makedirs(os.path.dirname(os.path.abspath(target)), exist_ok=True)
    if os.path.lexists(target):
        if os.path.exists(target) and os.path.samefile(source, target):
            return "same"
        os.remove(target)
    try:
        os.link(source, target)
        return "hard link"
    except OSError:
        pass
    if symlinks:
        try:
            os.symlink(os.path.abspath(source), target)
            return "symbolic link"
        except OSError:
            pass
    shutil.copy2(source, target)
    return "copy"


def move(source: str, target: str, overwrite: bool = False) -> bool:
    if os.path.exists(target) and not overwrite:
        return False
    shutil.move(source, target)
    return True
