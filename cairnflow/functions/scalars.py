"""Scalar functions as columns, and their counterparts for plain values where the driver needs them."""

from __future__ import annotations

import os
import random
import re
import string
import time

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def padded_number(x: Column | str, left: int, right: int = 3, pad: str = "0") -> Column:
    """Whole part padded to ``left`` characters; decimals (at least ``right``) only where there is a fraction."""
    c = _c(x).cast("double")
    fraction = F.abs(c - F.bround(c, 0)) > 1e-9
    text = F.bround(c, 9).cast("decimal(28,9)").cast("string")
    whole, decimals = F.split_part(text, F.lit("."), F.lit(1)), F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", "")
    longest = F.greatest(F.length(whole), F.lit(left))
    shown = F.lpad(whole, longest, pad)
    return F.when(fraction, F.concat(shown, F.lit("."), F.rpad(decimals, F.greatest(F.length(decimals), F.lit(right)), "0"))).otherwise(shown)


def with_prefix(name: Column | str, prefix: str) -> Column:
    """``prefix`` before the last path component."""
    c = _c(name)
    return F.concat(F.regexp_extract(c, "^(.*/)?[^/]*$", 1), F.lit(prefix), F.regexp_extract(c, "([^/]*)$", 1))


def with_suffix(name: Column | str, suffix: str) -> Column:
    """``suffix`` before the extension."""
    c = _c(name)
    return F.concat(without_extension(c), F.lit(suffix), F.regexp_extract(c, "([.][A-Za-z0-9]+)?$", 1))


def extension(name: Column | str) -> Column:
    """What follows the last dot, if it is letters and digits; else empty."""
    return F.regexp_extract(_c(name), "[.]([A-Za-z0-9]+)$", 1)


def without_extension(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), "[.][A-Za-z0-9]+$", "")


def last_component(name: Column | str) -> Column:
    """Last path component; null for null."""
    return F.element_at(F.split(_c(name), "/"), -1)


def last_components(name: Column | str, n_parents: int) -> Column:
    """The last component with ``n_parents`` directories above it, or what there is."""
    parts = F.split(_c(name), "/")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n_parents, F.lit(1)), F.lit(n_parents + 1)), "/")


def is_directory_name(name: Column | str) -> Column:
    return _c(name).endswith("/")


def is_absolute(name: Column | str) -> Column:
    return _c(name).rlike("^(/|[A-Za-z]:|~)")


def equal_or_both_null(a: Column | str, b: Column | str) -> Column:
    return _c(a).eqNullSafe(_c(b))


def escape_regex(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), r"([.\\|()\[\]{}^$*+?])", r"\\$1")


def round_fraction(c: Column | str, digits: int = 6) -> Column:
    """Rounded, half to even."""
    return F.bround(_c(c), digits)


def milliseconds(c: Column | str) -> Column:
    return F.unix_millis(_c(c))


def next_free_name(names: Column | str, stem: str) -> Column:
    """Aggregate: ``stem_N`` with the smallest N above all that occur among ``names``; the stem itself if it is free."""
    c = _c(names)
    number = F.when(c == stem, F.lit(0)).otherwise(F.nullif(F.regexp_extract(c, f"^{re.escape(stem)}_([0-9]+)$", 1), F.lit("")).cast("int"))
    top = F.max(number)
    return F.when(top.isNull(), F.lit(stem)).otherwise(F.concat(F.lit(f"{stem}_"), (top + 1).cast("string")))


def without_number(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), "_[0-9]+$", "")


# Plain values


def random_string(n: int = 1, length: int = 8) -> list[str]:
    return ["".join(random.choices(string.ascii_letters + string.digits, k=length)) for _ in range(n)]


def seed_from_clock() -> int:
    seed = time.time_ns() // 1000 % (1 << 31)
    random.seed(seed)
    return seed


def normal_path(path: str | None) -> str | None:
    """Absolute, with forward slashes, without a trailing one; null stays null."""
    if path is None:
        return None
    return os.path.abspath(os.path.expanduser(path)).replace("\\", "/")


def checked_path(path: str, create: bool = False) -> str:
    """The normal path; made if ``create``, else it must exist."""
    if not path:
        raise ValueError("a path must not be empty")
    found = normal_path(path)
    if os.path.isfile(found):
        return found
    if not os.path.isdir(found):
        if not create:
            raise FileNotFoundError(found)
        os.makedirs(found, exist_ok=True)
    return found


def absolute_path(path: str, base: str) -> str:
    return path if os.path.isabs(path) else os.path.join(base, path)


def relative_path(path: str, base: str) -> str:
    """``path`` below the last component that it shares with ``base``; the path itself if there is none."""
    parts, shared = path.strip("/").split("/"), base.strip("/").split("/")
    at = max((k for k, p in enumerate(parts) if p in shared), default=-1)
    return "/".join(parts[at + 1 :]) if at >= 0 else path


def relative_to_roots(path: str, roots: dict[str, str]) -> tuple[str | None, str]:
    """(name of the longest root that the path lies in, rest); (None, path) if it lies in none."""
    path = normal_path(path)
    inside = [(name, normal_path(root)) for name, root in roots.items() if path == normal_path(root) or path.startswith(normal_path(root) + "/")]
    if not inside:
        return None, path
    name, root = max(inside, key=lambda x: len(x[1]))
    return name, path[len(root) :].lstrip("/")
