"""Progress messages, shown by level of detail, and the helpers around them."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable

log = logging.getLogger("cairnflow")


def say(text: str, verbose: int = 1, level: int = 1) -> None:
    if verbose >= level:
        log.info(text)


def table_text(rows: list[dict]) -> str:
    """Rows as aligned text."""
    if not rows:
        return ""
    names = list(rows[0])
    width = {n: max(len(n), *(len(str(r.get(n, ""))) for r in rows)) for n in names}
    return "\n".join(" ".join(str(v).ljust(width[n]) for n, v in zip(names, line)) for line in [names, *([r.get(n, "") for n in names] for r in rows)])


def retry(call: Callable, retries: int = 5, base: float = 1.3, between: Callable | None = None, timeout: float = 1200.0, wait: Callable[[float], None] = time.sleep):
    """The call's value, tried again up to ``retries`` times with growing random waits; ``between`` may mend something."""
    began = time.monotonic()
    for k in range(1, retries + 1):
        try:
            return call()
        except Exception:
            if k == retries or time.monotonic() - began > timeout:
                raise
            if between:
                between()
            wait(random.uniform(0.001, 1) * (base**k - 1))
    return None


class Timer:
    """Seconds by component."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def time(self, function: str, component: str):
        timer = self

        class Span:
            def __enter__(self):
                self.began = time.perf_counter()

            def __exit__(self, *_):
                timer.rows.append({"function": function, "component": component, "elapsed": round(time.perf_counter() - self.began, 6)})

        return Span()
