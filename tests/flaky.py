"""A site that is busy at every window's first request, and notes when it was asked what."""

from __future__ import annotations

import os
import time
import uuid

from millrace.sources.connectors import Busy
from millrace.sources.paged import ask_folder


def ask(site: str, window: int | None, token: str | None):
    notes = f"{site}/asked"
    os.makedirs(notes, exist_ok=True)
    first = not any(n.startswith(f"{window}-") for n in os.listdir(notes))
    open(f"{notes}/{window}-{token}-{time.time()}-{uuid.uuid4().hex}", "w").close()
    if first:
        raise Busy(429, 0.05)
    return ask_folder(site, window, token, size=7)
