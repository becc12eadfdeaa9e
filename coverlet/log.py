"""Messages of a run, on the driver's standard error."""

from __future__ import annotations

import logging

LOG = logging.getLogger("coverlet")


def verbose(on: bool = True) -> None:
    """Show messages with the time of day, or only errors."""
    if not LOG.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("[%(asctime)s] %(levelname)s %(message)s", "%H:%M:%S"))
        LOG.addHandler(handler)
        LOG.propagate = False
    LOG.setLevel(logging.INFO if on else logging.ERROR)
