"""Registered feeds."""

from .base import Source
from .epss import EPSS
from .github import GITHUB
from .kev import KEV
from .nvd import NVD
from .osv import OSV, OSV_FILES

#: name -> feed; ``register`` adds to them.
SOURCES = {s.name: s for s in (NVD, GITHUB, OSV, EPSS, KEV)}


def register(source: Source) -> None:
    """Make a feed known to syncs: it is due, ordered and logged like the others."""
    SOURCES[source.name] = source


__all__ = ["SOURCES", "register", "NVD", "GITHUB", "OSV", "OSV_FILES", "EPSS", "KEV"]
