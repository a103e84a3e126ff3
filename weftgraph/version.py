"""Version strings: tag, or tag-commits-hash of a checkout; release and its name."""

from __future__ import annotations

import os
import subprocess
from functools import lru_cache

from weftgraph import __version__

#: Release -> name.
RELEASES = {"0.1.0": "warp", "0.2.0": "blocks", "0.3.0": "runs"}


@lru_cache(maxsize=1)
def version() -> str:
    """The release, with a checkout's commit behind it: ``0.3.0-g1a2b3c4``."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(os.path.join(root, ".git")):
        return __version__
    try:
        got = subprocess.run(["git", "-C", root, "rev-parse", "--short", "HEAD"], capture_output=True, text=True, timeout=10, check=True)
    except (OSError, subprocess.SubprocessError):
        return __version__
    return f"{__version__}-g{got.stdout.strip()}"


def release(text: str | None = None) -> str:
    """What stands before the first dash."""
    return (version() if text is None else text).split("-", 1)[0]


def codename(text: str | None = None) -> str:
    """The name of the release, empty if it has none."""
    return RELEASES.get(release(text), "")


def short(text: str | None = None) -> str:
    """The version with the release's name in quotes."""
    v = version() if text is None else text
    name = codename(v)
    return f'{v} "{name}"' if name else v
