"""Which folders and files of a source tree the extractors read."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

FILES = "root string, root_ord int, path string, rel string, name string, content binary"

#: Folders that each extractor leaves out, and whether a root of that name is left out too.
SKIPS: dict[str, tuple[tuple[str, ...], bool]] = {
    "gomod": ((".git", ".claude", "node_modules", "vendor", "testdata"), True),
    "cargo": ((".git", ".claude", "node_modules", "vendor", "testdata", "target"), False),
    "wrangler": ((".git", ".claude", "node_modules", "vendor", "testdata", "target"), False),
    "capnp": ((".git", ".claude", "node_modules", "vendor", "testdata", "target"), False),
    "dockerfile": ((".git", "vendor", "node_modules", "testdata"), False),
    "gocode": (("vendor", "testdata", ".git"), True),
    "docs": ((".git", "node_modules"), True),
}
#: Names that each extractor reads; ci reads them in .github/workflows only.
READS: dict[str, str] = {
    "gomod": r"^go\.mod$",
    "cargo": r"^Cargo\.toml$",
    "wrangler": r"^wrangler\.toml$",
    "capnp": r"\.capnp$",
    "dockerfile": r"^(Dockerfile|Containerfile|Dockerfile\..*|.*\.Dockerfile)$",
    "gocode": r"\.go$|^go\.mod$",
    "docs": r"(?i)\.(md|markdown|html|htm)$",
    "ci": r"(?i)\.(yml|yaml)$",
}
#: Extractors that leave out every folder whose name begins with a dot.
HIDDEN = ("gocode", "docs")
WORKFLOWS = (".github", "workflows")


@dataclass(frozen=True)
class Pruning:
    """A walk's decisions. Extractors that enter a folder are handed down from its parent's."""

    extractors: tuple[str, ...] = tuple(READS)

    @staticmethod
    def _enters(extractor: str, folder: str, depth: int) -> bool:
        if extractor == "ci":
            return depth < len(WORKFLOWS) and folder == WORKFLOWS[depth]
        return folder not in SKIPS[extractor][0] and not (extractor in HIDDEN and folder.startswith("."))

    def start(self, root: str) -> tuple[str, ...]:
        """Extractors that enter a root of this name."""
        base = os.path.basename(root.rstrip("/"))
        return tuple(e for e in self.extractors if e == "ci" or not SKIPS[e][1] or base in (".", "") or self._enters(e, base, 0))

    def below(self, live: tuple[str, ...], folder: str, depth: int) -> tuple[str, ...]:
        """Those of `live` that enter the folder of this name, `depth` folders below the root."""
        return tuple(e for e in live if self._enters(e, folder, depth))

    def reads(self, live: tuple[str, ...], name: str, depth: int) -> bool:
        """Whether one of `live` reads a file of this name that lies `depth` folders below the root."""
        return any((e != "ci" or depth == len(WORKFLOWS)) and re.search(READS[e], name) for e in live)
