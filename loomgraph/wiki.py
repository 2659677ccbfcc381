"""Writing wiki pages: plain markdown files in one folder, with an append-only log."""

from __future__ import annotations

import re
from datetime import UTC, datetime
from pathlib import Path

from loomgraph.functions.text import BLANKS

INDEX_TEXT = (
    "# Wiki Index\n\nDecisions, pitfalls and other knowledge that the code itself does not show."
    "\n\n## Pages\n\n*No pages yet.*\n"
)
LOG_TEXT = "# Wiki Log\n\nEvery wiki operation, oldest first.\n\n---\n"


def page_name(name: str) -> str:
    """File name of a page; the same rule as `functions.text.page_file_name`."""
    dashed = re.sub(f"[{re.escape(BLANKS)}]+", "-", name.lower())
    return re.sub("[^a-z0-9-]", "", dashed) + ".md"


def init_wiki(folder: str) -> str:
    """Create the folder, its index and its log where missing."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    for name, text in (("index.md", INDEX_TEXT), ("log.md", LOG_TEXT)):
        if not (root / name).exists():
            (root / name).write_text(text, encoding="utf-8")
    return folder


def write_page(folder: str, name: str, content: str) -> bool:
    """Write a page, log it if there is a log, and tell whether the page is new."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    page = root / page_name(name)
    created = not page.exists()
    page.write_text(content, encoding="utf-8")
    log = root / "log.md"
    if log.exists():
        day = datetime.now(UTC).date().isoformat()
        with log.open("a", encoding="utf-8") as handle:
            handle.write(f"- **{day}**: {'created' if created else 'updated'} `{page.name}`\n")
    return created
