"""Settings: which repositories to index, with which patterns, embedder and thresholds."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

# Defaults.
DEFAULT_CODE_GLOBS = ["**/*.{ts,tsx,js,jsx}"]
DEFAULT_DOC_GLOBS = ["docs/*.md", "CLAUDE.md", ".claude/rules/*.md"]
DEFAULT_SKIP_PARTS = [
    "node_modules", ".next", "/dist/", "/build/", ".bundle.", ".min.", "__tests__", "__mocks__",
]
STATE_FOLDER = ".loomgraph"


@dataclass(frozen=True)
class EmbeddingConfig:
    type: str
    model: str
    api_key: str | None = None
    base_url: str | None = None


@dataclass(frozen=True)
class GraphConfig:
    co_change_min_count: int = 3
    co_change_max_commits: int | None = None
    symbols_enabled: bool = True
    semantic_min_score: float = 0.78
    semantic_top_k: int = 5


@dataclass(frozen=True)
class RepoConfig:
    repo_id: str
    project_root: str
    memory_dir: str
    code_globs: list[str] = field(default_factory=lambda: list(DEFAULT_CODE_GLOBS))
    doc_globs: list[str] = field(default_factory=lambda: list(DEFAULT_DOC_GLOBS))
    skip_parts: list[str] = field(default_factory=lambda: list(DEFAULT_SKIP_PARTS))
    graph: GraphConfig = GraphConfig()
    wiki_auto_init: bool = True

    @property
    def state_dir(self) -> str:
        return os.path.join(self.project_root, STATE_FOLDER)

    @property
    def wiki_dir(self) -> str:
        return os.path.join(self.state_dir, "wiki")


def default_memory_dir(root: str) -> str:
    """Fixed format: the note folder kept per project under the user's home."""
    home = os.environ.get("HOME", "~")
    return os.path.join(home, ".claude", "projects", root.replace("/", "-"), "memory")


def load_config(path: str | None = None, package_dir: str | None = None) -> dict:
    """The first configuration file that exists, as a dict."""
    here = package_dir or str(Path(__file__).resolve().parent.parent)
    tried = [
        path,
        os.path.join(os.getcwd(), "loomgraph.json"),
        os.path.join(os.getcwd(), STATE_FOLDER, "config.json"),
        os.path.join(here, "config.json"),
    ]
    for name in filter(None, tried):
        if os.path.exists(name):
            return json.loads(Path(name).read_text(encoding="utf-8"))
    raise FileNotFoundError("no loomgraph.json or config.json found")


def embedding_config(raw: dict) -> EmbeddingConfig:
    given = raw["embedding"]
    return EmbeddingConfig(
        given["type"], given["model"], given.get("apiKey"), given.get("baseUrl")
    )


def _graph_config(raw: dict | None) -> GraphConfig:
    raw = raw or {}
    base = GraphConfig()
    symbols, semantic = raw.get("symbols") or {}, raw.get("semantic") or {}
    return GraphConfig(
        raw.get("coChangeMinCount", base.co_change_min_count),
        raw.get("coChangeMaxCommits", base.co_change_max_commits),
        symbols.get("enabled", base.symbols_enabled),
        semantic.get("minScore", base.semantic_min_score),
        semantic.get("topK", base.semantic_top_k),
    )


def repo_configs(raw: dict) -> dict[str, RepoConfig]:
    """Every configured repository by id; entries fall back to the top-level settings."""
    single = {
        "repoId": raw.get("name") or os.environ.get("REPO_ID") or "default",
        "projectRoot": os.environ.get("PROJECT_ROOT") or raw.get("projectRoot") or os.getcwd(),
        "memoryDir": raw.get("memoryDir"),
    }
    found: dict[str, RepoConfig] = {}
    for entry in raw.get("repos") or [single]:
        repo_id, root = entry.get("repoId"), entry.get("projectRoot")
        if not repo_id or not root:
            missing = "repoId" if not repo_id else "projectRoot"
            raise ValueError(f"no {missing} in the settings of {repo_id or root or entry!r}")
        if repo_id in found:
            raise ValueError(f"two repositories are called {repo_id!r}: {found[repo_id].project_root} and {root}")

        def pick(key: str, default):
            return next((s[key] for s in (entry, raw) if s.get(key) is not None), default)

        wiki = [(s.get("wiki") or {}).get("autoInit") for s in (entry, raw)]
        found[repo_id] = RepoConfig(
            repo_id,
            root,
            entry.get("memoryDir") or default_memory_dir(root),
            pick("codePatterns", DEFAULT_CODE_GLOBS),
            pick("docPatterns", DEFAULT_DOC_GLOBS),
            pick("skipPatterns", DEFAULT_SKIP_PARTS),
            _graph_config(pick("graph", None)),
            next((w for w in wiki if w is not None), True),
        )
    return found


def select_repo(repos: dict[str, RepoConfig]) -> RepoConfig:
    """REPO_ID picks one of several; otherwise the first."""
    if not repos:
        raise ValueError("the settings name no tree to index")
    return repos.get(os.environ.get("REPO_ID", ""), next(iter(repos.values())))
