import json
import os
import subprocess

import pytest

from loomgraph import render
from loomgraph.config import EmbeddingConfig, GraphConfig, RepoConfig, load_config, repo_configs
from loomgraph.engine import Workspace
from loomgraph.store import NotBuilt
from loomgraph.streaming.watch import change_events, watch

OFFLINE = EmbeddingConfig("offline", "char-bins")


def write(root, path, text):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(text)


def workspace(spark, root, store, repo_id="a", **graph):
    (root / "notes").mkdir(parents=True, exist_ok=True)
    repo = RepoConfig(
        repo_id, str(root), str(root / "notes"), ["**/*.ts"], ["docs/*.md", ".x/*.md"],
        ["node_modules"], GraphConfig(semantic_min_score=0.5, **graph),
    )
    return Workspace(spark, repo, OFFLINE, str(store))


def count(space, source="code", path=None):
    rows = space.store.live_chunks(space.repo.repo_id, source)
    return (rows if path is None else rows.where(rows.file_path == path)).count()


def test_index_life_cycle(spark, tmp_path):
    root, store = tmp_path / "a", tmp_path / "store"
    write(root, "alpha.ts", "export function alpha() { return 'alpha'; }\n")
    write(root, "_beta.ts", "export const beta = 42;\nexport function useBeta() { return beta; }\n")
    write(root, "node_modules/x.ts", "export const skipped = 1\n")
    space = workspace(spark, root, store)
    n = space.index("code")
    assert n == 2 == count(space) and count(space, path="_beta.ts") == 1
    assert space.index("code") == 0 and count(space) == n

    write(root, "alpha.ts", "export function alpha() { return 'ALPHA-v2'; }\n")
    assert space.index("code") == 1
    texts = {h["file"]: h["chunk_text"] for h in space.search_code("alpha", 20).collect()}
    assert "ALPHA-v2" in texts["alpha.ts"] and set(texts) == {"alpha.ts", "_beta.ts"}

    os.remove(root / "_beta.ts")
    write(root, "sub/gamma.ts", "export function gamma() { return 'gamma'; }\n")
    assert space.index("code") == 1
    assert count(space, path="_beta.ts") == 0 and count(space, path="alpha.ts") == 1
    hits = space.search_code("function", 20, "sub/**")
    assert [h["file"] for h in hits.collect()] == ["sub/gamma.ts"]
    assert render.code_hits(hits).startswith("(1) sub/gamma.ts defines gamma [")

    space.delete_file("code", "sub/gamma.ts")
    assert count(space, path="sub/gamma.ts") == 0 and count(space, path="alpha.ts") == 1
    assert space.index("code") == 1 and count(space, path="sub/gamma.ts") == 1

    other_root = tmp_path / "b"
    write(root, "shared.ts", "export const fromA = 'AAA';\n")
    write(other_root, "shared.ts", "export const fromB = 'BBB';\n")
    other = workspace(spark, other_root, store, "b")
    assert space.index("code") == 1 and other.index("code") == 1
    for one, text in ((space, "AAA"), (other, "BBB")):
        found = [h["chunk_text"] for h in one.search_code("shared", 20).collect()
                 if h["file"] == "shared.ts"]
        assert len(found) == 1 and text in found[0]
    os.remove(other_root / "shared.ts")
    assert other.index("code") == 0
    assert count(other) == 0 and count(space, path="shared.ts") == 1
    with pytest.raises(ValueError):
        space.search_code("x", 21)


def test_build_and_questions(spark, tmp_path):
    root = tmp_path / "p"
    body = "export function widget() { return total(); }\nfunction total() { return 42; }\n"
    write(root, "base2.ts", "export function shared() { return 1; }\nexport interface Shape {}\n")
    write(root, "user2.ts", "import { shared, Shape } from './base2';\n"
          "export function useShared(s: Shape) { return shared(); }\n")
    write(root, "simA.ts", body)
    write(root, "simB.ts", body)
    write(root, "docs/guide.md", "intro\n## Setup\nrun it\n")
    write(root, ".x/rules.md", "## Rule\nbe kind\n")
    write(root, "notes/n.md", "---\nname: n\ntype: feedback\n---\nkeep it small\n")
    write(root, "notes/MEMORY.md", "index")

    def git(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args],
                       check=True, capture_output=True)

    git("init", "-q")
    for i in range(3):
        write(root, "simA.ts", body + f"// {i}\n")
        write(root, "simB.ts", body + f"// {i}\n")
        git("add", "simA.ts", "simB.ts")
        git("commit", "-q", "-m", str(i))

    space = workspace(spark, root, tmp_path / "store")
    with pytest.raises(NotBuilt):
        space.query_co_changes("simA.ts").collect()
    report = space.build()
    assert report["code chunks"] == 4 and report["docs chunks"] == 3
    assert report["memory chunks"] == 1 and report["wiki chunks"] == 3
    assert report["import_edges"] == 1 and report["co_changes"] == 1
    assert space.symbol_counts() == {"nodes": 7, "edges": 4, "semantic": report["semantic_edges"]}

    shown = render.dependencies(space.query_dependencies("base2.ts")).splitlines()
    assert [line.split() for line in shown[1:]] == [["importedBy", "1", "user2.ts", "shared", "Shape"]]
    shown = render.co_changes(space.query_co_changes("simA.ts")).splitlines()
    assert shown[1].split() == ["3", "simB.ts"]
    shown = render.type_consumers(space.query_type_consumers("Shape")).splitlines()
    assert ["defined", "base2.ts", "interface", "-"] in [line.split() for line in shown]
    assert ["consumed", "-", "-", "user2.ts"] in [line.split() for line in shown]
    caller = space.query_symbol("user2.ts::useShared")
    assert [r["id"] for r in caller["matches"].collect()] == ["user2.ts::useShared"]
    shown = [line.split() for line in render.symbol(caller).splitlines()]
    at = shown.index(["[outgoing]"])
    assert shown[at + 2 : at + 4] == [["calls", "base2.ts::shared"], ["uses", "type", "base2.ts::Shape"]]
    callee = space.query_symbol("shared")
    assert ("calls", "user2.ts::useShared") in {
        (r["kind"], r["id"]) for r in callee["incoming"].collect()}
    assert render.symbol(space.query_symbol("nobody")).count("(no rows)") == 4
    near = space.query_symbol("simA.ts::widget")["neighbors"].collect()
    assert "simB.ts::widget" in [r["id"] for r in near]
    assert all(0 < r["score"] <= 1 for r in near)

    assert "guide.md # Setup [" in render.section_hits(space.search_docs("run", 10))
    assert "feedback : n [" in render.note_hits(space.search_memory("small", 3, "feedback"))
    assert space.search_memory("small", 3, "user").count() == 0

    plan = space.partition([{"issue": 2, "files": ["simB.ts"]}, {"issue": 1, "files": ["simA.ts"]}])
    shown = [line.split() for line in render.partition(plan).splitlines()]
    assert ["0", "2", "1", "2"] in shown and ["(no", "rows)"] in shown
    assert ["1", "simA.ts", "simB.ts", "3"] in shown
    many = render.table(spark.range(60).orderBy("id"), {"n": "id"}, 3)
    assert many.splitlines() == ["n", "0", "1", "2", "(57 more rows)"]
    assert len(plan["head_sha"]) == 40

    page = "# T\n\n**Summary**: short\n\n**Last updated**: 2024-01-15\n\n[[ b ]] [[a]] [[b]]\n"
    assert space.write_wiki_page("My Page", page) is True
    assert space.write_wiki_page("my page", page) is False
    read = space.read_wiki_page("MY PAGE").first()
    assert (read["summary"], read["related_pages"]) == ("short", ["b", "a"])
    assert space.read_wiki_page("none").count() == 0
    shown = [line.split() for line in render.wiki_pages(space.list_wiki_pages()).splitlines()]
    assert ["my-page", "2024-01-15", "short"] in shown
    log = (root / ".loomgraph/wiki/log.md").read_text()
    assert log.count("created `my-page.md`") == 1 and log.count("updated `my-page.md`") == 1
    assert "my-page.md" in {h["file"] for h in space.search_wiki("short", 10).collect()}
    space.register_views()
    assert spark.sql("SELECT count(*) FROM symbol_nodes").first()[0] == 7


def test_change_events_reindex(spark, tmp_path):
    root = tmp_path / "w"
    write(root, "a.ts", "export const a = 1\n")
    write(root, "b.ts", "export const b = 1\n")
    space = workspace(spark, root, tmp_path / "store", symbols_enabled=False)
    space.index("code")
    os.remove(root / "a.ts")
    write(root, "c.ts", "import { b } from './b'\nexport const c = b\n")
    events = tmp_path / "events"
    events.mkdir()
    rows = [
        {"source": "code", "file_path": "a.ts", "op": "unlink", "ts": "2024-01-01T00:00:00Z"},
        {"source": "code", "file_path": "c.ts", "op": "add", "ts": "2024-01-01T00:00:01Z"},
        {"source": "other", "file_path": "x", "op": "add", "ts": "2024-01-01T00:00:01Z"},
    ]
    (events / "1.json").write_text("\n".join(map(json.dumps, rows)))
    query = watch(space, change_events(spark, str(events)), str(tmp_path / "ckpt"), availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    live = space.store.live_chunks("a", "code").select("file_path").collect()
    assert {r[0] for r in live} == {"b.ts", "c.ts"}
    assert space.query_dependencies("c.ts").first()["file"] == "b.ts"


def test_settings(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.delenv("REPO_ID", raising=False)
    monkeypatch.setenv("PROJECT_ROOT", "/from/env")
    with pytest.raises(FileNotFoundError):
        load_config(package_dir=str(tmp_path))
    raw = {"embedding": {"type": "offline", "model": "m"}, "name": "n", "projectRoot": "/p",
           "graph": {"semantic": {"topK": 2}}, "skipPatterns": ["s"]}
    (tmp_path / "loomgraph.json").write_text(json.dumps(raw))
    repo = repo_configs(load_config())["n"]
    assert repo.project_root == "/from/env" and repo.skip_parts == ["s"]
    assert (repo.graph.semantic_top_k, repo.graph.semantic_min_score) == (2, 0.78)
    both = repo_configs({**raw, "repos": [
        {"repoId": "x", "projectRoot": "/x", "skipPatterns": []}, {"repoId": "y", "projectRoot": "/y"},
    ]})
    assert both["x"].skip_parts == [] and both["y"].skip_parts == ["s"]
    assert both["y"].memory_dir.endswith("/projects/-y/memory")
    for repos in ([{"repoId": "x"}], [{"repoId": "x", "projectRoot": "/"}] * 2):
        with pytest.raises(ValueError):
            repo_configs({**raw, "repos": repos})
