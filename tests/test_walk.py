"""The walk in rounds of tasks, and the files it finds."""

import os

from florilege.dims import Config
from florilege.sources import files as FS


def _tree(root):
    made = {
        "a.md": b"# A\n",
        "docs/b.md": b"# B\n",
        "docs/deep/er/c.mdx": b"# C\n",
        "docs/deep/er/skip.txt": b"x",
        "docs/deep/CHANGELOG.md": b"# no\n",
        "node_modules/x/d.md": b"# D\n",
        "src/vendor/e.md": b"# E\n",
        "src/build/out/f.md": b"# F\n",
        "src/zero.md": b"a\0b",
        "src/big.md": b"x" * (FS.MOST_BYTES + 1),
        "src/edge.md": b"x" * FS.MOST_BYTES,
        "src/empty.md": b"",
    }
    for i in range(150):
        made[f"many/f{i}/g.md"] = b"g"
    for path, content in made.items():
        full = root / path
        full.parent.mkdir(parents=True, exist_ok=True)
        full.write_bytes(content)
    os.symlink(root / "docs", root / "linked")
    os.symlink(root / "a.md", root / "alias.md")


def test_walk_finds_what_the_listing_finds_and_opens_no_excluded_folder(spark, tmp_path):
    root, log = tmp_path / "root", str(tmp_path / "opened")
    root.mkdir()
    _tree(root)

    def scan(folder):
        with open(log, "a") as f:
            f.write(os.path.relpath(folder, str(root)) + "\n")
        return os.scandir(folder)

    found = sorted(r.path for r in FS.walk(spark, str(root), scan=scan).collect())
    assert found == FS.listing(str(root))
    assert {"a.md", "docs/b.md", "docs/deep/er/c.mdx", "many/f149/g.md"} <= set(found)
    opened = open(log).read().split()
    assert len(opened) == len(set(opened))
    assert not [p for p in opened if p.split("/")[0] in ("node_modules", "linked") or "vendor" in p or "build" in p]
    assert {"docs", "docs/deep", "docs/deep/er", "many/f77"} <= set(opened)


def test_files_are_read_by_tasks(spark, tmp_path):
    _tree(tmp_path)
    docs = {r.path: r.raw for r in FS.read(spark, str(tmp_path)).select("path", "raw").collect()}
    assert docs["a.md"] == "# A\n" and docs["src/empty.md"] == "" and len(docs["src/edge.md"]) == FS.MOST_BYTES
    assert not {"src/zero.md", "src/big.md", "alias.md"} & set(docs)


def test_narrow_patterns_and_an_empty_root(spark, tmp_path):
    config = Config(include=("docs/**/*.md",), exclude=("docs/deep/**",))
    root = tmp_path / "full"
    root.mkdir()
    _tree(root)
    assert [r.path for r in FS.walk(spark, str(root), config).collect()] == FS.listing(str(root), config) == ["docs/b.md"]
    (tmp_path / "none").mkdir()
    assert FS.read(spark, str(tmp_path / "none")).count() == 0
    assert FS.walk(spark, str(tmp_path / "missing")).count() == 0


def test_plain_claims_are_looked_up_on_disk(spark, tmp_path):
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib/a.ts").write_text("")
    globs = spark.createDataFrame([("lib",), ("./lib//a.ts",), ("lib/a.ts",), ("lib/b.ts",), ("lib/*.ts",), ("lib/{a,b}.ts",), (None,)], "glob string")
    assert sorted(r.path for r in FS.present(globs, str(tmp_path)).collect()) == ["lib", "lib/a.ts"]
    assert FS.present(globs.limit(0), str(tmp_path)).collect() == []
