"""Ids given in rounds against the serial rule."""

import random
import re

from florilege.operators import inference as I


def serial_id(path, taken):
    slug = lambda s: re.sub("[^a-z0-9]+", "-", re.sub(r"^\d{1,4}[-_]", "", re.sub(r"\.(md|mdx)$", "", s.lower()))).strip("-")
    *folders, name = map(slug, path.split("/"))
    folders.reverse()
    parent = folders[0] if folders else ""
    made = "-".join(x for x in (parent, name) if x) if name in ("", "readme", "index") else name
    made = made or "doc"
    for folder in filter(None, folders):
        if made not in taken:
            return made
        made = f"{folder}-{made}"
    if made not in taken:
        return made
    return next(f"{made}-{n}" for n in range(2, len(taken) + 3) if f"{made}-{n}" not in taken)


def serial(paths, taken):
    used, out = set(taken), {}
    for p in sorted(set(paths)):
        out[p] = serial_id(p, used)
        used.add(out[p])
    return out


def given(spark, paths, taken):
    docs = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path: r.id for r in I.infer_ids(docs, spark.createDataFrame([(t,) for t in taken], "id string")).collect()}


def test_rounds_give_the_serial_ids(spark):
    rng = random.Random(5)
    names = ["readme.md", "index.mdx", "世界.md", "a b.md", "a-b.md", "A_b.mdx", "0012-a-b.md", "doc-2.md", "doc-4.md", "x.md", "x-2.md", "12_x.md", "---.md"]
    folders = ["docs", "Docs", "世", "a b", "x", "doc", "01-x", "x-x"]
    paths = {"/".join([*rng.choices(folders, k=rng.randrange(4)), rng.choice(names)]) for _ in range(400)}
    taken = ["doc", "doc-3", "doc-5", "doc-6", "x", "x-x", "x-x-2", "a-b-2", "docs-readme", "doc-02", "doc-1"]
    assert given(spark, paths, taken) == serial(paths, taken)


def test_many_documents_of_one_id_end_in_few_rounds(spark, monkeypatch):
    rounds, own = [], I.stored
    monkeypatch.setattr(I, "stored", lambda df: rounds.append(1) or own(df))
    paths = [f"{chr(0x4E00 + i)}.md" for i in range(3000)]
    taken = ["doc"] + [f"doc-{n}" for n in range(2, 1500)]
    assert given(spark, paths, taken) == serial(paths, taken)
    assert len(rounds) < 20


def test_odd_tables(spark):
    assert given(spark, [], ["x"]) == {}
    assert given(spark, [None, "x.md", "x.md"], [None]) == {"x.md": "x"}
