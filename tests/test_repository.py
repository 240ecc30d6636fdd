"""Commands on real repositories with set dates, verdict ladders and packs."""

import os
import subprocess
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from florilege import commands as CMD
from florilege import tools as TL
from florilege.dims import Config
from florilege.operators import freshness as FR
from florilege.operators import ranking as R
from florilege.operators import relocation as RL
from florilege.sources import config as CF
from florilege.sources import files as FS
from florilege.sources import gitlog as GL
from florilege.sources import history as H
from florilege.sources.cache import Cache
from florilege.streaming import feed

NOW = datetime(2025, 7, 1)


def git(root, *args, days=0):
    at = (NOW - timedelta(days=days)).strftime("%Y-%m-%dT12:00:00Z")
    env = os.environ | {"GIT_AUTHOR_DATE": at, "GIT_COMMITTER_DATE": at, "GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@b", "GIT_COMMITTER_NAME": "a", "GIT_COMMITTER_EMAIL": "a@b", "HOME": str(root)}
    subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env)


def put(root, files, days=None, message="m"):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    if days is not None:
        git(root, "add", "-A")
        git(root, "commit", "-qm", message, days=days)


def doc(head, body="# Title\n\nText of it.\n"):
    return f"---\nspec: 1\n{head}\n---\n{body}"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git(root, "init", "-q")
    put(root, {f"src/auth/{n}.ts": f"export const {n} = {'1 + ' * 30}1;\n" for n in "abcd"} | {"docs/stale.md": doc("id: stale\ndescribes: [src/auth/**]"), "src/old/x.ts": "let x\n" * 9, "src/old/y.ts": "let y\n" * 9, "docs/old.md": doc("id: old\ndescribes: [src/old/**]\nverify: exit 3")}, 120)
    put(root, {"src/auth/a.ts": "changed\n", "docs/fresh.md": doc("id: fresh\ndescribes: [src/auth/b.ts]\nsupersedes: [gone]"), "docs/gone.md": doc("id: gone")}, 20)
    (root / "lib").mkdir()
    git(root, "mv", "src/old", "lib/new")
    put(root, {"docs/plain.md": "# Plain\n\nSee `src/auth/b.ts` and `c.ts` and ./src/auth/d.js.\n", "docs/past.md": doc("id: past\ndescribes: [src/auth/b.ts]\nexpires: 2025-01-01"), "node_modules/x/README.md": "no"}, 5)
    (root / "docs/bin.md").write_bytes(b"a\0b")
    (root / "docs/link.md").symlink_to(root / "docs/plain.md")
    return CMD.load(spark, str(root / "docs"), NOW)


def test_verdicts(corpus):
    got = {r.path: (r.freshness, r.drift_days, r.commits_since) for r in corpus.reports.collect()}
    assert got == {
        "docs/stale.md": ("stale", 100, 1), "docs/old.md": ("orphaned", 0, 0), "docs/fresh.md": ("fresh", -100, 0), "docs/gone.md": ("superseded", 0, 0), "docs/plain.md": ("unverified", 0, 0), "docs/past.md": ("expired", -115, 0),
    }
    assert all(r.reason and r.hint and 0 <= r.score <= 100 for r in corpus.reports.collect())


def test_gate_and_map(corpus):
    first, code = CMD.check(corpus)
    assert code == 1 and first.first().freshness == "superseded" and CMD.check(corpus, ["drifting"])[1] == 0 and CMD.check(corpus, ["nonsense"])[1] == 2


def test_relocations_of_a_moved_folder(corpus):
    r = CMD.relocations(corpus).collect()
    assert [(x.glob, x.suggested, x.moved_count, x.file_count, x.extra_matches) for x in r] == [("src/old/**", "lib/new/**", 2, 2, 0)]


def test_proposals_and_writing(corpus):
    p = CMD.init(corpus)
    assert [(x["path"], x["id"], x["kind"], x["confidence"]) for x in p] == [("docs/plain.md", "plain", "guide", "high")]
    assert p[0]["globs"] == ["src/auth/**"]


def test_pack_accounts_for_everything(corpus):
    packed = CMD.pack(corpus, "title of text", 12, include_stale=True)
    rows = packed.collect()
    assert sorted(r.path for r in rows) == sorted(r.path for r in R.relevance(corpus.reports, "title of text").where("relevance >= 0.05").collect())
    assert sum(r.cost for r in rows if r.place == "entry") <= 12
    strict = CMD.pack(corpus, "title of text", 8000).collect()
    assert {r.path for r in strict if r.place == "excluded"} == {"docs/stale.md", "docs/old.md", "docs/gone.md", "docs/past.md"}
    text = CMD.pack_markdown(CMD.pack(corpus, "title of text", 8000), "title of text")
    assert "## Left out" in text and "### Title" in text


def test_doctor_handoff_verify(corpus):
    assert {r.severity for r in CMD.doctor(corpus).collect()} <= {"major", "minor"}
    note, docs = CMD.handoff(corpus, "title")
    assert note.startswith("# Handoff: title") and docs.count()
    assert CMD.verify(corpus, "docs/old.md") == {"passed": False, "code": 3, "output": ""} and CMD.verify(corpus, "docs/plain.md") is None


def test_folder_reader(spark, corpus):
    assert FS.read_folder(spark, f"file://{corpus.root}/docs").count() >= 6


LADDER = [(-1, 0, "fresh"), (13, 4, "fresh"), (14, 0, "drifting"), (0, 5, "drifting"), (44, 9, "drifting"), (45, 0, "stale"), (0, 10, "stale"), (200, 50, "stale")]


def test_ladder_and_scores(spark):
    df = spark.createDataFrame([(d, c) for d, c, _ in LADDER], "d int, c int").select(FR.ladder(F.col("d"), F.col("c"), Config()).alias("v"), FR.drift_score(F.col("d"), F.col("c"), Config()).alias("s"))
    got = df.collect()
    assert [r.v for r in got] == [v for *_, v in LADDER] and all(0 < r.s <= 100 for r in got)
    assert abs(got[5].s - 50) < 1e-9


def test_budget_fill_is_a_prefix(spark):
    n = 200
    df = spark.range(n).select(F.col("id"), (F.col("id") * 7 % 13).alias("v"))
    got = R.running_total(df, [F.desc("v"), F.col("id").asc()], F.col("v"), "t").collect()
    want, total = {}, 0
    for i, v in sorted(((i, i * 7 % 13) for i in range(n)), key=lambda x: (-x[1], x[0])):
        total += v
        want[i] = total
    assert {r.id: r.t for r in got} == want


RELOCATIONS = [
    # old files, renames, tracked, suggested
    (["s/a/1", "s/a/2"], [("s/a/1", "t/1", 90), ("s/a/2", "t/2", 80)], ["t/1", "t/2"], "t/**"),
    (["s/a/1", "s/a/2"], [("s/a/1", "t/1", 90), ("s/a/2", "u/2", 80)], ["t/1", "u/2"], None),
    (["s/a/1", "s/a/2", "s/a/3"], [("s/a/1", "t/1", 90)], ["t/1"], None),
    (["s/a/1"], [("s/a/1", "t/renamed", 90)], ["t/renamed"], None),
    (["s/a/1"], [("s/a/1", "t/1", 90)], [], None),
]


@pytest.mark.parametrize("old,moved,tracked,want", RELOCATIONS)
def test_relocation_matrix(spark, old, moved, tracked, want):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = RL.relocations(spark.createDataFrame([("s/a/**",)], "glob string"), one(old), spark.createDataFrame(moved, "old_path string, new_path string, similarity int"), one(tracked)).collect()
    assert [r.suggested for r in got] == [want] and got[0].file_count == len(old)


def test_stream_counts_late_commits(spark, tmp_path):
    rows = [("a", "x", datetime(2025, 1, 3)), ("a", "x", datetime(2025, 1, 3)), ("b", "x", datetime(2025, 1, 4)), ("c", "y", datetime(2025, 2, 1))]
    batch = spark.createDataFrame(rows, "sha string, subject string, commit_ts timestamp")
    batch.write.parquet(str(tmp_path / "in"))
    out = feed.activity(feed.commit_stream(spark, str(tmp_path / "in"), batch.schema))
    q = out.writeStream.format("memory").queryName("activity_test").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(60)
    assert {(r.subject, r.commits) for r in spark.table("activity_test").collect()} == {("x", 2), ("y", 1)}


def test_reports_as_values(corpus):
    report = CMD.check_report(corpus, ["stale", "nonsense"], CMD.verify_all(corpus))
    assert report["total"] == 6 and report["exit_code"] == 1 and report["failed"] == ["docs/old.md", "docs/stale.md"] and report["fail_on"] == ["stale"] and report["warnings"] == ["no verdict nonsense"]
    assert report["counts"] == {"fresh": 1, "unverified": 1, "drifting": 0, "stale": 1, "expired": 1, "orphaned": 1, "superseded": 1}
    by = {d["path"]: d for d in report["docs"]}
    assert by["docs/old.md"]["verified"]["code"] == 3 and "`src/old/**` to `lib/new/**`" in by["docs/old.md"]["hint"] and "hint" not in by["docs/fresh.md"]
    assert CMD.check_report(corpus, ["nonsense"])["exit_code"] == 2
    found = CMD.map_report(corpus, "freshness")
    assert [g["key"] for g in found["groups"]] == ["superseded", "orphaned", "expired", "stale", "unverified", "fresh"] and found["totals"]["docs"] == 6 and found["totals"]["unverified_pct"] == 17
    assert sum(len(g["entries"]) for g in CMD.map_report(corpus, "dir")["groups"]) == 6


def test_doctor_counts_moves_and_orders(corpus):
    rows = [(r.place, r.severity, r.title) for r in CMD.doctor(corpus).collect()]
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and "1 docs describe code that moved" in [t for *_, t in rows] and "no configuration file; defaults are used" in [t for *_, t in rows]


def test_relocation_prose(corpus):
    moves = CMD.relocations(corpus)
    text = moves.select(FR.relocation_reason(moves, corpus.clock)).first()[0]
    assert "`src/old/**` matches nothing now but once matched 2 files (the last of them left in" in text and "2 of 2 files now stand at `lib/new/**`" in text


def test_folders_and_no_repository(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    put(root, {"src/auth/x.ts": "let x\n", "docs/a.md": doc("id: a\ndescribes: [src/auth/x.ts]"), "docs/b.md": doc("id: b\ndescribes: [src/auth]"), "docs/c.md": doc("id: c\ndescribes: [src/none]")})
    bare = CMD.load(spark, str(root), NOW)
    assert {(r.path, r.freshness, r.score) for r in bare.reports.collect()} == {(f"docs/{n}.md", "unverified", 50) for n in "abc"} and CMD.check(bare)[1] == 0
    assert CMD.doctor(bare).first().title == "not a git repository"
    git(root, "init", "-q")
    assert "the repository has no commits" in [r.title for r in CMD.doctor(CMD.load(spark, str(root), NOW)).collect()]
    put(root, {}, 120)
    put(root, {"src/auth/x.ts": "let y\n"}, 20)
    (root / "notes").mkdir()
    (root / "notes/new.txt").write_text("untracked")
    (root / "docs/d.md").write_text(doc("id: d\ndescribes: [notes/new.txt]"))
    got = {r.path: (r.freshness, r.matched, r.commits_since) for r in CMD.load(spark, str(root), NOW).reports.collect()}
    assert got == {"docs/a.md": ("stale", 1, 1), "docs/b.md": ("stale", 1, 1), "docs/c.md": ("orphaned", 0, 0), "docs/d.md": ("unverified", 1, 0)}


def test_history_that_cannot_be_read_is_an_error(spark, tmp_path):
    git(tmp_path, "init", "-q")
    put(tmp_path, {"a.md": "# A\n"}, 3)
    broken = next((tmp_path / ".git/objects").glob("[0-9a-f][0-9a-f]"))
    for x in (tmp_path / ".git/objects").glob("[0-9a-f][0-9a-f]/*"):
        x.chmod(0o644)
        x.write_bytes(b"")
    assert broken.exists()
    with pytest.raises(H.HistoryError):
        GL.history(spark, str(tmp_path))


def test_a_verify_that_hangs_is_killed_whole(spark, tmp_path):
    put(tmp_path, {"a.md": doc('id: a\nverify: "(sleep 60; echo late > late.txt) & sleep 60"')})
    corpus = CMD.load(spark, str(tmp_path), NOW)
    found = CMD.verify(corpus, "a.md", 1)
    assert found["code"] == -1 and not found["passed"]


def test_tools(corpus):
    assert TL.call(corpus, "pack", task="title of text", budget=8000).startswith("# Context: title of text")
    one, all_ = TL.call(corpus, "freshness", path="docs/stale.md"), TL.call(corpus, "freshness")
    assert "`docs/stale.md`: stale" in one and "Check it against the code first." in one and "drift 100d, 1 commit" in one
    assert all_.index("| `docs/gone.md` |") < all_.index("| `docs/stale.md` |") < all_.index("| `docs/fresh.md` |") and "## The 4 worst" in all_
    assert "1 documents at docs/fr*.md" in TL.call(corpus, "freshness", glob="docs/fr*.md")
    found = TL.call(corpus, "search", query="title", min_freshness="drifting", limit=2)
    assert "1 shown" in found and "## Worse than drifting: 4" in found
    assert "No document answers" in TL.call(corpus, "search", query="zebra quagga")
    assert TL.call(corpus, "read", path="docs/fresh.md").endswith("# Title\n\nText of it.\n") and "not one of the documents" in TL.call(corpus, "read", path="src/auth/a.ts")
    assert TL.call(corpus, "conflicts").startswith("# Conflicts")
    assert "No handoff" in TL.call(corpus, "handoff_read")
    said = TL.call(corpus, "handoff_write", task="Move it", summary="Half done.", open_questions=["why?"], next_steps=["go on", "stop"])
    assert "1 questions, 2 steps" in said
    back = TL.handoff_read(corpus)
    assert "0 days old, good for 7." in back and "2. stop" in back and "- why?" in back
    assert "Out of date: 30 days old" in TL.handoff_read(corpus, datetime.now(UTC) + timedelta(days=30, hours=1))
    for name, given in (("pack", {}), ("pack", {"task": " "}), ("pack", {"task": "x", "budget": 0}), ("pack", {"task": "x", "budget": True}), ("search", {"query": "x", "min_freshness": "rotten"}), ("read", {"path": "../x"}), ("read", {"path": "none.md"}), ("freshness", {"path": "a", "glob": "b"}), ("nothing", {}), ("conflicts", {"x": 1})):
        with pytest.raises(ValueError):
            TL.call(corpus, name, **given)


def test_handoff_note_expires(corpus):
    note = CMD.handoff_note(corpus, "title", "First thing done. Second thing open.\nlast")
    assert note.startswith("---\nspec: 1\nid: handoff-") and "ttlDays: 7" in note and "- First thing done.\n- Second thing open.\n- last" in note and "## Commits" in note


def test_cache_follows_the_folder(tmp_path):
    git(tmp_path, "init", "-q")
    put(tmp_path, {"a.md": "# A\n"}, 3)
    made, at = [], [0.0]
    cache = Cache(lambda root: made.append(root) or len(made), lambda value: ["a.md"], 60, lambda: at[0])
    assert cache.get(str(tmp_path)) == (1, True) and cache.get(str(tmp_path)) == (1, False)
    put(tmp_path, {"a.md": "# B and more\n"})
    os.utime(tmp_path / "a.md", (1, 10**10))
    assert cache.get(str(tmp_path)) == (2, True) and cache.get(str(tmp_path), force=True) == (3, True)
    at[0] = 61.0
    assert cache.get(str(tmp_path)) == (4, True)


def test_callers_at_once_share_one_build(tmp_path):
    """Two threads, one build; a failed one fails for both and keeps nothing; a replaced value is closed."""
    import threading
    from concurrent.futures import ThreadPoolExecutor

    class Value:
        closed = False

        def close(self):
            self.closed = True

    made, both, broken = [], threading.Barrier(2, timeout=10), [False]

    def make(root):
        made.append(root)
        both.wait()
        if broken[0]:
            raise ValueError("broken")
        return Value()

    cache, root = Cache(make, lambda value: []), str(tmp_path)

    def second():
        while not cache.building:
            pass
        found = cache.building[root]
        both.wait()
        return found.result() if not broken[0] else found.exception()

    with ThreadPoolExecutor(3) as pool:
        one, two = pool.submit(cache.get, root), pool.submit(second)
        assert one.result(10)[0] is two.result(10) and len(made) == 1
        held = cache.held[root][0]
        broken[0] = True
        one, two = pool.submit(cache.get, root, True), pool.submit(second)
        assert isinstance(one.exception(10), ValueError) and two.result(10) is one.exception() and cache.held[root][0] is held and not held.closed
        broken[0] = False
        one, two = pool.submit(cache.get, root, True), pool.submit(second)
        assert one.result(10)[0] is two.result(10) and held.closed and not cache.building


def many_commits(root, n):
    """A repository of n commits by one import: each adds, changes or deletes one of 50 files, some on a side branch that is merged."""
    git(root, "init", "-q", "-b", "main")
    out = []
    for i in range(n):
        name, gone = f"d{i % 5}/f{i % 50}.txt", i >= 50 and i % 50 == i // 50 % 50
        out.append(f"commit refs/heads/main\nauthor a <a@b> {1_000_000 + i} +0000\ncommitter a <a@b> {1_000_000 + i} +0000\ndata {len(str(i))}\n{i}\n")
        out.append(f"D {name}\n" if gone else f"M 644 inline {name}\ndata {len(str(i))}\n{i}\n")
    subprocess.run(["git", "-C", str(root), "fast-import", "--quiet"], input="".join(out).encode(), check=True, env=os.environ | {"HOME": str(root)})


def test_a_long_history_is_read_in_ranges(spark, tmp_path):
    """200,000 commits: whole, in order, in partitions of bounded size, none of it by way of the driver."""
    n = 200_000
    many_commits(tmp_path, n)
    commits, files = GL.history(spark, str(tmp_path))
    assert commits.rdd.getNumPartitions() == n // GL.STEP
    row = commits.agg(F.count("*").alias("n"), F.countDistinct("sha").alias("shas"), F.min("commit_ts").cast("long").alias("first"), F.max("commit_ts").cast("long").alias("last")).first()
    assert tuple(row) == (n, n, 1_000_000, 1_000_000 + n - 1)
    kinds = {r.change_type: r["count"] for r in files.groupBy("change_type").count().collect()}
    assert sum(kinds.values()) == n and kinds["A"] == 50 + kinds["D"] - (50 - GL.trees(spark, str(tmp_path), ["HEAD"]).count())


def test_ranges_and_columns_of_a_history(spark, tmp_path):
    many_commits(tmp_path, 230)
    git(tmp_path, "checkout", "-qf", "main")
    git(tmp_path, "checkout", "-qb", "side", "HEAD~40")
    put(tmp_path, {"ü/x y.txt": "side"}, 3, "side; with, signs")
    git(tmp_path, "checkout", "-q", "main")
    git(tmp_path, "merge", "-qm", "joined", "side", days=2)
    root = str(tmp_path)
    whole = subprocess.run(["git", "-C", root, "log", "--date-order", "--format=%H %ct %s"], capture_output=True, text=True, check=True).stdout.splitlines()
    for step in ("1000", "50", "7"):
        found = GL.read(spark, root, "commits", "seq long, subject string, sha string, commit_ts timestamp", commits=step).withColumn("t", F.col("commit_ts").cast("long")).orderBy("seq").collect()
        assert [f"{r.sha} {r.t} {r.subject}" for r in found] == whole and [r.seq for r in found] == list(range(232))
        files = GL.read(spark, root, "commit_files", "path string", commits=step)
        assert files.columns == ["path"] and files.where("path = 'ü/x y.txt'").count() == 1 and files.count() == 231
    old = whole[30].split()[0]
    assert GL.read(spark, root, "commits", head=old).count() == sum(1 for _ in subprocess.run(["git", "-C", root, "rev-list", old], capture_output=True, check=True).stdout.splitlines())
    for rev in (old, "HEAD", "side"):
        tree = subprocess.run(["git", "-C", root, "-c", "core.quotepath=off", "ls-tree", "-r", "--name-only", rev], capture_output=True, text=True, check=True).stdout.split("\n")[:-1]
        assert sorted(r.path for r in GL.trees(spark, root, [old, "HEAD", "side"]).where(F.col("rev") == rev).collect()) == sorted(tree)
    with pytest.raises(Exception, match="no column"):
        GL.read(spark, root, "files", "sha string").count()
    with pytest.raises(Exception, match="table must be"):
        GL.read(spark, root, "tags").count()


def test_trees_as_of_many_revisions(spark, tmp_path):
    """Replayed trees are those that git gives, for all wanted revisions of a history in a line at once."""
    many_commits(tmp_path, 300)
    root = str(tmp_path)
    commits, files = GL.history(spark, root)
    wanted = commits.where(F.col("subject").cast("int").isin(0, 1, 49, 50, 51, 120, 121, 299)).select(F.concat("sha", F.lit("^")).alias("rev"), "commit_ts", "sha")
    end = spark.createDataFrame([("HEAD", datetime(2100, 1, 1), "~")], "rev string, commit_ts timestamp, sha string")
    got = RL.trees_as_of(files, commits, wanted.unionByName(end)).collect()
    revs = [r.rev for r in wanted.collect() if r.sha not in {x.sha for x in commits.where("subject = '0'").collect()}] + ["HEAD"]
    want = GL.trees(spark, root, revs).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.rev for r in got}) == 8
    assert RL.trees_as_of(files, commits, wanted.limit(0)).collect() == [] and RL.trees_as_of(files.limit(0), commits, wanted).collect() == []


def test_starter_configuration(tmp_path):
    assert CF.write_starter(str(tmp_path)) and not CF.write_starter(str(tmp_path))
    assert CF.load(str(tmp_path)) == Config()
