"""Each operator against a plain version, and on the cases that its docstring defines."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from florilege.llm import common, components, exact_dedup, html_extract, line_dedup, mixing, packing, quality_lm, simhash_dedup, suffix_dedup, topk_search, toxicity
from florilege.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", fp long, size string, key int, row string, target double, doc string, words int, n_lines int, id string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empty, long, tied and repeated texts."""
    r = random.Random(5)
    prose = lambda n: " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    long, passage = prose(60_000), prose(40)
    rows = [
        (1, "", "en", "b", 0), (2, None, None, None, None), (3, "One line of words that is said again here today\nshort", "en", "a", 9),
        (4, "short\nOne line of words that is said again here today", "en", "a", 9), (5, "one  LINE of words that was said again here today", "en", None, 9),
        (6, long, "de", "b", 9), (7, long, "de", "b", 9), (8, "start " + passage + " end", "en", "c", 9), (9, passage + " other", "en", "c", 9),
        (9, passage + " other", "en", "c", 9), (None, "no id here", "en", "c", 9), (10, "a b  c\td \n", "fr", "a", 9), (11, "a b c\td ", "fr", "a", 9), (12, "idiot", "en", "z", 5), (13, "x" * 500, "en", "z", 5),
    ]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="module")
def wide(spark, odd_rows):
    return spark.createDataFrame([(*x, 7, "s", 3, "r", 0.5, "d", 4, 5, "i") for x in odd_rows], SCHEMA + EXTRA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols or df.columns) for r in df.collect()), key=str)


# 6


def test_hashes_of_chunks_combine():
    data = np.frombuffer(random.Random(1).randbytes(200_000), np.uint8)
    parts = [data[a:b] for a, b in zip([0, 7, 70_000, 131_000], [7, 70_000, 131_000, 200_000], strict=True)]
    h = (0, 0, 0)
    for p in parts:
        for at in range(0, len(p), exact_dedup.CHUNK):
            h = exact_dedup.combine(h, exact_dedup.chunk_hash(p[at : at + exact_dedup.CHUNK]))
    assert (h[0] << 31 | h[1], h[2]) == exact_dedup.fingerprint(data)
    assert exact_dedup.fingerprint(data[:-1]) != exact_dedup.fingerprint(data)


def plain_exact(found):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in found]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(((i, least[t], len(groups[t]), i == least[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)


def test_exact_dedup(odd, wide, none, odd_rows):
    assert rows(exact_dedup.exact_dedup(odd)) == plain_exact([x[:2] for x in odd_rows])
    assert rows(exact_dedup.exact_dedup(wide)) == plain_exact([x[:2] for x in odd_rows])
    assert rows(exact_dedup.exact_dedup(none)) == []


def test_exact_dedup_survives_colliding_fingerprints(spark, monkeypatch):
    found = [(i, f"text {i % 3}") for i in range(12)]
    monkeypatch.setattr(exact_dedup, "PRIMES", (1, 1))
    df = spark.createDataFrame(found, "doc_id long, text string")

    def same(batches, f=exact_dedup._fingerprints):
        for b in f(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int64()), b.column(2), b.column(3)], names=b.schema.names)

    def same_chunks(table, f=exact_dedup._chunks):
        def run(batches):
            for b in f(table)(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int64()), *b.columns[2:]], names=b.schema.names)

        return run

    monkeypatch.setattr(exact_dedup, "_fingerprints", same)
    monkeypatch.setattr(exact_dedup, "_chunks", same_chunks)
    monkeypatch.setattr(exact_dedup, "shared_filter", lambda groups: np.full(1, ~np.uint64(0)))
    assert rows(exact_dedup.exact_dedup(df)) == plain_exact(found)


# 1


def plain_simhash(found):
    def fp(t):
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(t) for _, t in found]
    label = list(range(len(found)))
    for _ in found:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    ids = {k: min((found[i][0] for i in range(len(found)) if label[i] == k and found[i][0] is not None), default=None) for k in set(label)}
    return sorted(((d, f"{f:016x}", ids[k]) for (d, _), f, k in zip(found, fps, label, strict=True)), key=str)


def test_simhash(odd, wide, none, odd_rows, documents):
    short = [x[:2] for x in odd_rows if len(x[1] or "") < 10_000]
    keep = odd.where("text is null or length(text) < 10000")
    assert rows(simhash_dedup.near_dedup(keep)) == plain_simhash(short)
    assert len(rows(simhash_dedup.near_dedup(wide))) == len(odd_rows)
    assert rows(simhash_dedup.near_dedup(none)) == []
    small = documents.where("doc_id < 60")
    assert rows(simhash_dedup.near_dedup(small)) == plain_simhash([(r.doc_id, r.text) for r in small.collect()])


def test_links_beyond_a_distance_without_pairs():
    fp = np.array([0, 0xFFFF << 20, 0xFFFF << 40, 1], np.uint64)
    a, b = simhash_dedup.bucket_links(np.zeros(4, np.int64), np.array([0, 1, 0, 1], np.int8), fp)
    assert (a.tolist(), b.tolist()) == ([0], [1])


def test_links_connect_all_that_are_near():
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base[:4]:
        for _ in range(60):
            g = f
            for b in r.sample(range(64), r.randint(1, 9)):
                g ^= 1 << b
            fps.add(g)
    fps = np.array(sorted(fps), np.uint64)
    keyed = []
    for batch in simhash_dedup._signatures([pa.record_batch([fps.view(np.int64)], names=["fp"])]):
        keyed = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    key, side, fp = (np.array(c) for c in zip(*keyed, strict=True))
    a, b = simhash_dedup.bucket_links(key, side.astype(np.int8), fp.view(np.uint64))
    assert all(int(x ^ y).bit_count() <= 4 for x, y in zip(a, b, strict=True))
    root = {int(f): int(f) for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in zip(a, b, strict=True):
        root[find(int(x))] = find(int(y))
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            assert int(x ^ y).bit_count() > 4 or find(int(x)) == find(int(y))
    assert len(a) < 64 * len(fps)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200) if i % 50] + [(5, 5), (7, 6)]
    found = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert found[49] == 1 and found[99] == 51 and 0 not in found


# 2


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, held = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in held)
        open_ = sum(weight[s] for s in names if s not in held)
        out = {s: 3 * sizes[s] if s in held else left * weight[s] / open_ for s in names}
        over = {s for s in names if s not in held and out[s] > 3 * sizes[s]}
        if not over:
            return out
        held |= over


def test_mixing(odd, wide, none, odd_rows, documents):
    found = mixing.mix(odd)
    size = defaultdict(int)
    for x in odd_rows:
        size[x[3]] += len(words(x[1]))
    want = plain_targets(size)
    got = defaultdict(int)
    for r in found.collect():
        assert math.isclose(r.target, want[r.source], abs_tol=1e-6) and r.source_size == size[r.source] and 0 <= r.taken <= 3 * r.size
        got[r.source] += r.taken
    for s in want:  # texts are taken whole, so a source may miss its target by less than its least text
        assert abs(got[s] - want[s]) < min([len(words(x[1])) for x in odd_rows if x[3] == s and words(x[1])], default=1)
    assert found.count() == len(odd_rows) and rows(found) == rows(mixing.mix(odd))
    assert rows(mixing.mix(wide), "doc_id", "taken") == rows(found, "doc_id", "taken")
    assert rows(mixing.mix(none)) == [] and rows(mixing.mixed_copies(none)) == []
    copies = mixing.mixed_copies(wide)
    assert copies.columns == wide.columns
    per = defaultdict(int)
    for r in copies.collect():
        per[r.doc_id] += len(words(r.text))
        assert any((x[1] or "").startswith(r.text) for x in odd_rows)
    taken = defaultdict(int)
    for d, t in rows(found, "doc_id", "taken"):
        taken[d] += t
    assert {k: v for k, v in taken.items() if v} == dict(per)


def test_mixing_takes_whole_texts(spark, odd, wide, odd_rows):
    r = random.Random(3)
    size_of = lambda i: (3_000 if i % 50 == 0 else r.randint(5, 300)) + i % 7
    made = [(i, " ".join(f"w{i % 9}x{k}" for k in range(size_of(i))), "en", "abc"[i % 3], 9) for i in range(600)]
    df = spark.createDataFrame(made, SCHEMA)
    found, copies = mixing.mix(df), mixing.mixed_copies(df)
    by, got, want, least = defaultdict(int), defaultdict(int), {}, defaultdict(lambda: 10**9)
    for x in found.join(df.select("doc_id", "source"), "doc_id").collect():
        assert x.taken % x.size == 0 and 0 <= x.taken <= 3 * x.size
        by[x.doc_id] = x.taken // x.size
        got[x.source] += x.taken
        want[x.source] = x.target
        least[x.source] = min(least[x.source], x.size)
    for s in want:
        assert abs(got[s] - want[s]) < 2 * least[s]
    texts = {x[0]: x[1] for x in made}
    per = defaultdict(int)
    for x in copies.collect():
        assert x.text == texts[x.doc_id]
        per[x.doc_id] += 1
    assert per == {k: v for k, v in by.items() if v}
    # rows of the odd cases as well: nulls, repeats, clashing column names
    whole = {x[1] for x in odd_rows}
    copies = mixing.mixed_copies(wide)
    assert copies.columns == wide.columns and all(x.text in whole and x.row == "r" for x in copies.collect())
    assert all(x.taken % x.size == 0 if x.size else x.taken == 0 for x in mixing.mix(odd).collect())


def test_mixing_has_no_python(documents, capsys):
    mixing.mixed_copies(documents).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


# 3


def test_packing(odd, wide, none, odd_rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary())
    ids = [np.array([*whole.encode(x[1] or "", add_special_tokens=False).ids, 1], "<u4") for x in odd_rows]
    for df in (odd, wide):
        found = packing.pack(df, vocabulary(), with_ids=True).collect()
        docs = defaultdict(list)
        for r in found:
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048
            docs[r.doc_id].append((r.start, r.ids))
        for x, want in zip(odd_rows, ids, strict=True):
            own = sorted(docs[x[0]])
            copies = sum(y[0] == x[0] for y in odd_rows)
            assert sum(len(p) for _, p in own) == 4 * copies * len(want)
            assert all(p == want[s : s + len(p) // 4].tobytes() for s, p in own)
        sequences = defaultdict(list)
        for r in found:
            sequences[r.sequence_id].append((r.offset, r.length))
        for parts in sequences.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 2048 and at & (at - 1) == 0
    assert packing.pack(none, vocabulary()).collect() == []


def test_special_strings_and_fast_tokens_agree(documents):
    from tokenizers import Tokenizer

    whole, encode = Tokenizer.from_file(vocabulary()), packing.encoder(vocabulary())
    texts = [r.text for r in documents.limit(60).collect()] + ["<|endoftext|> x", "  a\n\n\tb ", "naïve 東京 🙂 don't 12,345", "  x", "'S IT'S"]
    assert [encode(t) for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = grid[np.argsort(packing.hilbert(grid, 3))]
    assert sorted(packing.hilbert(grid, 3)) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


# 4


def test_top_k(spark, none):
    r = random.Random(2)
    vectors = [(i, [r.uniform(-2, 2) for _ in range(20)]) for i in range(130)]
    vectors += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 20), (260, [float("inf")] * 20), (280, []), (300, [1e30] * 20), (301, vectors[0][1]), (302, vectors[0][1]), (None, vectors[0][1]), (320, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in vectors], "vec_id long, embedding array<double>, score int, rank string")
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [min(max(x, -(2**63)), 2**63 - 1) for x in v]) for i, v in good if i != 300]
    want = []
    for q, a in good:
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in good if i != q)[:20]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert rows(topk_search.top_k(df.where("vec_id is null or vec_id <> 300"))) == sorted(want, key=str)
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert rows(topk_search.top_k(few)) == [(0, 1, 1, 64 * 128)]


def block(ids, dims):
    dims = np.asarray(dims, np.float64)
    large = float(np.abs(dims).max(initial=0))
    return topk_search.Block(np.asarray(ids, np.int64).tobytes(), len(ids), dims.astype(topk_search._kept(large)).tobytes(), len(dims), large)


def test_block_search_prunes_nothing_needed():
    r = np.random.default_rng(0)
    for scale in (3, 1000, 1 << 22):
        q, c = r.integers(-scale, scale, (64, 9)), r.integers(-scale, scale, (64, 700))
        c[:, 300:500] = c[:, :1]
        own, best = block(np.arange(9), q), topk_search.Best(9, 20)
        for at in range(0, 700, 150):  # the bound is carried from block to block
            topk_search.meet(own, block(np.arange(at, min(at + 150, 700)), c[:, at : at + 150]), best)
        for i in range(9):
            all_ = q[:, i].astype(object) @ c.astype(object)
            want = sorted((-all_[j], j) for j in range(700) if j != i)[:20]
            assert list(zip((-best.score[i]).tolist(), best.id[i].tolist(), strict=True)) == [(int(a), b) for a, b in want]


def test_survivors_are_compacted_and_whole():
    r = np.random.default_rng(1)
    q, c = r.integers(-90, 90, (70, 40)), r.integers(-90, 90, (70, 900))
    c[:, 100:800] //= 20  # short rows leave early
    scores = q.T @ c
    floor = np.sort(scores, axis=1)[:, -20].astype(float)
    rows, cols, found = topk_search.survivors(block(np.arange(40), q), block(np.arange(900), c), floor)
    assert (scores[rows, cols] == found).all()
    assert {(a, b) for a, b in zip(rows.tolist(), cols.tolist(), strict=True)} == {(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(scores >= floor[:, None])), strict=True)}


def test_grid_moves_the_small_side():
    mb = 1 << 20
    assert topk_search.grid(0, 0, 0, 0, 0, 200) == (1, 1)
    assert topk_search.grid(mb, 3, mb // 20, 1, mb // 4, 200) == (3, 1)
    for size in (10 * mb, 1000 * mb, 7_500 * mb, 1 << 40):
        queries, found = size // 20, size // 4
        cells, groups = topk_search.grid(size, size // 70_000, queries, size // 1_400_000, found, 200)
        assert cells * topk_search.CELL_BYTES >= size and cells * groups >= min(200, size // 70_000)
        # what moves, against the least that any grid with as many tasks moves
        cost = lambda c, g: size * g + (queries + found) * c  # noqa: E731, B023
        others = [cost(c, -(-200 // c)) for c in range(max(1, -(-size // topk_search.CELL_BYTES)), 201)]
        assert cost(cells, groups) <= 1.2 * min(others, default=cost(cells, 1))


@pytest.mark.parametrize("cell_bytes", [128 << 20, 100])
def test_top_k_of_large_components_and_repeated_ids(spark, monkeypatch, cell_bytes):
    monkeypatch.setattr(topk_search, "CELL_BYTES", cell_bytes)
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 1024 if cell_bytes > 100 else 3)
    r = random.Random(8)
    vectors = [(i, [r.uniform(-2, 2) for _ in range(5)]) for i in range(60)]
    vectors += [(300, [1e30] * 20), (340, [-1e300, 1e300]), (301, [1e10] * 3), (302, [1e17] * 20), (400, [1e308]), (40, vectors[40][1])]
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in vectors if i != 400]
    want = []
    for q, a in dict(good).items():
        if q % 20 == 0:
            score = lambda b, a=a: min(max(sum(x * y for x, y in zip(a, b, strict=False)), -(1 << 63)), (1 << 63) - 1)
            want += [(q, k, i, -s) for k, (s, i) in enumerate(sorted((-score(b), i) for i, b in good if i != q)[:20], 1)]
    assert rows(topk_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>"))) == sorted(want, key=str)


# 5


def plain_repeats(found):
    least, out = {}, []
    order = lambda d: -1 if d is None else d
    for d, t in found:
        data = (t or "").encode()
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            least[w] = min(least.get(w, (order(d), i)), (order(d), i))
    for d, t in found:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if least[data[i : i + 100]] < (order(d), i):
                gone[i : i + 100] = b"\1" * 100
        spans = sum(g and not p for g, p in zip(gone, [0, *gone], strict=False))
        out.append((d, len(data), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup(odd, wide, none, odd_rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    want = plain_repeats([x[:2] for x in odd_rows])
    assert rows(suffix_dedup.remove_repeats(odd)) == want
    if hot:
        assert rows(suffix_dedup.remove_repeats(wide)) == want
        assert rows(suffix_dedup.remove_repeats(none)) == []


def test_suffix_dedup_of_longer_texts_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    r = random.Random(9)
    text = "".join(r.choice("abcd ") for _ in range(3000))
    found = [(1, text), (2, text[500:2900]), (3, "zz" + text[100:350] + "y" * 400), (4, text[:99] + text[200:1200])]
    spans = list(suffix_dedup._anchored([pa.record_batch([[x[0] for x in found], [x[0] for x in found], [x[1] for x in found]], names=["doc", "row", "text"])]))
    covered = sum(b.num_rows for b in spans)
    assert covered
    monkeypatch.undo()
    assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(found, "doc_id long, text string"))) == plain_repeats(found)


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup_of_rows_that_share_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_RUNS", hot)
    r = random.Random(1)
    some = lambda n, of="abcdefgh ": "".join(r.choice(of) for _ in range(n))
    q, u, p, base = some(300), some(400), some(150), [some(250) for _ in range(12)]
    mixed = []
    for d in range(60):
        t = some(r.randint(0, 120))
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, 120)
            t += r.choice(base)[at : at + r.randint(90, 250)] + some(r.randint(0, 30), "ab")
        mixed.append((r.choice([d, d, d % 7, None]), t))
    knots = "a"
    for _ in range(9):
        knots += "".join("ab"[c == "a"] for c in knots)
    for found in (
        [(1, q), (5, q), (5, u)],
        [(5, p), (5, some(500) + p + some(410))],
        [(None, q), (None, u + q), (None, q), (3, q + u), (3, u)],
        [(1, knots), (2, knots[3:]), (2, "x" * 1000), (None, knots[100:300])],
        mixed,
    ):
        assert rows(suffix_dedup.remove_repeats(spark.createDataFrame(found, "doc_id long, text string"))) == plain_repeats(found)


def test_radix_finds_equal_windows():
    r = random.Random(2)
    data = np.array([r.randrange(2) for _ in range(400)] * 2 + [0] * 300, np.uint8)
    at = np.arange(len(data) - suffix_dedup.DEPTH + 1)
    group = at % 3
    live, label = suffix_dedup.radix(group, at, data)
    sets, want = defaultdict(set), defaultdict(set)
    for i, n in zip(live.tolist(), label.tolist(), strict=True):
        sets[n].add(i)
    for i in at.tolist():
        want[i % 3, data[i : i + suffix_dedup.DEPTH].tobytes()].add(i)
    assert sorted(map(sorted, sets.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


# 7


def plain_lines(found, least=5, near=8):
    order = lambda d: -1 if d is None else d
    lines = [((order(d), n), line_dedup.words_of(x.encode())) for d, t in found for n, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if len(x[1]) >= least]
    out = defaultdict(list)
    for d, t in found:
        kept = []
        for n, line in enumerate((t or "").split("\n")):
            w = line_dedup.words_of(line.encode())
            if len(w) < least or not any(p < (order(d), n) and (w == o or (len(w) >= near and len(o) >= near and edit(w, o) <= 1)) for p, o in lines):
                kept.append(line)
        out[d].append(None if t is None else "\n".join(kept))
    return {d: sorted(x, key=str) for d, x in out.items()}


def lines_of(df, **parameters):
    got = defaultdict(list)
    for x in line_dedup.line_dedup(df, **parameters).collect():
        got[x.doc_id].append(x.text)
    return {d: sorted(x, key=str) for d, x in got.items()}


def edit(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_line_dedup(spark, odd, wide, none, odd_rows):
    r = random.Random(4)
    lines = [[r.choice("abcdefgh") for _ in range(r.randint(3, 12))] for _ in range(30)]
    found = []
    for d in range(40):
        own = []
        for _ in range(6):
            w = list(r.choice(lines))
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                k = r.randrange(len(w))
                w[k : k + r.choice((0, 1))] = r.choice(([], ["x"], ["y"]))
            own.append(" ".join(w))
        found.append((d, "\n".join(own)))
    df = spark.createDataFrame(found, "doc_id long, text string")
    assert lines_of(df, least=5, near=8) == plain_lines(found) and lines_of(df) == plain_lines(found, 1, 5)
    short = [x[:2] for x in odd_rows if len(x[1] or "") < 10_000]
    keep = odd.where("text is null or length(text) < 10000")
    assert lines_of(keep, least=5, near=8) == plain_lines(short) and lines_of(keep) == plain_lines(short, 1, 5)
    out = line_dedup.drop_lines(wide)
    assert out.columns == wide.columns and out.count() == len(odd_rows)
    assert line_dedup.line_dedup(none).collect() == []


@pytest.mark.parametrize("hot", [20_000, 2])
def test_line_dedup_of_rows_that_share_an_id(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)  # at 2, shared keys are dealt over salts
    own, line = "own line that nobody else has at all here", "this line stands in both of the documents here"
    r = random.Random(7)
    mixed = [(r.choice([d, d % 5, None]), "\n".join(" ".join(r.choice("ab") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 5)))) for d in range(25)]
    for found in (
        [(1, line), (5, own), (5, line)],
        [(None, "x\ny\nz z z z z z"), (None, "q"), (None, None), (None, "x\nz z z z z y\nw"), (2, "q\nx")],
        mixed,
    ):
        assert lines_of(spark.createDataFrame(found, "doc_id long, text string")) == plain_lines(found, 1, 5)


def test_halves_meet():
    r = random.Random(6)
    for _ in range(500):
        a = [bytes([r.randrange(97, 123)]) for _ in range(r.randint(8, 20))]
        b = list(a)
        k = r.randrange(len(b))
        b[k : k + r.choice((0, 1))] = r.choice(([], [b"?"]))
        if len(b) >= 8:
            assert line_dedup.within_one(a, b) == (edit(a, b) <= 1)
            assert set(line_dedup.halves(a)) & set(line_dedup.halves(b))


def test_variants_of_long_lines():
    line = [b"w%d" % i for i in range(100_000)]
    keys = line_dedup.variant_keys(line)
    short = line[:500] + line[501:]
    assert line_dedup.variant_keys(short)[0] == keys[1 + 500] and len(set(keys.tolist())) == len(keys)
    assert line_dedup.variant_keys(line[:500] + [b"other"] + line[501:])[501] == keys[501]
    twice = [b"a", b"a", b"b"]
    assert line_dedup.variant_keys(twice)[1] == line_dedup.variant_keys(twice)[2] != line_dedup.variant_keys([b"b", b"a"])[0]


def test_line_dedup_of_short_lines(spark):
    found = [
        (1, "all rights reserved.\n\nnext page\nwe met them at noon\n今日はとても天気が良いです"),
        (2, "All  rights reserved.\n\nNext page\nwe met him at noon\n今日はとても天気が悪いです\nown"),
        (3, "own\nwe met at\nnext pages\n今日はとても天気が良いです"),
    ]
    df = spark.createDataFrame(found, "doc_id long, text string")
    got = {x.doc_id: x.text for x in line_dedup.line_dedup(df).collect()}
    assert got == {1: found[0][1], 2: "\nown", 3: "we met at\nnext pages"}


def test_pipeline_and_query_take_short_lines(spark, tmp_path):
    import corpus_pipeline

    from florilege.llm.queries import queries

    df = spark.createDataFrame([(1, "all rights reserved.", "en", "a", 20), (2, "all rights reserved.\nrest", "en", "a", 25)], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {x.doc_id: x.text for x in queries()["op7_line_dedup"](spark, str(tmp_path)).collect()} == {1: "all rights reserved.", 2: "rest"}
    assert {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_lines(spark, df, str(tmp_path)).collect()} == {1: "all rights reserved.", 2: "rest"}


# 8


def test_quality(spark, odd, none, documents, data):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    found = {r.doc_id: r for r in quality_lm.score(documents, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [found[d].kept for d, q in known.items() if q == 1 and d in found]
    bad = [found[d].kept for d, q in known.items() if q == 0 and d in found]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept for r in quality_lm.score(odd, empty).collect())
    assert quality_lm.score(none, empty).collect() == []
    some = quality_lm.score(odd, spark.createDataFrame([(3, 1), (4, 1), (None, 1), (99, 1), (5, None)], "doc_id long, quality int"))
    assert some.count() == odd.count() and all(r.kept for r in some.collect() if not r.n_chars)


def plain_model(texts, order=quality_lm.ORDER):
    """p(gram) of interpolated modified Kneser-Ney by its definition, over tuples of classes."""
    seen = [None] * (order + 1)
    seen[order] = Counter()
    for t in texts:
        own = tuple(quality_lm.classes(" " * (order - 1) + (t or "")).tolist())
        seen[order].update(own[i : i + order] for i in range(len(t or "")))
    for n in range(order - 1, 0, -1):
        seen[n] = Counter(g[1:] for g in seen[n + 1])
    cut = []
    for n in range(1, order + 1):
        of = Counter(seen[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] else 0.5
        cut.append([0] + [min(i, max(0.0, i - (i + 1) * y * of[i + 1] / of[i])) if of[i] else 0.5 * i for i in (1, 2, 3)])
    total, weight = Counter(), Counter()
    for n in range(1, order + 1):
        for g, c in seen[n].items():
            total[n, g[:-1]] += c
            weight[n, g[:-1]] += cut[n - 1][min(c, 3)]

    def p(g):
        if not g:
            return 1 / quality_lm.ALPHABET
        n, before = len(g), g[:-1]
        if not total[n, before]:
            return p(g[1:])
        c = seen[n].get(g, 0)
        return (c - cut[n - 1][min(c, 3)]) / total[n, before] + weight[n, before] / total[n, before] * p(g[1:])

    return p


QUALITY = [
    (1, "en", "the cat sat on the mat. THE CAT 12!"), (2, "en", "a dog, a cat; another cat sat"), (3, "el", "η γάτα κάθεται στο χαλί"), (4, "el", "ο σκύλος και η γάτα"), (5, "ru", "кошка сидит на ковре"), (6, "zh", "猫坐在垫子上，狗在外面。"),
    (7, None, "the dog sat on a mat"), (8, "en", None), (9, "en", ""), (9, "en", "qzx qzx 😀"), (None, "ru", "кошка"), (10, "en", "the cat sat on the mat. THE CAT 12!"), (11, "ru", "собака и кошка сидят"), (12, "zh", "猫" * 40),
]


@pytest.mark.parametrize("rows_at_once,piece", [(4_000_000, 1 << 20), (0, 1 << 20), (4_000_000, 7)])
def test_perplexity_against_the_definition(spark, monkeypatch, rows_at_once, piece):
    monkeypatch.setattr(quality_lm, "TABLE_ROWS", rows_at_once)
    monkeypatch.setattr(quality_lm, "LEAST_TRUSTED", 1)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    if piece < 100:  # workers read the module anew, so pieces are tested here
        texts = [t for *_, t in QUALITY]
        whole = [np.concatenate(x) for x in zip(*quality_lm.grams(texts), strict=True)]
        monkeypatch.setattr(quality_lm, "PIECE", piece)
        assert all((np.concatenate(x) == y).all() for x, y in zip(zip(*quality_lm.grams(texts), strict=True), whole, strict=True))
        return
    docs = spark.createDataFrame([(*x, 1, 2.0) for x in QUALITY], "doc_id long, lang string, text string, bits int, perplexity double")
    labels = [(i, int(i not in (9, 12))) for i in range(1, 13)] + [(None, 1), (99, 1), (12, None)]
    found = quality_lm.score(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    back = {r.text: r.held for r in docs.selectExpr("text", f"pmod(xxhash64(text), {quality_lm.HELD}) = 0 as held").collect()}
    good = {i for i, q in labels if q == 1 and i}
    p = plain_model([t for i, _, t in QUALITY if i in good and not back[t]])
    memo = {}

    def bits(t):
        if t not in memo:
            own = tuple(quality_lm.classes("    " + (t or "")).tolist())
            memo[t] = -sum(math.log(p(own[i : i + 5])) for i in range(len(t or "")))
        return memo[t]

    held = [(lang, t) for i, lang, t in QUALITY if i in good and back[t]]
    assert held
    mean = lambda xs: sum(bits(t) for _, t in xs) / max(1, sum(len(t or "") for _, t in xs))
    base = {lang: mean([x for x in held if x[0] == lang]) for lang, _ in held}
    score = lambda lang, t: math.exp((bits(t) + quality_lm.PRIOR * base.get(lang, mean(held))) / (len(t or "") + quality_lm.PRIOR))
    cut = lambda xs: sorted(xs)[math.ceil(quality_lm.QUANTILE * len(xs)) - 1]
    limit = {lang: cut([score(*x) for x in held if x[0] == lang]) for lang in base}
    every = cut([score(*x) for x in held])
    want = sorted((str(i), str(lang), len(t or ""), score(lang, t), quality_lm.MARGIN * limit.get(lang, every)) for i, lang, t in QUALITY)
    got = sorted((str(r.doc_id), str(r.lang), r.n_chars, r.perplexity, r.threshold) for r in found)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3:] for x in got], [x[3:] for x in want])
    assert all(r.kept == (r.perplexity <= r.threshold) for r in found)


def test_quality_of_rows_that_never_train(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = quality_lm.score(docs, labels.where("doc_id % 5 <> 0")).join(labels.where("doc_id % 5 = 0"), "doc_id").collect()
    assert np.mean([r.kept for r in found if r.quality == 1]) > 0.97 and np.mean([r.kept for r in found if r.quality == 0]) < 0.2


def test_kneser_ney_probabilities_add_up():
    p = plain_model(["the cat sat on the mat. THE CAT 12!", "a dog, a cat; another"])
    for before in ("the ", "cat ", "qqqq"):
        own = tuple(quality_lm.classes(before).tolist())
        assert math.isclose(sum(p((*own, c)) for c in range(quality_lm.ALPHABET)), 1)


# 9


def test_extraction_on_held_out_pages():
    model, good, all_ = html_extract.trained(), 0, 0
    for nodes in html_extract.training_pages(80, seed=77):
        for node, p in zip(nodes[1:], model.marginals(nodes)[1:], strict=True):
            if node.own:
                all_ += 1
                good += (p[0] > p[1]) == (node.state == html_extract.CONTENT)
    assert good / all_ > 0.95


def test_extraction_of_the_tables_pages(spark, data):
    import html

    def plain(page):
        own = page[page.index("<article>") + 9 :].split("</article>")[0].split("<footer>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", own)]
        return "\n\n".join(x for x in blocks if x)

    pages = spark.read.parquet(f"{data}/pages.parquet")
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages.collect())
    assert rows(html_extract.extract(pages)) == sorted(want, key=str)


def test_extraction_cases(spark):
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><div class="header"><h1>Site</h1></div><ul class="nav"><li><a href="#">Home</a></li></ul><div id="content"><h1>Head &amp; tail</h1>'
        "<p>One&nbsp;sentence\n here, with <b>bold</b> text.<p>Two<br>lines.<script>var x='</p>'</script><div class='advert'>Buy</div><table><tr><td>a<td>b</table></div>"
        '<div class="comments"><p>I liked this one a lot.</p></div><div class="cookie-notice">We use cookies.</div><footer>&copy; me</footer></body></html><p unfinished'
    )
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<<<>>> & <"), (1, "u", page)], "page_id long, url string, html string")
    found = html_extract.extract(df).collect()
    assert [r.text for r in found if r.page_id == 1] == ["Head & tail\n\nOne sentence here, with bold text.\n\nTwo lines.\n\na\n\nb"] * 2
    assert [(r.text, r.n_chars) for r in found if r.page_id in (2, 3)] == [("", 0)] * 2
    assert len(found) == 5 and html_extract.extract(df.where("false")).collect() == []


@pytest.mark.parametrize("page", ["<" * 100_000, "<div>" * 20_000, '<a href="' * 20_000, "<p" * 50_000, "<!--" * 50_000, "&" * 100_000, "<p x='" + "a" * 100_000, "<li>" * 20_000])
def test_extraction_of_broken_markup_ends_soon(page):
    began = time.monotonic()
    html_extract.trained().extract(page)
    assert time.monotonic() - began < 20


# 10


def test_toxicity(spark, none, odd, data):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in found.items())
    marks = [(r.toxic, found[r.doc_id].predicted) for r in labels.collect() if found[r.doc_id].held_out]
    assert sum(p for t, p in marks if t) >= 0.6 * sum(t for t, _ in marks) and sum(p for t, p in marks if not t) <= 0.05 * len(marks)
    bare = toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.doc_id: r.predicted for r in toxicity.score(odd, bare).collect()}[12] == 1
    assert toxicity.score(none, bare).collect() == [] and toxicity.keep_clean(odd, bare).count() == odd.count() - 1
    same = toxicity.train(docs, labels)
    assert (same.weights, same.coefficients) == (model.weights, model.coefficients)


def test_folding_and_exceptions():
    assert toxicity.fold("ID10T, ïdіоt!") == " idiot idiot "
    m = toxicity.Model(exceptions={" trash can ": " trash "})
    a = m.automaton()
    assert m.score("the trash can is full", a) == m.score("the box is full", a) < m.score("the trash is full", a)
    assert m.score("stupid " * 3, a) > m.score("stupid " + "word " * 500, a)
    assert m.score(None, a) == m.score("", a)
