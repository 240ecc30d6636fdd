"""The manifest, the lexical search and the token counts against plain versions, and on the cases that their docstrings define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from florilege.llm import lexical_search, merkle, token_counts
from florilege.llm.queries import vocabulary
from tests.llm.test_operators import EXTRA, SCHEMA, documents, none, odd, odd_rows, rows, wide  # noqa: F401

# 11


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def plain_tree(leaves):
    """The root, and each leaf's levels of (siblings to the left, to the right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8 : a // 8 * 8 + 8]
            paths[i].append((run[: a % 8], run[a % 8 + 1 :]))
        at, level = [a // 8 for a in at], [h(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain_manifest(found):
    langs = defaultdict(list)
    for r in found:
        langs[r[2]].append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
        trees[lang] = plain_tree([plain_leaf(*r) for r in langs[lang]])
    root, crowns = plain_tree([trees[x][0] for x in order])
    out = []
    for lang, crown in zip(order, crowns, strict=True):
        for r, path in zip(langs[lang], trees[lang][1], strict=True):
            got = plain_leaf(r[0], lower(r[1]), *r[2:]) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else plain_leaf(*r)
            for left, right in path + crown:
                got = h(*left, got, *right)
            out.append((r[0], plain_leaf(*r), trees[lang][0], root, h(*[x for left, right in path + crown for x in left + right]), got, got == root))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(odd, wide, none, odd_rows):  # noqa: F811
    assert rows(merkle.manifest(odd)) == plain_manifest(odd_rows)
    assert rows(merkle.manifest(wide)) == plain_manifest(odd_rows)
    assert rows(merkle.manifest(none)) == []


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {None: 9, "en": 64, "é": 65, "z": 1}, {f"l{i}": 1 + i % 3 for i in range(70)}, {"en": 4200, "de": 513, "": 2}])
def test_manifest_of_trees_of_any_height(spark, sizes):
    r = random.Random(str(sizes))
    found = [(None if r.random() < 0.01 else r.randrange(9000), r.choice([None, "", "Some Text", f"text {i}", "Ä Ö"]), lang, r.choice([None, "s"]), r.choice([None, i])) for lang, n in sizes.items() for i in range(n)]
    assert rows(merkle.manifest(spark.createDataFrame(found, SCHEMA).repartition(5))) == plain_manifest(found)


def test_no_node_is_asked_for_by_many(spark):
    """Lookups stay bounded however many leaves a tree has: a node is joined to FAN**BLOCK others at most."""
    n = 40_000
    leaves = spark.range(n).select(merkle.F.lit("t").alias("tree"), merkle.F.lit(n).cast("long").alias("n"), merkle.F.col("id").alias("idx"), merkle.F.sha2(merkle.F.col("id").cast("string"), 256).alias("hash"), "id")
    runs, nodes, top = merkle.grow(leaves.withColumnRenamed("id", "item"))
    assert top.count() == 1 and nodes.count() == sum(math.ceil(n / 8**k) for k in range(1, 7))
    assert max(Counter(x.sibling for r in merkle._siblings(runs, nodes, 1).collect() for x in r.found if x.level == 3).values()) <= merkle.FAN**merkle.BLOCK


# 12


def plain_ranked(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for i, own in asked.items():
        found = []
        for d, c in counts:
            m = 50 + 50 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(i, rank, None if no_id else d, -s) for rank, (s, no_id, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta, no ONE said"), (2, None), (3, ""), (3, "x-ray words; today"), (4, "idiot"), (None, "id here Ünter ünter"), (5, "zzz nowhere"), (6, "a b c 'd' short")]


def test_search_of_odd_rows(spark, odd, wide, none, odd_rows):  # noqa: F811
    items = spark.createDataFrame([(*x, "x", 1) for x in ITEMS], "item_id long, text string, rank string, doc_id int")
    want = plain_ranked([x[:2] for x in odd_rows], ITEMS, 50)
    assert rows(lexical_search.ranked(odd, items)) == want and want
    assert rows(lexical_search.ranked(wide, items)) == want
    assert rows(lexical_search.ranked(none, items)) == [] and rows(lexical_search.ranked(odd, items.limit(0))) == []
    blank = spark.createDataFrame([(1, None), (2, " .")], "doc_id long, text string")
    assert rows(lexical_search.ranked(blank, items)) == []


@pytest.mark.parametrize("most", [1 << 18, 40])
def test_search_by_small_blocks_and_groups(spark, monkeypatch, most):
    """Ties at the k-th place, frequent and rare terms, more blocks than seeds, several groups of queries."""
    r = random.Random(8)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 300}"
    docs = [(i if i % 97 else None, " ".join(word() for _ in range(r.randint(0, 30)))) for i in range(900)] + [(2000 + i, "same w1 words") for i in range(70)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 12)))) for i in range(25)] + [(30, "same"), (31, "same words")]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 4)
    monkeypatch.setattr(lexical_search, "SEEDS", 3)
    monkeypatch.setattr(lexical_search, "GROUP_TERMS", most)
    found = lexical_search.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert rows(found) == plain_ranked(docs, items, 10)


def test_words_in_pieces(monkeypatch):
    text = ("Ab1é, " * 50 + "x" * 90 + " ").encode() * 3
    whole = [w for p in lexical_search.words(memoryview(text), 0, len(text)) for w in p]
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 7)
    assert [w for p in lexical_search.words(memoryview(text), 0, len(text)) for w in p] == whole
    assert whole == [w.encode() for w in re.findall(r"[a-z0-9é]+", text.decode().lower())]


def test_values_stay_whole_in_large_collections():
    import numpy as np

    n, total, length = 10**11, 10**14, 10**9
    assert lexical_search.value(np.array([7]), np.array([length]), n, total)[0] == 7_000_000_000 // (7000 + 20 * (50 + 50 * length * n // total))


# 13


def plain_counts(found):
    library = Tokenizer.from_file(vocabulary())
    counts = [(d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in found]
    return sorted(((*c, c[2] > 1024) for c in counts), key=str)


def test_token_counts(odd, wide, none, odd_rows):  # noqa: F811
    assert rows(token_counts.count_tokens(odd, vocabulary())) == plain_counts([x[:2] for x in odd_rows])
    assert rows(token_counts.count_tokens(wide, vocabulary())) == plain_counts([x[:2] for x in odd_rows])
    assert rows(token_counts.count_tokens(none, vocabulary())) == []


def test_token_counts_of_a_table(documents):  # noqa: F811
    assert rows(token_counts.count_tokens(documents, vocabulary())) == plain_counts([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_special_strings_and_long_runs(spark):
    found = [(1, "a <|endoftext|> b<|endoftext|>"), (2, "x" * 300_000), (3, " " * 200_000 + "y"), (4, "语" * 90_000), (5, "ab. " * 60_000 + "<|endoftext|>" * 3), (6, "12,5 it's\n\n" * 30_000), (7, "é　 x" * 40_000)]
    assert rows(token_counts.count_tokens(spark.createDataFrame(found, "doc_id long, text string"), vocabulary())) == plain_counts(found)


def test_pieces_are_counted_as_the_whole():
    """Cuts at every safe boundary of random texts change no count, and pieces give the text back."""
    library, r = Tokenizer.from_file(vocabulary()), random.Random(3)
    signs = "a1 .,;'\n\t 　、。中文éż's- ᠎䷀한かﾟ٣²Ⅷ"
    for _ in range(3000):
        text = "".join(r.choice(signs) for _ in range(r.randint(1, 40))) + r.choice(["", "<|endoftext|>", " it's 12.5 a"]) + "".join(r.choice(signs) for _ in range(r.randint(1, 40)))
        data = text.encode()
        cut = list(token_counts.pieces(memoryview(data), 0, len(data), r.randint(1, 8)))
        assert b"".join(data[s:e] for s, e in cut) == data
        assert sum(len(library.encode(data[s:e].decode(), add_special_tokens=False)) for s, e in cut) == len(library.encode(text, add_special_tokens=False))
    assert max(e - s for s, e in token_counts.pieces(memoryview(b"word " * 50_000), 0, 250_000)) <= token_counts.PIECE_BYTES + 5
