"""The pipeline's stages, each on what its predecessor kept."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from florilege.llm import mixing, simhash_dedup, toxicity
from florilege.llm.queries import queries


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, data).cache()
        kept[name] = (before, after)
        if name != "curve_packing":
            assert after.columns == columns
        before = after
    # toxicity: what the model rejects goes, all else stays as it was
    b, a = kept["toxicity"]
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(b, model).collect() if r.predicted}
    assert sorted(map(tuple, a.collect())) == sorted(tuple(r) for r in b.collect() if r.doc_id not in bad)
    # lines: every document stays, no line of eight words stands twice
    b, a = kept["line_dedup"]
    assert a.count() == b.count()
    lines = Counter(" ".join(x.lower().split()) for r in a.collect() for x in r.text.split("\n") if len(x.split()) >= 8)
    assert max(lines.values()) == 1
    assert all(r.n_chars == len(r.text) for r in a.collect())
    # near copies: the least id of each component
    b, a = kept["simhash_near_dedup"]
    groups = defaultdict(list)
    for r in simhash_dedup.near_dedup(b).collect():
        groups[r.component_id].append(r.doc_id)
    assert sorted(r.doc_id for r in a.collect()) == sorted(map(min, groups.values()))
    # mix: words taken come near each source's target
    b, a = kept["source_mixing"]
    want = {r.source: r.target for r in mixing.mix(b).join(b.select("doc_id", "source"), "doc_id").collect()}
    got = Counter()
    for r in a.collect():
        got[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert all(abs(got[s] - t) <= 0.05 * t + 20 for s, t in want.items())
    # packing: every token once
    b, a = kept["curve_packing"]
    copies = Counter(r.doc_id for r in b.collect())
    per = defaultdict(int)
    for r in a.collect():
        per[r.doc_id] += r.length
    assert set(per) == set(copies)


def test_run_gives_the_last_stage(spark, data):
    found = corpus_pipeline.run(spark, data)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    assert found.agg({"length": "sum"}).first()[0] > 0


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "source_mixing", "curve_packing"]
