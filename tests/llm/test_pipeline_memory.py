"""What the pipeline's tasks hold in Python: one worker each, batches of bounded bytes, one encoder."""

import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from florilege.llm import common, line_dedup, packing
from florilege.llm.queries import vocabulary


def python_nodes(df) -> int:
    """The most Python operators, each with a worker of its own, that stand in one stage above each other."""
    above, most = [(-1, 0)], 0
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        if not (name := re.search(r"[A-Za-z]\w+", line)):
            continue
        depth = name.start() if not re.match(r"[\s:+-]*\*\(", line) else line.index("*")
        while above[-1][0] >= depth:
            above.pop()
        held = 0 if "Exchange" in name[0] else above[-1][1] + bool(re.search("Python|Arrow|Pandas", name[0]))
        above.append((depth, held))
        most = max(most, held)
    return most


def test_a_task_of_line_dedup_has_one_python_worker(spark, monkeypatch):
    same = "one two three four five six seven"
    made = [(1, f"{same}\n\n"), (2, f"{same} eight\nown line"), (3, f"x\n{same}\n"), (4, "x"), (5, ""), (6, None), (7, "\n\nx\n\n"), (None, "first of all\nx")]
    docs, plans = common.stored(spark.createDataFrame(made, "doc_id long, text string")), []

    def noted(df):
        plans.append(python_nodes(df))
        return common.stored(df)

    monkeypatch.setattr(line_dedup, "stored", noted)
    found = line_dedup.line_dedup(docs)
    assert max(*plans, python_nodes(found)) == 1
    want = {1: (3, 0, f"{same}\n\n"), 2: (2, 1, "own line"), 3: (3, 2, ""), 4: (1, 1, ""), 5: (1, 0, ""), 6: (0, 0, None), 7: (5, 1, "\n\n\n"), None: (2, 0, "first of all\nx")}
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in found.collect()} == want


def largest_batch(spark) -> int:
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("text"))
    return texts.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_batches_to_python_hold_bounded_bytes(spark, data):
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_repeated_lines, corpus_pipeline.drop_near_copies, corpus_pipeline.pack_sequences):
        own = spark.newSession()
        docs = own.read.parquet(f"{data}/documents.parquet").limit(5)
        stage(own, docs, data)
        assert largest_batch(own) < 1.1 * common.SLICE_BYTES
    own = spark.newSession()
    own.conf.set(common.BATCH_BYTES, "32m")
    common.small_batches(own)  # what the session names stays
    assert largest_batch(own) > 2 * common.SLICE_BYTES


def test_the_tokenizers_library_is_loaded_where_a_text_needs_it():
    packing.library.cache_clear()
    encode = packing.encoder(vocabulary())
    assert encode("plain words") and packing.library.cache_info().currsize == 0
    odd = f"a{packing.SPECIAL}b" + " " * packing.RUN
    assert encode(odd) == packing.library(vocabulary()).encode(odd, add_special_tokens=False).ids
