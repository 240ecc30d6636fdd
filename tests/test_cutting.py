"""Cutting texts to a budget, against a plain version."""

import re

from pyspark.sql import functions as F

from florilege.functions import cutting as CUT
from florilege.functions import frontmatter as FM

TEXTS = [
    "",
    "   ",
    "short",
    "First sentence is here. Second sentence follows it. Third sentence closes the paragraph with more words.",
    "x" * 600,
    "\n\n".join(f"Paragraph {i} explains one idea about how login sessions work in detail." for i in range(12)),
    "Intro paragraph.\n\n```js\n" + "const value = compute(a, b, c);\n" * 60 + "```\n\nOutro.",
    "```js\n" + "const value = compute(a, b, c);\n" * 60,
    "~~~\na ``` b\n" + "    deep = 1\n" * 30 + "~~~\nafter it\n# Head\nmore\n\t\n## Next\n" + "word " * 90,
    "# One\n\nA sentence here. Another one follows it.\n\n```py\nx = 1\ny = 2\n```\n\n## Two\n" + "word " * 300,
    "漢字" * 200 + "。 " + "かな" * 90,
    "line one\r\n\r\nline two is longer! Yes? No.\r\n" * 20,
    "a.b " * 200,
    "Hmm... well. " * 50 + "\n\n\n" + "tail " * 40,
    "one two three four. " * 40,
    "line\n" * 4000,
]


def plain_blocks(text):
    out, own, sign = [], [], ""
    for line in text.split("\n"):
        m = re.match(r"\s{0,3}(```|~~~)", line)
        if m and not sign:
            out.append(own)
            own, sign = [line], m[1][0]
        elif m and m[1][0] == sign:
            out.append([*own, line])
            own, sign = [], ""
        elif sign:
            own.append(line)
        elif not line.strip():
            out.append(own)
            own = []
        elif re.match(r"#{1,6}\s", line):
            out.append(own)
            own = [line]
        else:
            own.append(line)
    return [b for b in ("\n".join(x).strip() for x in [*out, own]) if b] or [text]


def plain_closed(text):
    sign = ""
    for line in text.split("\n"):
        m = re.match(r"\s{0,3}(```|~~~)", line)
        if m:
            sign = m[1][0] if not sign else "" if sign == m[1][0] else sign
    return f"{text}\n{sign * 3}" if sign else text


def plain_cut(text, budget):
    if budget <= 0 or FM.estimate(text) <= budget:
        return text if budget > 0 else ""
    parts = plain_blocks(text)
    for pieces, by in ((parts, "\n\n"), (re.split(r"(?<=[.!?])\s+", parts[0]), " ")):
        costs = [FM.estimate(p) for p in pieces]
        n = max(i for i in range(len(pieces) + 1) if sum(costs[:i]) <= budget)
        if n:
            return plain_closed(by.join(pieces[:n]).rstrip())
    return plain_closed(text[: max(1, budget * len(text) // max(1, FM.estimate(text)))].rstrip())


def plain_fit(text, budget):
    target = budget
    for _ in range(9):
        if (n := FM.estimate(out := plain_cut(text, target))) <= budget:
            return out, n
        target = target * 9 // 10
        if target < 1:
            break
    return None, None


def test_cuts_like_the_plain_version(spark):
    cases = [(t, b) for t in TEXTS for b in (-5, 0, 1, 2, 3, 7, 12, 20, 40, 60, 100, 250, 5000)]
    df = spark.createDataFrame(cases, "text string, budget int")
    found = df.select("text", "budget", CUT.blocks(F.col("text")).alias("blocks"), CUT.truncated(F.col("text"), F.col("budget")).alias("cut"), CUT.fitted(F.col("text"), F.col("budget")).alias("fit")).collect()
    assert len(found) == len(cases)
    for r in found:
        assert r.blocks == plain_blocks(r.text), r.text
        assert r.cut == plain_cut(r.text, r.budget), (r.text, r.budget)
        want = plain_fit(r.text, r.budget) if r.budget > 0 else ("", 0)
        assert tuple(r.fit) == want, (r.text, r.budget)
        if r.fit.text is not None and r.budget > 0:
            assert FM.estimate(r.fit.text) == r.fit.tokens <= r.budget
    assert spark.createDataFrame([(None, 3), ("a", None)], "text string, budget int").select(CUT.fitted(F.col("text"), F.col("budget")).alias("f")).collect() == [(None,), (None,)]


def test_cuts_keep_their_promises(spark):
    """A cut ends where a paragraph or a sentence ends, and leaves no fence open."""
    long = TEXTS[5]
    rows = [(long, FM.estimate(long) // 2), (TEXTS[3], 12), (TEXTS[4], 20), (TEXTS[6], 40)]
    a, b, c, d = [r.cut for r in spark.createDataFrame(rows, "text string, budget int").select(CUT.truncated(F.col("text"), F.col("budget")).alias("cut")).collect()]
    assert long.startswith(a) and a.endswith("detail.") and FM.estimate(a) <= rows[0][1]
    assert TEXTS[3].startswith(b) and b.endswith(".") and FM.estimate(b) <= 12
    assert 0 < len(c) < 600 and d.count("```") % 2 == 0
