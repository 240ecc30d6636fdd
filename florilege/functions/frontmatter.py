"""Front matter: split, parse, validate, write; and cutting a text to a budget.

Splitting and lookups are Column expressions. Parsing, writing and cutting fold over lines, so they
run as pandas functions over whole batches.
"""

from __future__ import annotations

import json
import re
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.dims import FRONT_FIELDS, KIND_WEIGHT

SPEC_VERSION = 1
BLOCK = r"(?s)^﻿?---[ \t\f\x0B]*\r?\n(.*?)(?<=\n)(?:---|\.\.\.)[ \t\f\x0B]*\r?(?:\n(.*))?\z"
_KEY = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)\s*:(?:\s+(.*))?$")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_SLUG = re.compile(r"[a-z0-9][a-z0-9-]*")
_WORDS = {"~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def split(docs: DataFrame) -> DataFrame:
    """Adds has_fm, block (the lines between the fences) and body to docs(raw)."""
    opened = F.col("raw").rlike(BLOCK)
    clean = F.regexp_replace("raw", "^﻿", "")
    body = F.regexp_replace(F.replace(F.regexp_extract("raw", BLOCK, 2), F.lit("\r\n"), F.lit("\n")), r"^\n+", "")
    block = F.replace(F.regexp_extract("raw", BLOCK, 1), F.lit("\r\n"), F.lit("\n"))
    return docs.withColumns({"has_fm": opened, "block": F.when(opened, block).otherwise(""), "body": F.when(opened, body).otherwise(clean)})


def _outside(text: str, brackets: bool = True):
    """(index, char, bracket depth) of characters that no quotes hold."""
    quote, depth = "", 0
    for i, ch in enumerate(text):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        else:
            depth += brackets * ((ch in "[{") - (ch in "]}"))
            yield i, ch, depth


def _uncommented(text: str) -> str:
    cut = next((i for i, ch, _ in _outside(text, False) if ch == "#" and (not i or text[i - 1].isspace())), len(text))
    return text[:cut]


def _items(inner: str) -> list[str]:
    cuts = [-1, *(i for i, ch, depth in _outside(inner) if ch == "," and not depth), len(inner)]
    return [x for a, b in zip(cuts, cuts[1:], strict=False) if (x := inner[a + 1 : b].strip())]


def scalar(text: str):
    """Value of one line's text: string, number, boolean, null, list or one-level mapping."""
    text = _uncommented(text).strip()
    ends = text[:1] + text[-1:] if len(text) > 1 else ""
    if ends == '""':
        return re.sub(r'\\(["\\/nrt])', lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1])
    if ends == "''":
        return text[1:-1].replace("''", "'")
    if ends == "[]":
        return [scalar(x) for x in _items(text[1:-1])]
    if ends == "{}":
        halves = [x.partition(":") for x in _items(text[1:-1])]
        return {k.strip().strip("'\""): scalar(v) for k, colon, v in halves if colon and k.strip().strip("'\"")}
    if not text or text in _WORDS:
        return _WORDS.get(text)
    if _NUMBER.fullmatch(text):
        return float(text) if "." in text else int(text)
    return text


def parse(block: str) -> dict:
    """Mapping of a block's top-level keys; lines that make no sense are passed over."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in block.replace("\t", "  ").split("\n")]
    lines = [(indent, x) for indent, x in lines if x and x[0] != "#"]
    out, at = {}, 0
    while at < len(lines):
        indent, text = lines[at]
        at += 1
        m = _KEY.match(text)
        if indent or not m:
            continue
        rest = (m[2] or "").strip()
        if rest and rest[0] != "#":
            out[m[1]] = scalar(rest)
            continue
        listed, mapped = [], {}
        while at < len(lines):
            indent, text = lines[at]
            item = text == "-" or text.startswith("- ")
            pair = None if item else _KEY.match(text)
            if (item and mapped) or (not item and not indent) or (pair and listed):
                break
            if item:
                listed.append(scalar(text[1:].strip()))
            elif pair:
                value = (pair[2] or "").strip()
                mapped[pair[1]] = scalar(value) if value and value[0] != "#" else None
            at += 1
        out[m[1]] = listed or mapped or None
    return out


def _shown(value) -> str:
    return f"'{value}'" if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _real_date(text: str) -> bool:
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


def _strings(value) -> list[str] | None:
    if isinstance(value, str):
        return [value]
    return value if isinstance(value, list) and all(isinstance(x, str) for x in value) else None


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def validate(data: dict) -> tuple[list[str], list[str], dict]:
    """(errors, warnings, the fields that can be used)."""
    errors, warnings, value = [], [], {}
    rules = {
        "spec": (_is_number, f"a number (expected {SPEC_VERSION})"),
        "id": (lambda x: isinstance(x, str) and bool(_SLUG.fullmatch(x)), "a slug of lower-case letters, digits and hyphens"),
        "kind": (lambda x: x in KIND_WEIGHT if isinstance(x, str) else False, f"one of {', '.join(sorted(KIND_WEIGHT))}"),
        "describes": (lambda x: _strings(x) is not None, "a list of globs"),
        "verify": (lambda x: isinstance(x, str), "a string"),
        "owner": (lambda x: isinstance(x, str), "a string"),
        "expires": (lambda x: isinstance(x, str) and _real_date(x), "a date YYYY-MM-DD"),
        "ttlDays": (lambda x: _is_number(x) and x > 0 and x == int(x), "a positive whole number of days"),
        "supersedes": (lambda x: _strings(x) is not None, "a list of ids"),
        "tags": (lambda x: _strings(x) is not None, "a list of strings"),
        "pin": (lambda x: isinstance(x, bool), "true or false"),
    }
    for name, (good, wanted) in rules.items():
        if name not in data:
            continue
        own = data[name]
        if not good(own):
            errors.append(f"{name}: {_shown(own)} is not {wanted}")
            continue
        if name in ("describes", "supersedes", "tags"):
            if isinstance(own, str):
                warnings.append(f"{name}: a list was expected")
            own = [x for x in _strings(own) if x.strip()]
        value[name] = own
    if "id" not in data:
        (errors if "spec" in data else warnings).append("id: missing")
    if value.get("spec", 0) > SPEC_VERSION:
        warnings.append("spec: newer than understood")
    if value.get("describes") == []:
        warnings.append("describes: empty, so nothing can be checked")
    if "expires" in value and "ttlDays" in value:
        warnings.append("expires and ttlDays are both set")
    warnings += [f"supersedes: '{x}' is no id" for x in value.get("supersedes", []) if not _SLUG.fullmatch(x)]
    for key in data:
        if key not in rules and (near := next((k for k in FRONT_FIELDS if near_miss(k, key)), None)):
            warnings.append(f"{key}: unknown, did you mean {near}?")
    return errors, warnings, value


def near_miss(a: str, b: str) -> bool:
    """Are two names equal but for case, or one letter apart?"""
    if a.lower() == b.lower():
        return True
    short, long = sorted((a.lower(), b.lower()), key=len)
    if len(long) - len(short) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    return short[at + (len(short) == len(long)) :] == long[at + 1 :]


PARSED = "struct<fields:map<string,string>,errors:array<string>,warnings:array<string>,usable:string>"


def _parsed(block: pd.Series) -> pd.DataFrame:
    out = []
    for b in block.fillna(""):
        data = parse(b)
        errors, warnings, usable = validate(data)
        text = {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in data.items()}
        out.append((text, errors, warnings, json.dumps(usable, ensure_ascii=False)))
    return pd.DataFrame(out, columns=["fields", "errors", "warnings", "usable"])


def fields(docs: DataFrame) -> DataFrame:
    """Adds fields (name to text, lists as JSON), errors, warnings and usable (JSON) to docs(block)."""
    return docs.withColumn("_p", F.pandas_udf(_parsed, PARSED)("block")).select("*", "_p.*").drop("_p")


def near_field(word: Column) -> Column:
    """The first known field that a word equals but for case or one letter; null for known ones."""
    known = F.array(*map(F.lit, FRONT_FIELDS))
    close = F.filter(known, lambda k: F.levenshtein(F.lower(k), F.lower(word)) <= 1)
    return F.when(~word.isin(*FRONT_FIELDS), F.get(close, F.lit(0)))


def suggest(word: Column, options: tuple[str, ...]) -> Column:
    """The nearest option by edit distance, if it is near enough."""
    scored = F.array(*[F.struct(F.levenshtein(F.lower(word), F.lit(o)).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o")) for i, o in enumerate(options)])
    best = F.array_min(scored)
    return F.when(best["d"] <= F.greatest(F.lit(2), F.floor(F.length(word) / 2)), best["o"])


# writing


def _quoted(text: str) -> str:
    risky = (
        text != text.strip() or not text or text[0] in "-?:,[]{}#&*!|>'\"%@`" or re.search(r":\s|\s#|[\n\r]", text) or text[-1] == ":" or _NUMBER.fullmatch(text) or text in _WORDS
    )
    if not risky:
        return text
    if re.search(r"[\n\r]", text):
        return json.dumps(text, ensure_ascii=False)
    return "'" + text.replace("'", "''") + "'"


def _written(value) -> str:
    if isinstance(value, bool) or value is None:
        return {True: "true", False: "false", None: "null"}[value]
    if isinstance(value, list):
        return f"[{', '.join(map(_written, value))}]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_written(v)}" for k, v in value.items()) + "}"
    return _quoted(value) if isinstance(value, str) else str(value)


def write(data: dict, body: str) -> str:
    """Front matter and body of a file; what `parse` reads from it is the same data."""
    known = [k for k in FRONT_FIELDS if k in data]
    lines = []
    for key in known + sorted(k for k in data if k not in FRONT_FIELDS and re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]*", k)):
        value = data[key]
        if isinstance(value, list) and value:
            items = [_written(x) for x in value]
            inline = f"{key}: [{', '.join(items)}]"
            plain = all(re.fullmatch(r"[^'\"\[\]{},#\s]+", x) for x in items)
            lines += [inline] if plain and len(inline) <= 78 else [f"{key}:", *(f"  - {x}" for x in items)]
        else:
            lines.append(f"{key}: {_written(value)}")
    return "---\n" + "\n".join(lines) + "\n---\n\n" + re.sub(r"^\n+", "", body)


def written(data: Column, body: Column) -> Column:
    """`write` of fields given as JSON text, one document a row."""
    return F.pandas_udf(_all_written, "string")(data, body)


def _all_written(data: pd.Series, body: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or b is None else write(json.loads(d), b) for d, b in zip(data, body, strict=True)])


# the plain token estimate

_FENCE = re.compile(r"\s{0,3}(`{3,}|~{3,})")
_RUN = re.compile("(?P<cjk>[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯])|(?P<word>[A-Za-z0-9À-ɏ]+)|(?P<sign>[^ \\t\\n\\rA-Za-z0-9À-ɏ぀-ヿ㐀-䶿一-鿿豈-﫿가-힯]+)")


def _segments(text: str):
    """(lines, is code) runs of a text; a fence of the same sign closes."""
    run, sign = [], ""
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if m and not sign:
            if run:
                yield run, False
            run, sign = [line], m[1][0]
        elif m and m[1][0] == sign:
            yield [*run, line], True
            run, sign = [], ""
        else:
            run.append(line)
    if run:
        yield run, bool(sign)


def estimate(text: str) -> int:
    """The plain version of `text.token_estimate`."""
    if not text.strip():
        return 0
    tenths = 0
    for lines, code in _segments(text):
        part, size = "\n".join(lines), 4 if code else 6
        for m in _RUN.finditer(part):
            tenths += 12 if m["cjk"] else 10 * -(-len(m[0]) // (size if m["word"] else 2))
        tenths += 5 * part.count("\n")
        if code:
            tenths += sum(10 * -(-len(re.match(r"[ \t]*", x)[0].replace("\t", "    ")) // 4) for x in lines)
    return max(1, (tenths + 5) // 10)


def demote_headings(text: Column, by: Column) -> Column:
    """Headings by some levels lower, six at most; code stays."""
    return F.pandas_udf(_demoted, "string")(text, by)


def _demoted(text: pd.Series, by: pd.Series) -> pd.Series:

    def one(body: str, n: int) -> str:
        out, code = [], False
        for line in body.split("\n"):
            if re.match(r"\s*(```|~~~)", line):
                code = not code
            m = None if code else re.match(r"(#{1,6})(\s.*)", line)
            out.append("#" * min(6, len(m[1]) + n) + m[2] if m else line)
        return "\n".join(out)

    return pd.Series([None if t is None else one(t, int(n)) for t, n in zip(text, by, strict=True)])
