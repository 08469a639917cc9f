"""Quality rules against plain Python; the SQL of the query is compared in test_llm.py with the others."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanwise.llm import quality_rules as q


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    text, w = text or "", words(text)
    size = sum(map(len, w))

    def grams(n):
        return [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]

    def inside(n):
        count = Counter(grams(n))
        return {j for i, g in enumerate(grams(n)) if count[g] > 1 for j in range(i, i + n)}

    lines = Counter(x for x in text.split("\n") if words(x))
    out = {
        "n_words": len(w), "word_chars": size, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": sum(lines.values()) - len(lines), "n_repeat_words": len(inside(8)),
        "dup_line_chars": sum((c - 1) * sum(map(len, words(x))) for x, c in lines.items()),
    }
    out |= {f"dup_{n}gram_chars": sum(len(w[i]) for i in inside(n)) for n in q.LENGTHS}
    out |= {f"top_{n}gram_chars": max((c * sum(map(len, g)) for g, c in Counter(grams(n)).items() if c > 1), default=0) for n in q.TOP}
    failed = len(w) < 20 or 100 * out["n_repeat_words"] > 30 * len(w)
    return out | {"base_failed": failed, "failed_rules": [c for c, p in q.LIMITS.items() if 100 * out[c] > p * size]}


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    found = [None, "", " \n\t ", "one", "a b\nA b\na b\na b \n\n\n", "é 日本 \u0000 x # $5 <b>", "x" * (3 << 19) + " y\nz", "word " * 20_000]
    for _ in range(120):
        vocabulary = [r.choice(["a", "Be", "çé", "日本", "x1,"]) + "m" * r.randrange(4) for _ in range(r.choice([2, 9, 60, 400]))]
        found.append("".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\n", "\t", "  "]) for _ in range(r.randrange(0, 260))))
    block = "the quick brown fox jumps over one lazy dog "
    found.append((block * 30_000)[: (1 << 20) + 77])  # words across the end of a block
    return found


def test_same_as_plain_python(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, row string")
    for r in q.measure(df).collect():
        want = plain(texts[r.doc_id])
        assert {k: r[k] for k in want} == want
        assert r.kept == (not want["base_failed"] and not want["failed_rules"])


def test_odd_rows(spark):
    good = " ".join(f"w{k}" for k in range(40))
    rows = [(1, good, "s"), (1, good, "s"), (None, good, None), (2, None, None), (3, "", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"kept": F.lit("x"), "whole": F.lit(1), "n_words": F.lit(None).cast("int")})
    kept = q.keep_good(df)
    assert kept.schema == df.schema and sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, good, "s", "x", 1, None)] * 2 + [(None, good, None, "x", 1, None)], key=repr)
    assert q.keep_good(df.limit(0)).count() == 0 and q.measure(df.limit(0)).count() == 0
