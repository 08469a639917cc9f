"""Collocations against plain Python; the SQL of the query is compared in test_llm.py with the others."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spanwise.llm import collocations as c


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, least, inside, first):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for p in pieces(text):
            total[lang or "und"] += len(p)
            counts[lang or "und"].update(tuple(p[i : i + n]) for n in range(1, 5) for i in range(len(p) - n + 1))
    out = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {p[i : i + n] for p, a in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1) if 100 * a >= inside * f[p[i : i + n]]}
        scored = []
        for p, a in candidates.items():
            if p not in covered:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, n + 1, p.decode(), -a, l, r, total[lang], -s) for n, (s, a, p, l, r) in enumerate(sorted(scored)[:first])}
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocabulary = ["of", "The", "the", "a", "san", "José", "日本", "new", "york", "x-1", *(f"w{k}" for k in range(40))]
    out = [(None, "en"), ("", None), (" .,\n", "en"), ("of the " * 9_000 + ". of", None)]
    for k in range(400):
        words = [r.choice(vocabulary[: r.choice([3, 10, 50])]) for _ in range(r.randrange(0, 60))]
        text = "".join(w + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  "]) for w in words)
        out.append((text + " in new york city " * (k % 3), r.choice(["en", "de", None, "und"])))
    return out + out[5:9]


@pytest.mark.parametrize("least, inside, first, budget, held", [(30, 80, 2000, 1 << 21, 1 << 21), (3, 60, 50, 40, 300), (8, 100, 10, 2500, 1000)])
def test_same_as_plain_python(spark, rows, least, inside, first, budget, held):
    """With small budgets prefixes of one, two and three words are replaced, and groups are many."""
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS key", "'x' AS phrase", "2 AS c").repartition(5)
    got = c.mine(df, least=least, inside=inside, first=first, budget=budget, held=held).collect()
    assert {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got} == plain(rows, least, inside, first)
    assert len(got) == len({(r.lang, r["rank"]) for r in got})


def test_empty_and_without_phrases(spark, rows):
    df = spark.createDataFrame(rows[:3], "text string, lang string")
    assert c.mine(df.limit(0)).count() == 0 and c.mine(df).count() == 0


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_blocks_of_long_texts(rows, size):
    """Where a text is cut into blocks, suffixes go on over the cut."""

    def total(size, held):
        salts, out = np.arange(len(rows), dtype=np.uint64), Counter()
        for words, n in c.suffixes(c.words_of([t for t, _ in rows], salts, size), None, held):
            for *key, k in zip(*words, n.tolist(), strict=True):
                out[tuple(map(int, key))] += k
        return out

    assert total(size, 5000) == total(1 << 20, 1 << 20)
