"""The n-gram Jaccard join against all pairs, and the list search it rests on."""

import random

import numpy as np
import pytest

from aislecast.llm import overlap_join
from aislecast.llm.divide_skip import InvertedLists, needed

DOC = "doc_id long, text string, n string, component_id string, set string"


def frame(spark, rows):
    """Documents, and columns whose names the operator uses too."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOC)


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain_join(rows, percent=85):
    """Every pair of rows compared, rows of one id being one document."""
    top = {i: i for i, _ in rows if i is not None}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    sets = [(i, plain_set(t)) for i, t in rows]
    for at, (a, one) in enumerate(sets):
        for b, two in sets[:at]:
            if None not in (a, b) and one and two and 100 * len(one & two) >= percent * len(one | two):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def made_rows(seed, copies=12):
    """Near copies in chains around the threshold, a passage that many share, and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    rows, number = [], 0
    for _ in range(14):
        base = [word() for _ in range(rng.choice([5, 12, 30, 80]))]
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                base = text
            rows.append((number, rng.choice([" ", "\n", "\t "]).join(text).upper()))
            number += 1
    for _ in range(30):
        rows.append((number, " ".join(passage + [word() for _ in range(rng.choice([3, 8, 30]))])))
        number += 1
    odd = [None, "", " \n", "One", "one", "one two", "ONE two", "é É", "É É", "a b c d", "a b c d e"]
    rows += [(number + i, t) for i, t in enumerate(odd)]
    return rows + [(None, rows[0][1]), (None, None), rows[3], rows[3], (rows[0][0], rows[-20][1]), (rows[5][0], "")]


@pytest.mark.parametrize("sizes", [{}, {"most": 2}, {"most": 2, "levels": 1}])
def test_components_equal_all_pairs(spark, sizes, monkeypatch):
    if "levels" in sizes:
        monkeypatch.setattr(overlap_join, "BLOCK_TOKENS", 100)
        monkeypatch.setattr(overlap_join, "VISITORS", 2)
        monkeypatch.setattr(overlap_join, "STARS", 0)
    rows = made_rows(len(sizes))
    found = sorted((tuple(r) for r in overlap_join.overlap_join(frame(spark, rows), **sizes).collect()), key=str)
    expected = plain_join(rows)
    assert found == expected
    assert len({c for _, _, c in expected}) < len(rows) - 30


def test_long_texts_and_no_rows(spark):
    words = [f"v{i}" for i in range(30_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[2_000:])), (3, " ".join(words[9_000:]))]
    assert sorted(tuple(r) for r in overlap_join.overlap_join(frame(spark, rows)).collect()) == [
        (1, 29_997, 1), (2, 27_997, 1), (3, 20_997, 3)
    ]
    assert overlap_join.overlap_join(frame(spark, [])).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_search_equals_all_pairs(percent):
    rng = np.random.default_rng(percent)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(80)]
    sets += [np.unique(np.r_[s[1:], 100]) for s in sets[:40]] + [np.arange(1), np.zeros(0, np.int64)]
    index = InvertedLists(sets)
    for query in sets:
        one = set(query.tolist())
        expected = [
            i for i, s in enumerate(sets)
            if one and len(s) and 100 * len(one & set(s.tolist())) >= percent * len(one | set(s.tolist()))
        ]
        assert list(index.search(query, percent)) == expected


def test_needed_overlap_is_exact():
    for a in range(1, 40):
        for b in range(1, 40):
            most = min(a, b)
            good = [c for c in range(most + 1) if 100 * c >= 85 * (a + b - c)]
            assert needed(a, b, 85) == (good[0] if good else needed(a, b, 85)) and (good or needed(a, b, 85) > most)
