"""Spelling variants against all pairs, and the signatures they rest on."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from aislecast.llm import spellings

DOC = "doc_id long, text string, word string, n string, form string"


def frame(spark, texts):
    """Documents with these texts, and columns whose names the operator uses too."""
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOC)


def plain_near(a, b):
    """One edit apart, by trying every edit that shortens or replaces."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(texts):
    totals = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            totals[run] += 1
    n = {w: c for w, c in totals.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and plain_near(v, w)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    rows = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows[w] = (form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None)
    return rows


def found_rows(frame_, **sizes):
    rows = spellings.spelling_variants(frame_, **sizes).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def made_texts(seed=1):
    """Words of a few syllables, so that many are anagrams or near, with odd rows among them."""
    rng = random.Random(seed)
    syllables = ["en", "er", "ein", "ne", "re", "é", "ée", "ß", "aa", "a", "ÿ", "ou"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randint(3, 6))) for _ in range(150)]
    for word in [rng.choice(words) for _ in range(450)]:
        at, letter = rng.randrange(len(word)), rng.choice("aenrßé")
        words.append(rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]]))
    texts = [(i, " ".join(rng.choice(words) for _ in range(80))) for i in range(60)]
    chain = ["abcdefghijk"] * 2 + ["abcdefghijx"] * 20 + ["abcdefghiyx"] * 200 + ["ABCDEFGHIzyx"] * 2000
    ties = ["mmmmmmma"] * 30 + ["mmmmmmmb"] * 30 + ["mmmmmmmc"] * 3
    long = ["q" * 50_000 + "r", "q" * 50_000 + "s"] * 2
    odd = ["×÷×÷×÷×÷ ÀÉÎÕÜÿÿÿ ÀÉÎÕÜÿÿ " * 2, "wordword1wordwordé_wordwordé" * 3, "", None, "\n\t", "short"]
    extra = [" ".join(chain), " ".join(ties), " ".join(long), *odd]
    texts += [(1000 + i, t) for i, t in enumerate(extra)] + [(3, texts[3][1])] * 2 + [(None, texts[4][1])]
    return texts


@pytest.mark.parametrize("sizes", [{}, {"bucket_rows": 3, "chunk_rows": 2}])
def test_variants_equal_all_pairs(spark, sizes):
    texts = made_texts()
    expected = plain_variants(texts)
    assert sum(r[3] for r in expected.values()) > 500
    assert expected["mmmmmmmc"][0] == "mmmmmmma" and expected["abcdefghijk"][1] == "abcdefghizyx"
    assert found_rows(frame(spark, texts), **sizes) == expected


def test_no_rows_no_words(spark):
    assert found_rows(frame(spark, [])) == {}
    assert found_rows(frame(spark, [(1, None), (None, None), (2, "")])) == {}


def test_near_words_share_a_signature():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 12)))
        at, letter = rng.randrange(len(word)), rng.choice("abcdeéx")
        other = rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
        a, b = spellings.Letters([word, other]).signatures()
        assert (a == b).any()
        assert spellings.near(word, other) == (word != other)


def test_remainders_are_hashes_of_the_shorter_words():
    whole, left = spellings.Letters(["abcdefgh"]).remainders()
    shorter = ["abcdefgh"[:i] + "abcdefgh"[i + 1 :] for i in range(8)]
    assert np.array_equal(spellings.Letters(shorter).remainders()[0], left)
    assert whole[0] not in left
