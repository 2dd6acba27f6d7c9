"""Spelling variants against comparing all pairs of words."""

import collections
import random

import pytest

from mercato.llm import spelling as op


def near(a, b):
    """One letter replaced, added or left out, tried out."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least_length=6, least_count=5, ratio=5):
    total = collections.Counter()
    for word, n in counts:
        if word is not None and len(word) >= least_length:
            total[word] += n
    words = {w: n for w, n in total.items() if n >= least_count}
    forms, out = {}, []
    for w in words:
        others = [o for o in words if near(w, o)]
        best = min(others, key=lambda o: (-words[o], o), default=None)
        strong = best is not None and words[best] >= ratio * words[w]
        forms[w] = best if strong else None
        out.append([w, forms[w], None, words[w], len(others), words[best] if strong else None])
    for row in out:
        root = row[0]
        while forms[root] is not None:
            root = forms[root]
        row[2] = root
    return sorted(map(tuple, out))


def changed(rng, word, letters):
    kind, i = rng.randrange(3), rng.randrange(len(word))
    if kind == 0:
        return word[:i] + rng.choice([c for c in letters if c != word[i]]) + word[i + 1 :]
    if kind == 1:
        return word[:i] + word[i + 1 :]
    i = rng.randrange(len(word) + 1)
    return word[:i] + rng.choice(letters) + word[i:]


def vocabulary(seed, letters="abcdefghijklmnop", size=150, low=6, high=15):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(size)]
    rows = [(w, 10 ** rng.randint(1, 6)) for w in words]
    for w in words:
        for _ in range(rng.randint(0, 6)):
            w = changed(rng, w, letters) if rng.random() < 0.9 else w
            rows.append((w, rng.randint(1, 400)))
            if len(w) <= low:
                break
    return rows


CASES = {
    "many letters": vocabulary(1), "few letters": vocabulary(2, "ab", 80, 6, 9), "long": vocabulary(3, "abcé", 60, 10, 40),
    "one family": [("same" * 3 + a + b + "tail", 10 + i * j) for i, a in enumerate("abcdefghijkl") for j, b in enumerate("mnopqrstuvwx")],
    "unary": [("a" * n, 7 ** (n % 9)) for n in range(4, 60)],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("share, block", [(op.SHARE, op.BLOCK), (0.02, 7), (1.0, 1)])
def test_groups_as_by_all_pairs(spark, case, share, block):
    rows = CASES[case]
    counts = spark.createDataFrame(rows, "word string, n long").repartition(4)
    found = op.spelling_groups(counts, share=share, block=block)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_words_with_an_edit_share_a_list():
    rng = random.Random(9)
    for trial in range(150):
        letters = "abcdefgh"[: rng.choice([2, 3, 8])]
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 14))) for _ in range(40)]
        counted = collections.Counter(w[i : i + n] for w in words for n in range(op.SHORT, op.LONG) for i in range(len(w) - n + 1))
        frequent = {g: n for g, n in counted.items() if n > rng.choice([1, 2, 6])}
        # A gram may only be prolonged when its beginnings are.
        frequent = {g: n for g, n in frequent.items() if all(g[:k] in frequent for k in range(op.SHORT, len(g)))}
        for word in words:
            other = changed(rng, word, letters)
            if len(other) < 4 or other == word:
                continue
            short, long = sorted((word, other), key=len)
            dictionary, more = op.GramDictionary(frequent, op.longest_gram(len(short))), len(long) > len(short)
            mine = {(g, p) for p, g in dictionary.rarest(short, False)}
            yours = {(g, p - back) for p, g in dictionary.rarest(long, more) for back in range(more + 1)}
            assert mine & yours
            # The bound never reaches all grams: no word has to be compared with all others.
            assert len(mine) <= len(dictionary.grams(short))


def test_odd_tables(spark):
    schema = "word string, n long, form string, Root int, `a.b` map<string,int>"
    rows = [(None, 9, "x", 1, None), ("parcel", 3, None, None, {"k": 1}), ("parcel", 2, None, None, None), ("parcels", 60, "y", 2, None),
            ("", 50, None, None, None), ("parse", 99, None, None, None), ("Parcel", None, None, None, None)]
    found = op.spelling_groups(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, found.collect())) == [("parcel", "parcels", "parcels", 5, 1, 60), ("parcels", None, "parcels", 60, 1, None)]
    assert op.spelling_groups(spark.createDataFrame([], "word string, n long")).collect() == []
    with pytest.raises(ValueError):
        op.near_words(spark.createDataFrame([("abc", 9)], "word string, n long"), least=3)


def test_words_of_texts(spark):
    docs = spark.createDataFrame(
        [(1, "Größe, GRÖSSE größe x1y"), (2, None), (3, ""), (3, "ab " * 5000)], "doc_id long, text string")
    found = {r["word"]: r["n"] for r in op.word_counts(docs, "[A-Za-zÀ-ÿ]+").collect()}
    assert found == {"größe": 2, "grÖsse": 1, "x": 1, "y": 1, "ab": 5000}
    assert op.word_counts(docs.where("false"), "[a-z]+").collect() == []
