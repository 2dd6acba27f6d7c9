"""Central sentences against a walk over all pairs of sentences."""

import math
import random
import re
import time

import pytest

from mercato.plans import summary


def plain(parts):
    """Shares by a matrix of all pairs."""
    n = len(parts)
    words = [re.findall(r"[^\W_]+", p.lower()) for p in parts]
    held = {w: sum(w in x for x in words) for x in words for w in x}
    vectors = []
    for x in words:
        v = {w: x.count(w) * math.log(1 + n / held[w]) for w in set(x)}
        size = math.sqrt(sum(a * a for a in v.values()))
        vectors.append({w: a / size for w, a in v.items()})
    near = [[sum(a * y.get(w, 0) for w, a in x.items()) for y in vectors] for x in vectors]
    share = [1 / n] * n
    for _ in range(summary.STEPS):
        lost = sum(s for s, row in zip(share, near) if not sum(row)) / n
        share = [(1 - summary.STAY) / n + summary.STAY * (lost + sum(share[j] * near[j][i] / sum(near[j]) for j in range(n) if sum(near[j]))) for i in range(n)]
    return share


def test_shares_as_by_all_pairs():
    rng = random.Random(3)
    for _ in range(40):
        parts = [" ".join(f"w{int(rng.paretovariate(0.8))}" for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 25))]
        parts += ["...", "!!"][: rng.randint(0, 2)]
        assert list(summary.centrality(parts)) == pytest.approx(plain(parts), abs=1e-12)


def test_the_sentence_that_speaks_of_all_is_central():
    text = "Cats sleep.\nDogs and cats and birds sleep here.  Birds fly! Who knows the price of tea?\nDogs bark."
    assert summary.sentences(text) == ["Cats sleep.", "Dogs and cats and birds sleep here.", "Birds fly!", "Who knows the price of tea?", "Dogs bark."]
    assert "Dogs and cats and birds sleep here." in summary.central(text, 1)
    assert summary.central(text, 9) == " ".join(summary.sentences(text))
    # Equals: the first ones, in their order.
    assert summary.central("b a. a b. a b. b a.", 2) == "b a. a b."


def test_thousands_of_sentences_take_time_in_proportion():
    start = time.time()
    summary.central(". ".join(f"the word {i % 50} of {i}" for i in range(20_000)), 2)
    assert time.time() - start < 10


def test_rows_keep_their_columns(spark):
    rows = [(1, "One cat. Two cats. A dog. Two cats and one cat.", "x"), (2, None, None), (3, "", "y"), (3, "...", "y"), (1, "One. ", "x")]
    chunks = spark.createDataFrame(rows, "id long, text string, `a.b` string").repartition(2)
    found = summary.central_summary(chunks)
    assert found.columns == ["id", "text", "a.b", "summary"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, t, x, summary.central(t, 2)) for i, t, x in rows), key=repr)
    assert summary.central_summary(chunks.where("false")).collect() == []
