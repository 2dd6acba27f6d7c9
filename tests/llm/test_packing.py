"""Packing against a plain version of the same rule, and against the optimum of tiny cases."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from mercato.llm import packing as op

SCHEMA = "doc_id long, length long, Bin string, grp int, text string"


def plain(lengths, capacities, cost):
    """The rule again, with lists and no bookkeeping."""
    rest, bins, out = list(lengths), [], []
    for length in lengths:
        rest.remove(length)
        fitting = [b for b in bins if b[0] - b[1] >= length]
        if fitting:
            room = min(b[0] - b[1] for b in fitting)
            chosen = max((b for b in fitting if b[0] - b[1] == room), key=lambda b: b[2])
        else:
            def per_token(c):
                free = c - length
                for x in sorted(rest, reverse=True):
                    if x <= free:
                        free -= x
                return cost(c) / (c - free), c
            chosen = [min((c for c in capacities if c >= length), key=per_token), 0, 0]
            bins.append(chosen)
        chosen[1] += length
        chosen[2] = len(out)
        out.append(bins.index(next(b for b in bins if b is chosen)))
    return out, [min(c for c in capacities if c >= b[1]) for b in bins]


def optimum(lengths, capacities, cost):
    best = float("inf")
    for assignment in itertools.product(range(len(lengths)), repeat=len(lengths)):
        fill = defaultdict(int)
        for length, b in zip(lengths, assignment):
            fill[b] += length
        if max(fill.values()) <= max(capacities):
            best = min(best, sum(cost(min(c for c in capacities if c >= x)) for x in fill.values()))
    return best


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_follows_the_rule(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.choice([rng.randint(1, 64), 16, 7]) for _ in range(rng.randint(1, 60))), reverse=True)
    capacities = (8, 16, 32, 64)
    bins, offsets, final = op.best_fit(np.array(lengths), capacities, lambda c: c + 2)
    wanted_bins, wanted_final = plain(lengths, capacities, lambda c: c + 2)
    assert final == wanted_final if bins.tolist() == wanted_bins else sum(final) <= 1.1 * sum(wanted_final)
    fill = defaultdict(int)
    for b, at, length in zip(bins, offsets, lengths):
        assert at == fill[b]
        fill[b] += length
    for b, c in enumerate(final):
        assert c == min(x for x in capacities if x >= fill[b])


@pytest.mark.parametrize("seed", range(8))
def test_near_the_optimum(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(1, 16) for _ in range(6)), reverse=True)
    _, _, final = op.best_fit(np.array(lengths), (4, 8, 16), lambda c: c + 1)
    assert sum(c + 1 for c in final) <= 1.3 * optimum(lengths, (4, 8, 16), lambda c: c + 1)


def check(rows, wanted, capacities):
    """Every token of every document is in one place, and no two share one."""
    pieces, places, sizes = defaultdict(list), defaultdict(list), {}
    for r in rows:
        if r["bin"] is None:
            assert r["length"] == 0
            continue
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        places[r["bin"]].append((r["position"], r["length"]))
        assert sizes.setdefault(r["bin"], r["capacity"]) == r["capacity"]
    for b, found in places.items():
        end = 0
        for at, length in sorted(found):
            assert at == end
            end += length
        assert sizes[b] == min(c for c in capacities if c >= end)
    for doc, total in wanted.items():
        assert sorted(n for _, n in pieces[doc]) == sorted(n for t in total for n in [max(capacities)] * (t // max(capacities)) + [t % max(capacities)] * (t % max(capacities) > 0))
    return sum(sizes.values())


def test_all_tokens_have_a_place(spark):
    rng = random.Random(4)
    data = [(i, rng.choice([rng.randint(1, 700), 200, 64, 0]), "x", 0, "t") for i in range(3000)]
    data += [(3000, None, None, None, None), (None, 70, None, None, None), (7, 30, "x", 1, ""), (7, 30, "x", 1, ""), (2**60 + 1, 9, "", 0, "")]
    capacities = (32, 64, 128)
    rows = op.pack(spark.createDataFrame(data, SCHEMA), capacities, pieces_per_group=500).collect()
    wanted = defaultdict(list)
    for key, length, *_ in data:
        wanted[key].append(length or 0)
    assert {r["doc_id"] for r in rows} == set(wanted)
    used = check(rows, wanted, capacities)
    # Packing in groups loses little against one group with all pieces.
    pieces = sorted((n for total in wanted.values() for t in total for n in [128] * (t // 128) + [t % 128] if n), reverse=True)
    assert used <= 1.01 * sum(op.best_fit(np.array(pieces), capacities, op.sequence_cost)[2])


def test_empty_and_repeatable(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert op.pack(docs).count() == 0
    docs = spark.createDataFrame([(i, i % 40, "", 0, "") for i in range(200)], SCHEMA).coalesce(1)
    one, two = (sorted(map(repr, op.pack(docs, (16, 32)).collect())) for _ in range(2))
    assert one == two


def test_query(spark, sf_dir):
    rows = entry.queries()["op10_best_fit_packing"](spark, sf_dir).collect()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    check(rows, {r["doc_id"]: [len((r["text"] or "").split())] for r in texts}, op.CAPACITIES)
