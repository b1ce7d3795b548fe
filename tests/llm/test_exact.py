"""Exact duplicates, the trie of conversations and hard negatives, each against a plain version."""

import hashlib
import math
import random

import pytest
from kinfold.llm import common, exact, hardneg, trie
from pyspark.sql import functions as F

# ---- exact duplicates


def plain_groups(rows):
    """Of (doc_id, text): (doc_id, keep_id, size, kept) as a sorted list; rows of one id and size stand for each other."""
    by = {}
    for i, (d, t) in enumerate(rows):
        by.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"), []).append((-len(t or ""), d is None, d or 0, i, d))
    out = []
    for key, group in by.items():
        first = min(group)
        out += [(g[4], first[4], len(group), g is first, hashlib.sha256(key.encode()).hexdigest()) for g in group]
    return sorted(out, key=str)


def found_groups(spark, rows, **options):
    df = spark.createDataFrame([(d, t, "x", True, 7) for d, t in rows], "doc_id long, text string, sha256 string, kept boolean, bytes__ int").repartition(3)
    return exact.duplicates(df, **options)


@pytest.mark.parametrize("hot", [4096, 4])
def test_duplicates(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    head = "h" * 80
    more = [head + "aab", head + "aba", head + "a ba", " " + head + "aba\n", "ab", "a\x0bb", "a b", "a b", "a b", "ba", "\x85ab", "é" * 30, "é " * 30]
    rows = [*enumerate([*texts, *more]), (None, "a b"), (None, None), (3, "a  b"), (9999, "two\nwords")]
    got = sorted((tuple(r) for r in found_groups(spark, rows, all_digests=True).collect()), key=str)
    want = plain_groups(rows)
    assert [r[:3] for r in got] == [r[:3] for r in want] and sorted((r[3], r[4]) for r in got) == sorted((r[3], r[4]) for r in want)
    assert sum(r[3] for r in got) == len({r[4] for r in want})


def test_only_what_length_and_prefix_leave_is_hashed(spark, monkeypatch):
    head = "h" * 80
    rows = list(enumerate(["one", "of its length", "abc", "xbc", head + "ab", head + "ba", head + "ab", None]))
    hashed = {r.doc_id for r in found_groups(spark, rows).filter("sha256 is not null").collect()}
    assert hashed == {4, 5, 6}
    # with a single bit every key meets every other: more is hashed, the groups stay
    monkeypatch.setattr(exact, "MAP_ROWS", 1)
    monkeypatch.setattr(exact, "ROW_BITS", 1)
    got = found_groups(spark, rows)
    assert got.filter("sha256 is null").count() == 0
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got.collect()} == {i: (4, 2) if i in (4, 6) else (i, 1) for i in range(8)}


def test_a_third_of_the_rows_are_copies(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 64)
    rows = [(i, "the same copy" if i % 3 == 0 else f"text {i // 2}") for i in range(6000)]
    got = found_groups(spark, rows).groupBy("group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(2000, True, 1), (2000, False, 1999), (1, True, 2000), (2, True, 1000), (2, False, 1000)}


def test_no_documents(spark):
    assert found_groups(spark, []).count() == 0


def test_native_plan(spark):
    plan = found_groups(spark, [(1, "a"), (2, "a")], all_digests=True)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval", "MapInArrow"))


# ---- the trie


def plain_trie(convs):
    """Of {id: [(role, text)]}: the rows of the trie."""
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        sub = [k for k in nodes if k[: len(key)] == key]
        childless = lambda k: not any(len(x) == len(k) + 1 and x[: len(k)] == k for x in nodes)
        ends = sorted(c for c in members if len(convs[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in sub), sum(childless(k) for k in sub),
            sum((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0 for k in sub), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed=3):
    rng = random.Random(seed)
    convs = {}
    for i in range(150):
        convs[i * 3 - 30 if i != 5 else 10**12] = [(rng.choice("ua"), rng.choice(["hi", "é", "", "more text"])) for _ in range(rng.choice([1, 1, 2, 3, 5]))]
    for i in range(40):
        convs[10_000 + i * 997] = [("u", "shared"), ("a", "reply"), ("u", "end")][: 2 + i % 2]
    return convs


def as_rows(convs):
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [4096, 4])
def test_trie(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_KEYS", hot)
    monkeypatch.setattr(trie, "_OUT", 17)
    monkeypatch.setattr(trie, "ID_RANGE", 1000)
    convs = conversations()
    df = spark.createDataFrame([(*r, 1, b"x") for r in as_rows(convs)], "conv_id long, turn long, role string, text string, depth int, digest binary").repartition(3)
    got = trie.trie(trie.turn_lists(df).select("conv_id", "turns")).select(NAMES)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(convs)


def rebuilt(rows, every, lead):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256((x or "").encode()).digest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in own.items()}
    return {c: own.get(c - int(math.fmod(c, every)), [])[: lead(c)] + v[lead(c) :] for c, v in own.items()}


def test_grafted(spark):
    """Null numbers, roles and texts, equal numbers, repeated rows, heads that are short or absent, conversations left without turns."""
    rows = [(0, None, "u", "first"), (0, 0, "u", "a"), (0, 1, "a", None), (0, 1, "a", "b"), (0, 1, "a", "b"), (0, 7, None, "x"), (None, 0, "u", "nobody"), (305, 0, "u", "alone"), (-205, 1, "a", "z"), (-205, 0, "u", "y")]
    rows += [(c, t, "u", f"{c % 3} {t}") for c in (*range(1, 60, 7), 100, 150, 199) for t in range(c % 4 + 1)]
    lead = lambda c: abs(c) % 6
    want = rebuilt(rows, 100, lead)
    assert want[305] == [] and len(want[0]) == 6 and want[0][0] == ("u", "first") and want[0][-1] == ("", "x")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = trie.trie(trie.grafted(df, 100, (F.abs("conv_id") % 6).cast("int"), 5)).select(NAMES)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(want)


def test_a_deep_conversation_and_its_copies(spark):
    """2000 turns, of which some conversations have all and others the half: as many rows as turns, none for pairs of them."""
    turns = [("u", f"turn {i}") for i in range(2000)]
    convs = {7: turns, 5: turns, 9: turns[:1000], 4: [*turns[:1000], ("u", "other way")]}
    got = trie.trie(trie.turn_lists(spark.createDataFrame(as_rows(convs), "conv_id long, turn long, role string, text string")).select("conv_id", "turns"))
    assert got.count() == 2002
    by = {(r.depth, r.conv_id): r for r in got.filter("depth in (0, 1000, 1001, 2000)").collect()}
    assert (by[0, 4].n_convs, by[0, 4].n_leaves, by[1000, 4].n_children, by[2000, 5].n_convs) == (4, 2, 2, 2)
    assert by[0, 4].saved_tokens == sum(3 * len(x) for _, x in turns[:1000]) + sum(len(x) for _, x in turns[1000:])
    assert by[2000, 5].ends_sha256 == hashlib.sha256(b"5,7").hexdigest()


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.turn_lists(df).select("conv_id", "turns")).count() == 0


# ---- hard negatives


def plain_negatives(rows, anchor, positives=5, negatives=3):
    """Of (id, label, vector), in whole numbers."""
    sound = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    firsts = {}
    for r in sorted((r for r in sound if anchor(r[0])), key=lambda r: (r[1], r[2])):
        firsts.setdefault(r[0], r)
    out = []
    for i, y, v in firsts.values():
        scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, z == y) for j, z, w in sound if j != i]  # noqa: B905

        def best(some, k):
            top = {}
            for s, j in some:
                top[j] = max(s, top.get(j, s))
            return sorted((-s, j) for j, s in top.items())[:k]

        for s, j in best([(s, j) for s, j, same in scored if same], positives):
            held = best([(t, k) for t, k, same in scored if not same and 50 * -s <= 100 * t <= 95 * -s], negatives)
            out += [(i, j, r + 1, k, -s, -t) for r, (t, k) in enumerate(held)]
    return sorted(out)


def found_negatives(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<double>, id int, score int").repartition(3)
    return sorted(tuple(r) for r in hardneg.hard_negatives(df, F.col("id") % 10 == 0, **options).collect())


def some_vectors(n=300, d=6, seed=2):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(4), [rng.gauss(0.2, 1) for _ in range(d)]) for i in range(n)]
    rows += [(i + n, rng.randrange(4), rows[3][2]) for i in range(40)]  # ties
    rows += [rows[10], rows[11], rows[11], (20, 1, [0.5] * d), (10, 3, [0.0] * d)]  # repeated rows, and others of their ids
    rows += [(1001, None, [1.0] * d), (1002, 1, None), (None, 1, [1.0] * d), (1003, 1, [1.0] * (d - 1) + [None]), (1004, 1, [math.nan] * d), (1010, 2, [math.inf] * d), (1005, 1, []), (1020, 2, [3.0]), (1006, 0, [1.0] * (d + 3))]
    return rows


@pytest.mark.parametrize("wave", [16 << 20, 900])
def test_hard_negatives(spark, monkeypatch, wave):
    monkeypatch.setattr(hardneg, "ANCHORS", 7)
    monkeypatch.setattr(hardneg, "CANDIDATES", 50)
    rows = some_vectors()
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert want and found_negatives(spark, rows, wave_bytes=wave) == want


def test_scores_past_the_floats(spark):
    """Neighbouring whole numbers beyond 2^53, and products beyond 64 bits."""
    big = 2.0**20
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 0.0]), (2, 1, [big, 1 / 256]), (3, 2, [big * 0.75, 0.0]), (4, 2, [big * 0.75, 1 / 256]), (5, 2, [-big, 0.0]), (6, 1, [1e30, 0.0]), (10, 2, [1e30, 1e30]), (7, 3, [1e29, 0.0])]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert any(s > 2**53 for *_, s in want) and found_negatives(spark, rows) == want


def test_no_anchors(spark):
    assert found_negatives(spark, [(1, 1, [1.0]), (2, 2, [1.0])]) == [] and found_negatives(spark, []) == []
