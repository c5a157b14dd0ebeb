import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from sylvastack.llm.components import connected_components
from sylvastack.llm.neardup import near_duplicates
from sylvastack.llm.simhash import anchors, compare_sorted, links, simhash, simhash_groups


def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def plain_simhash(text, k=3):
    words = plain_words(text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_equal_the_plain_rule():
    rng = random.Random(1)
    texts = [None, "", " \n", "A", "a B", "x\x0by  Z"] + [" ".join(rng.choices(["Ab", "é", "c", "d\t e"], k=n)) for n in range(1, 60)]
    assert [simhash(t) & (2**64 - 1) for t in texts] == [plain_simhash(t) for t in texts]


@pytest.mark.parametrize("limit", [None, 6])
def test_links_reach_all_pairs_within_three_bits(spark, limit, monkeypatch):
    if limit:
        monkeypatch.setattr("sylvastack.llm.simhash.BUCKET_ROWS", limit)
    rng = random.Random(2)
    centres = [rng.getrandbits(64) for _ in range(20)]
    fps = {0} | {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(15)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()
    plain = [(a, b) for a, b in combinations(fps, 2) if bin((a ^ b) & (2**64 - 1)).count("1") <= 3]
    assert roots(fps, [(r.a, r.b) for r in found]) == roots(fps, plain)


def test_a_dense_bucket_gives_a_forest_and_not_all_pairs():
    import pyarrow as pa

    fps = np.arange(8).repeat(1)  # all within 3 bits
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(8, np.int64)), pa.array(fps), pa.array([True] * 8), pa.array(fps), pa.array([32] * 8, pa.int32())], ["key", "fp", "home", "rest", "width"])
    assert sum(b.num_rows for b in compare_sorted(3, None)([batch])) == 7


def test_a_fingerprint_goes_to_at_most_32_anchors():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 500))], ["fp"])
    assert sum(b.num_rows for b in anchors([batch])) <= 500 * 32


def test_groups_on_documents_equal_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    fps = {i: plain_simhash(t) for i, t in rows}
    plain = roots(list(fps), [(a, b) for a, b in combinations(fps, 2) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    got = {r.id: (r.fp & (2**64 - 1), r.component) for r in simhash_groups(documents).collect()}
    assert got == {i: (fps[i], plain[i]) for i in fps}


def test_edges(odd, none):
    got = simhash_groups(odd).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add((r.fp, r.component))
    assert by[1] == by[2] == by[3] == {(0, 1)}
    assert by[5] == by[6] and next(iter(by[6]))[1] == 5
    assert simhash_groups(none).collect() == []


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def plain_groups(rows):
    sets = {}
    for i, t in rows:
        w = plain_words(t)
        sets[i] = frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    alike = [(a, b) for a, b in combinations(sets, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    return roots(list(sets), alike)


def test_near_duplicates_equal_brute_force(spark, documents):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for g in range(25):  # near copies: some of the words of a text replaced in one stretch, so about 0.8 to 1 alike
        words = rng.choices(vocabulary, k=rng.choice([30, 120, 600]))
        for c in range(4):
            copy, n = list(words), len(words)
            at, cut = rng.randrange(n), rng.randint(0, max(1, n // 25))
            copy[at : at + cut] = rng.choices(vocabulary, k=cut)
            rows.append((10_000 + 10 * g + c, " ".join(copy)))
    want = plain_groups(rows)
    got = {r.id: r.group for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] != want[i] for i in want) <= len(want) // 100
    assert sum(got[i] != i for i in want) >= 0.98 * sum(want[i] != i for i in want)


def test_copies_link_through_an_original_that_is_not_the_smallest_id(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(20):  # each copy is like the original, few copies are like each other
        words = rng.choices(vocabulary, k=120)
        rows.append((100 * g + 50, " ".join(words)))
        for c in range(20):
            at = rng.randrange(118)
            rows.append((100 * g + 20 + c, " ".join([*words[:at], *rng.choices(vocabulary, k=3), *words[at + 3 :]])))
    want = plain_groups(rows)
    got = {r.id: r.group for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and any(want[100 * g + 50] != 100 * g + 50 for g in range(20))


def test_near_copies_of_short_texts_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for g, n in enumerate([8, 9, 10, 13, 14, 15, 16, 24, 28, 50, 54] * 5):
        words = rng.choices(vocabulary, k=n)
        other = [*words, "more"] if n <= 10 else [*words[:-1], "more"]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(other))]
    got = {r.id: r.group for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_groups(rows) == {i: i // 2 * 2 for i, _ in rows}


def test_near_duplicate_edges(odd, none):
    found = near_duplicates(odd).collect()
    got = {(r.id, r.group) for r in found}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (None, None)} <= got and len(got) == len(found) == 10
    assert {r.id for r in found if r.lead} == {1, 4, 5, 7, 8, 9, None} and {r.id: r.copies for r in found if r.copies > 1} == {5: 2}
    assert near_duplicates(none).collect() == []


def test_work_tables_go_and_results_stay(spark):
    import os

    from sylvastack.llm.workspace import cleaned, materialize

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()

    @cleaned
    def inner(df):
        return materialize(materialize(df).where("id > 1"))

    @cleaned
    def outer(df):
        return inner(df).unionByName(inner(df))

    before = tables()
    assert sorted(r.id for r in outer(spark.range(4)).collect()) == [2, 2, 3, 3]
    assert len(tables() - before) == 1

    @cleaned
    def broken(df):
        materialize(df)
        raise KeyError

    after = tables()
    with pytest.raises(KeyError):
        broken(spark.range(1))
    assert tables() == after
