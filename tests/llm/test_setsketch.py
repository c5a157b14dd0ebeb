"""SetSketch registers, their likelihood, and groups against all pairs of full sets."""

import random
from itertools import combinations

import numpy as np
import pytest

from sylvastack.llm import queries, setsketch

from .test_simhash import plain_words, roots

COLUMNS = [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]


def plain_set(text, k=5):
    words = plain_words(text)
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_groups(rows, percent=85):
    """(id, n, component) of rows (id, text), sorted; rows are told apart by their place."""
    sets = [plain_set(t) for _, t in rows]
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    of = roots(range(len(rows)), pairs)
    least = {}
    for i, (id_, _) in enumerate(rows):
        if id_ is not None:
            least[of[i]] = min(least.get(of[i], id_), id_)
    return sorted(((id_, len(sets[i]), least.get(of[i])) for i, (id_, _) in enumerate(rows)), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in setsketch.set_groups(df, **options).collect()), key=repr)


def hashes(draw, n):
    return np.array(sorted({draw.getrandbits(64) for _ in range(n)}), np.uint64)


def test_registers_merge_and_do_not_depend_on_order_or_repeats():
    draw = random.Random(1)
    a, b = hashes(draw, 700), hashes(draw, 40)
    both = np.union1d(a, b)
    assert (setsketch.merged(setsketch.sketch(a, 50), setsketch.sketch(b, 50)) == setsketch.sketch(both, 50)).all()
    assert (setsketch.sketch(np.concatenate([a[::-1], a]), 50) == setsketch.sketch(a, 50)).all()
    assert not setsketch.sketch(a[:0], 50).any()


@pytest.mark.parametrize("common, only_a, only_b", [(850, 75, 75), (300, 300, 400), (0, 500, 500), (900, 0, 100), (5, 1, 0)])
def test_likelihood_finds_the_similarity(common, only_a, only_b):
    draw = random.Random(2)
    x = hashes(draw, common + only_a + only_b)
    draw.shuffle(x)
    a, b = x[: common + only_a], np.concatenate([x[:common], x[common + only_a :]])
    m = 2_000
    ra, rb = setsketch.sketch(a, m), setsketch.sketch(b, m)
    grid = np.linspace(0, min(len(a), len(b)) / max(len(a), len(b)), 401)
    likely = setsketch.log_likelihood((ra > rb).sum(), (ra < rb).sum(), (ra == rb).sum(), len(a), len(b), grid)
    true = common / len(x)
    assert abs(grid[likely.argmax()] - true) < 4 * np.sqrt(true * (1 - true) / m) + 0.01


def test_bands_and_likelihood_lose_no_pair_at_the_threshold():
    draw = random.Random(3)
    bands = setsketch.fit_bands(0.85)
    registers = bands * setsketch.WIDTH
    assert (1 - 0.85**setsketch.WIDTH) ** bands <= setsketch.MISSED
    a, b, sizes = [], [], []
    for _ in range(400):
        x = hashes(draw, 200)
        a.append(setsketch.sketch(x[:185], registers))
        b.append(setsketch.sketch(x[15:], registers))
        sizes.append(185)
    a, b, sizes = np.array(a), np.array(b), np.array(sizes)
    assert (a == b).reshape(400, bands, -1).all(axis=2).any(axis=1).all()
    assert setsketch.open_pairs(a, b, sizes, sizes, 0.85).all()
    unlike = np.bitwise_count((setsketch.low_bits(a) ^ setsketch.low_bits(b)).view(np.uint64)).sum(axis=1)
    assert (unlike <= setsketch.most_unlike(registers, 0.85)).all() and setsketch.most_unlike(registers, 0.85) < registers / 4
    far = setsketch.open_pairs(a, np.roll(b, 1, axis=0), sizes, sizes, 0.85)
    assert not far.any()


def test_query_on_the_whole_table(spark, documents, data):
    df = queries.QUERIES["op13_setsketch"](spark, data)
    assert df.dtypes == COLUMNS
    rows = df.collect()
    assert sorted((tuple(r)[:3] for r in rows), key=repr) == plain_groups([(r.doc_id, r.text) for r in documents.collect()])
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and not all(r.kept for r in rows)


def test_odd_rows(spark, odd, none):
    assert found(odd) == plain_groups([(r.doc_id, r.text) for r in odd.collect()])
    assert found(none) == []
    assert setsketch.set_groups(none).columns == ["id", "n", "component"]


def changed(draw, words, times):
    words = list(words)
    for _ in range(times):
        words[draw.randrange(len(words))] = f"new{draw.getrandbits(40)}"
    return " ".join(words)


def test_chains_and_copies_of_an_unlike_sort(spark):
    """Copies that are all like one text and less like each other, chains, short texts, null ids, repeated ids."""
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3_000)]
    rows = []
    for group in range(6):
        original = draw.choices(vocabulary, k=draw.choice([12, 60, 90, 300]))
        rows += [(1_000 * group + 900, " ".join(original))] + [(1_000 * group + i, changed(draw, original, draw.choice([0, 1, 1, 2]))) for i in range(30)]
        chain = original
        for i in range(12):
            chain = changed(draw, chain, 1).split()
            rows.append((1_000 * group + 500 + i, " ".join(chain)))
    rows += [(None, rows[0][1]), (5, rows[40][1]), (5, "a b c"), (6, "A b\tc"), (7, "a b c d")]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)


@pytest.mark.parametrize("bucket", [256, 2])
def test_a_shared_passage_fills_buckets_that_are_dealt_again(spark, bucket, monkeypatch):
    monkeypatch.setattr(setsketch, "BUCKET", bucket)
    draw = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"x{draw.getrandbits(30)}" for _ in range(draw.choice([2, 8, 15])))) for i in range(120)]
    rows += [(1_000 + i, changed(draw, t.split(), 1)) for i, t in rows[::3]]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain_groups(rows)
