"""Language mixtures, the class language model, and the co-trained classifier."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvastack.llm import classlm, cotraining, language


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds == 0


@pytest.fixture(scope="module")
def model(documents):
    return language.train(documents.where(~language.held_out()))


def test_held_out_accuracy(documents, model):
    rows = documents.select("doc_id", "lang", language.held_out().alias("h"), language.identify(documents, model).alias("f")).collect()
    assert all(r.h == held(r.doc_id, 5) for r in rows)
    out = [r for r in rows if r.h]
    assert np.mean([r.f.lang == r.lang for r in out]) >= 0.97
    assert all(0 <= r.f.score <= 1 and r.f.languages[0] == r.f.lang for r in rows)


def test_mixtures_find_both_languages(spark, documents, model):
    by = {r.lang: r.t for r in documents.where("n_chars > 2000").groupBy("lang").agg(F.max_by("text", "n_chars").alias("t")).collect()}
    half = by["en"][:1500] + " " + by["de"][:1500]
    df = spark.createDataFrame([(half,)], "text string")
    found = df.select(language.identify(df, model).alias("f")).first().f
    assert set(found.languages) == {"en", "de"} and abs(sum(found.shares) - 1) < 1e-6 and min(found.shares) > 0.25


def test_language_edges(spark, odd, none, model):
    got = {r.doc_id: r.f.lang for r in odd.select("doc_id", language.identify(odd, model).alias("f")).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[9] != "und" and got[None] != "und"
    empty = language.train(none)
    assert empty.languages == []
    assert {r.f.lang for r in odd.select(language.identify(odd, empty).alias("f")).collect()} == {"und"}
    assert none.select(language.identify(none, model)).collect() == []


def plain_counts(rows):
    counts = Counter()
    for text in rows:
        counts.update([*classlm.tokens(text), None])
    return counts


def test_class_model_against_the_plain_base(documents):
    rows = documents.collect()
    fitted = classlm.fit(documents.where(~language.held_out(folds=10)))
    counts = plain_counts(r.text for r in rows if not held(r.doc_id, 10))
    n, v = sum(counts.values()), len(counts)
    assert (fitted.train_tokens, fitted.distinct) == (n, v)
    got = {r.doc_id: r for r in classlm.score(documents, fitted).collect()}
    for r in rows:
        own = [*classlm.tokens(r.text), None]
        assert got[r.doc_id].n_tokens == len(own) and got[r.doc_id].n_known == sum(counts[t] > 0 for t in own)
        base = sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own)
        assert math.isclose(got[r.doc_id].base_score, base, rel_tol=1e-9)
    out = [got[r.doc_id] for r in rows if held(r.doc_id, 10)]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # classes tell more than word frequency


def test_class_model_probabilities_sum_to_one(spark):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(1)
    texts = [" ".join(words[j] for j in rng.integers(0, 300, 40)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    m = classlm.fit(docs)
    known = {bytes(r.word): r.n for r in m.rare_counts.collect()}
    ids, units, _ = m.vocabulary.look_up(list(known))
    classes = m.class_of[units]
    emission = np.log10(np.array(list(known.values())) + 0.1) - m.log_floor[classes]
    unseen = np.log10(0.1) - m.log_floor[1:]
    for before in (0, 1, 5):
        p = 10 ** m.log_next[before, 0] + (10 ** (m.log_next[before, classes] + emission)).sum() + (10 ** (m.log_next[before, 1:] + unseen)).sum()
        assert math.isclose(p, 1, rel_tol=1e-6)


def test_exchange_separates_words_that_follow_different_words():
    pairs = np.zeros((13, 13))
    for group in (range(1, 7), range(7, 13)):
        for a in group:
            for b in group:
                pairs[a, b] = 5
    of = classlm.exchange(pairs, classes=3)
    assert of[0] == 0 and len(set(of[1:7])) == len(set(of[7:])) == 1 and of[1] != of[7]


def test_words_choose_the_class_of_words_in_the_same_places():
    of = np.array([0, 1, 1, 2, 2, 1, 2])
    before, after = np.zeros((7, 3)), np.zeros((7, 3))
    for u, side in ((1, 2), (2, 2), (3, 1), (4, 1)):
        before[u, side] = after[u, side] = 20
    before[5, 1] = after[5, 1] = 3  # it stands beside words of class 1, as words of class 2 do
    still = np.arange(7) < 5
    got = classlm.choose(of, before, after, still)
    assert got.tolist() == [0, 1, 1, 2, 2, 2, 2]
    assert classlm.choose(got, before, after, still).tolist() == got.tolist()


def plain_neighbours(texts, vocabulary, of, classes):
    before, after = np.zeros((vocabulary.units, classes)), np.zeros((vocabulary.units, classes))
    for text in texts:
        units = vocabulary.look_up(classlm.tokens(text))[1]
        line = [0, *of[units], 0]
        for i, u in enumerate(units):
            before[u, line[i]] += 1
            after[u, line[i + 2]] += 1
    return before, after


def test_class_counts_and_scores_against_plain_ones(documents):
    docs = documents.where("doc_id % 4 = 0")
    m = classlm.fit(docs, frequent=400, seeds=50, classes=8, rounds=2)
    texts = [r.text for r in docs.select("text").collect()]
    before, after = classlm._neighbours(docs, "text", m.vocabulary, m.class_of, 8)
    plain = plain_neighbours(texts, m.vocabulary, m.class_of, 8)
    assert (before == plain[0]).all() and (after == plain[1]).all()
    grid = np.zeros((8, 8))
    for text in texts:
        line = [0, *m.class_of[m.vocabulary.look_up(classlm.tokens(text))[1]], 0]
        for a, b in zip(line, line[1:]):
            grid[a, b] += 1
    size = grid.sum(axis=0)
    once = (size + 0.1) / (size.sum() + 0.8)
    counts = plain_counts(texts)
    kinds = Counter(m.class_of[m.vocabulary.look_up([w])[1][0]] for w in counts if w is not None)
    for r in classlm.score(docs, m).join(docs.select("doc_id", "text"), "doc_id").collect():
        words, last, want = classlm.tokens(r.text), 0, 0.0
        for w in [*words, None]:
            c = 0 if w is None else m.class_of[m.vocabulary.look_up([w])[1][0]]
            seen, follow = grid[last].sum(), (grid[last] > 0).sum()
            want += math.log10((grid[last, c] + follow * once[c]) / (seen + follow) if seen else once[c])
            want += 0 if w is None else math.log10((counts[w] + 0.1) / (size[c] + 0.1 * (kinds[c] + 1)))
            last = c
        assert math.isclose(r.score, want, rel_tol=1e-9)


def test_classes_of_all_frequent_words_lower_perplexity(documents):
    train, out = documents.where(~language.held_out(folds=10)), documents.where(language.held_out(folds=10))
    total = lambda rounds: classlm.score(out, classlm.fit(train, seeds=200, rounds=rounds)).agg(F.sum("score")).first()[0]
    assert total(1) > total(0)


def test_fit_and_score_equals_both_steps(documents, odd):
    for docs in (documents.where("doc_id % 4 = 0"), odd):
        learn = ~language.held_out(folds=10)
        model, got = classlm.fit_and_score(docs, learn, frequent=300, seeds=40, classes=8)
        apart = classlm.fit(docs.where(learn), frequent=300, seeds=40, classes=8)
        assert (model.class_of == apart.class_of).all() and model.train_tokens == apart.train_tokens
        key = lambda r: (r.doc_id is None, r.doc_id, r.score)
        for a, b in zip(sorted(got.collect(), key=key), sorted(classlm.score(docs, apart).collect(), key=key), strict=True):
            assert (a.doc_id, a.n_tokens, a.n_known) == (b.doc_id, b.n_tokens, b.n_known)
            assert math.isclose(a.score, b.score, rel_tol=1e-12) and math.isclose(a.base_score, b.base_score, rel_tol=1e-12)


def test_class_model_edges(odd, none):
    fitted = classlm.fit(odd)
    got = classlm.score(odd, fitted).collect()
    assert len(got) == 11 and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and max(r.n_tokens for r in got) == 40_001
    assert all(r.score < 0 or r.n_tokens == 1 for r in got)
    assert classlm.score(none, fitted).collect() == []
    blank = classlm.fit(none)
    assert blank.train_tokens == 0 and all(math.isfinite(r.score) and r.n_known == 0 for r in classlm.score(odd, blank).collect())


def test_co_training_on_labels_not_seen(spark, data, documents):
    labels = spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    seen = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0)
    scores = cotraining.classify(docs, cotraining.fit(docs, seen)).join(labels, "doc_id").collect()
    out = [r for r in scores if held(r.doc_id, 4)]
    assert len(out) > 50
    assert np.mean([(r.quality_score >= 0.5) == (r.quality == 1) for r in out]) >= 0.95
    assert all(0 <= r.quality_text <= 1 and 0 <= r.quality_meta <= 1 and 0 <= r.toxic_score <= 1 for r in scores)


def test_co_training_hands_labels_over():
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 900)
    text = cotraining.Sparse.of([np.array(sorted({1 + a, 10 + int(b)})) for a, b in zip(y, rng.integers(0, 40, 900))], cotraining.TEXT_BUCKETS)
    meta = cotraining.Sparse.of([np.array([3 + a]) for a in y], cotraining.META_BUCKETS)
    given = np.where(np.arange(900) < 60, y, -1)
    p = cotraining.co_train(text, meta, given).scores(text, meta)
    assert np.mean((p[:, 2] > 0.5) == y) > 0.99


def test_views_label_all_documents_without_a_label(spark, data):
    labels = spark.read.parquet(f"{data}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{data}/../sf0.01/documents.parquet")
    rows = cotraining._written(docs, "doc_id", "text")
    y = dict(labels.groupBy("doc_id").agg(F.min("quality")).collect())
    found = rows.toArrow()
    text, meta = (cotraining._sparse(found, *v) for v in cotraining._VIEWS)
    ids, keys = found["doc_id"].to_pylist(), found["key"].to_pylist()
    mark = np.array([-1 if y.get(i) is None else y[i] for i in ids])
    views = [cotraining.Logistic(x.size).fit(x.take(np.flatnonzero(mark >= 0)), mark[mark >= 0].astype(float)) for x in (text, meta)]
    marked = labels.where("quality is not null").select("doc_id").distinct()
    got = cotraining._surest_of(rows, marked, 1 << 30)(0, *views)
    for to, (x, model) in ((1, (text, views[0])), (0, (meta, views[1]))):
        p = cotraining._sigmoid(model.logit(x))
        plain = {keys[i]: int(p[i] > 0.5) for i in np.flatnonzero((mark < 0) & ((p >= cotraining.SURE) | (p <= 1 - cotraining.SURE)))}
        assert plain and {key: label for key, _, label in got[to]} == plain
    few = cotraining._surest_of(rows, marked, 20)(0, *views)
    assert all(0 < len(x) <= 160 for x in few)


def test_co_training_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (5, 0, None), (8, 0, 1), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    models = cotraining.fit(odd, labels)
    got = cotraining.classify(odd, models).collect()
    assert len(got) == 11 and all(0 <= r.quality_score <= 1 for r in got)
    assert cotraining.classify(none, models).collect() == []
    blank = cotraining.fit(none, labels.where("false"))
    assert {r.quality_score for r in cotraining.classify(odd, blank).collect()} == {0.5}
