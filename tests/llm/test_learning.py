"""What the learned operators gather and fit, against plain versions."""

import collections
import math

import numpy as np
import xxhash
from tests.llm import cases

from larderflow.llm import gather, language_id, quality
from larderflow.llm.scratch import Scratch


def test_samples_are_bounded_and_settled(spark):
    rows = [cases.doc(i % 700, f"t{i}", "en" if i % 9 else "de") for i in range(3000)] + [cases.doc(None, "x"), cases.doc(9999, "x", None)]
    by_id = collections.defaultdict(set)
    for r in rows:
        if r[0] is not None and r[2] is not None:
            by_id[r[0]].add(r[2])
    got = [gather.sample_ids(cases.table(spark, rows[::step], partitions=abs(step) * 3), "lang", 20) for step in (1, -1)]
    assert got[0] == got[1]
    assert all(label == min(by_id[i]) for i, label in got[0].items())
    assert collections.Counter(got[0].values()) == {"en": 20, "de": 20}
    # few ids: all of them
    few = gather.sample_ids(cases.table(spark, rows[:9]), "lang", 20)
    assert few == {i: min(by_id_few) for i, by_id_few in {r[0]: {r[2]} for r in rows[:9]}.items()}
    many = [cases.doc(i, "x", f"lang{i % 300:03d}") for i in range(900)]
    assert len(set(gather.sample_ids(cases.table(spark, many), "lang", 2, most=5).values())) == 5


def test_gather_counts_every_document_and_settles_repeated_ids(spark):
    rows = cases.awkward() + [cases.doc(1, "second text of one id", "en"), cases.doc(1, "third", "de")]
    sample = {1: "en", 4: "de"}
    docs = cases.table(spark, rows)
    n, frequency, found = gather.gather(docs, language_id.features, language_id.DIMS, sample, Scratch(spark, "t"), label="lang")
    counts = [language_id.features((r[1] or "").encode()) for r in rows]
    assert n == len(rows) and (frequency == sum((c > 0).astype(int) for c in counts)).all()
    for i, (at, k) in found.items():
        text = min((r[1] or "" for r in rows if r[0] == i and r[2] == sample[i]), key=lambda t: xxhash.xxh64_intdigest(t.encode()))
        want = language_id.features(text.encode())
        assert (np.flatnonzero(want) == at).all() and (want[at] == k).all()
    assert set(found) == {i for i in sample if any(r[0] == i and r[2] == sample[i] for r in rows)}


def plain_ftrl(xs, ys, classes, alpha, beta, l1, l2, epochs, seed):
    """Follow the regularised leader, one coordinate after another; the bias is coordinate -1."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(c, f):
        if abs(z[c, f]) <= l1:
            return 0.0
        return -(z[c, f] - math.copysign(l1, z[c, f])) / ((beta + math.sqrt(n[c, f])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(xs)):
            x = dict(zip(xs[k][0].tolist(), xs[k][1].tolist(), strict=True)) | {-1: 1.0}
            w = {(c, f): weight(c, f) for c in range(classes) for f in x}
            scores = [sum(w[c, f] * v for f, v in x.items()) for c in range(classes)]
            total = sum(math.exp(s) for s in scores)
            for c in range(classes):
                slope = math.exp(scores[c]) / total - (c == ys[k])
                for f, v in x.items():
                    g = slope * v
                    z[c, f] += g - (math.sqrt(n[c, f] + g * g) - math.sqrt(n[c, f])) / alpha * w[c, f]
                    n[c, f] += g * g
    return weight


def test_ftrl_by_the_book():
    rng = np.random.default_rng(4)
    xs = [(np.sort(rng.choice(25, 6, replace=False)), rng.random(6)) for _ in range(40)]
    ys = rng.integers(0, 3, 40)
    args = {"alpha": 0.7, "beta": 1.0, "l1": 0.05, "l2": 0.02, "epochs": 3, "seed": 8}
    w, b = language_id.train_ftrl(xs, ys, 3, **args)
    want = plain_ftrl(xs, ys, 3, **args)
    assert np.allclose(w[:, :25], [[want(c, f) for f in range(25)] for c in range(3)], atol=1e-9)
    assert np.allclose(b, [want(c, -1) for c in range(3)], atol=1e-9) and (w[:, :25] == 0).any()


def test_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(6)
    x = (rng.standard_normal((60, 6)) * [30, 20, 12, 8, 4, 2] @ rng.standard_normal((6, 200)) + 0.01 * rng.standard_normal((60, 200))).astype(np.float32)
    axes = quality._leading_axes(x, 4)
    _, _, v = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(axes @ axes.T, v[:4].T @ v[:4], atol=2e-2)


def test_weights_are_tf_idf(spark):
    texts = ["one two, THREE", "one one two", "four five!!", "six seven 7"]
    docs = cases.table(spark, [cases.doc(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    counts = [quality.features(t.encode()) for t in texts]
    held = sum((c > 0).astype(int) for c in counts)
    idf = [math.log(5 / (1 + h)) + 1 for h in held]
    want = [[math.log1p(k) * w for k, w in zip(c, idf, strict=True)] for c in counts]
    assert np.allclose(model.weigh(np.array(counts)), want, rtol=1e-4)
