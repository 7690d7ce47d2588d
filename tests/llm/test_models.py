import collections
import zlib

import numpy as np
import pytest
from tests.llm import cases

import corpus_pipeline
from larderflow.llm import language_id, line_dedup, mixing, packing, quality, queries
from larderflow.llm.scratch import Scratch

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return cases.awkward()


def test_languages_held_out(spark):
    docs = {r.doc_id: r for r in queries.documents(spark, SF).collect()}
    got = queries.languages(spark, SF).collect()
    assert len(got) == len(docs)
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    held = [g for g in got if g.held_out]
    assert np.mean([docs[g.doc_id].lang == g.lang_pred for g in held]) > 0.98
    assert all(0 <= g.score <= 1 for g in got)
    # calibrated: the mean confidence is near the accuracy
    assert abs(np.mean([g.score for g in held]) - np.mean([docs[g.doc_id].lang == g.lang_pred for g in held])) < 0.03


def test_language_features_cover_the_whole_text():
    text = "abc déf " * 5000
    counts = language_id.features(text.encode())
    n = len(text) + 1  # a space goes before; the one at the end is there
    assert counts.sum() == 30_000 + (n - 1) + (n - 2)
    assert not language_id.features(" 12 *".encode()).any() and not language_id.features(b"").any()


def test_ftrl_is_sparse_and_fits():
    rng = np.random.default_rng(0)
    xs, ys = [], rng.integers(0, 3, 300)
    for y in ys:
        noise = rng.choice(1000, 20, replace=False) + 10
        xs.append((np.append(noise, y), np.append(np.full(20, 0.1), 1.0)))
    w, b = language_id.train_ftrl(xs, ys, 3)
    assert np.mean([np.argmax(w[:, a] @ x + b) == y for (a, x), y in zip(xs, ys, strict=True)]) == 1.0
    assert (w == 0).mean() > 0.9


def test_languages_bear_awkward_rows(spark, rows):
    df = cases.table(spark, rows)
    model = language_id.train(language_id.training_fold(df))
    got = language_id.identify(df, model)
    by = collections.Counter(g.lang_pred for g in got.collect())
    assert sum(by.values()) == len(rows) and by["und"] >= 4
    none = cases.table(spark, [])
    empty = language_id.train(none)
    assert empty.languages == [] and language_id.identify(none, model).collect() == []
    assert {g.lang_pred for g in language_id.identify(df, empty).collect()} == {"und"}
    kept = language_id.identify(df, model, keep=0.3)
    assert kept.columns == df.columns
    unsaid = lambda t: not any(c.isalpha() for c in t or "")
    assert kept.count() == sum(not unsaid(r[1]) for r in rows)


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.qualities(spark, SF).collect()
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 5 == 0) for g in got)
    assert all(g.predicted == int(g.score >= 0.3) and 0 <= g.score <= 1 for g in got)
    held = [(g.score, labels[g.doc_id]) for g in got if g.held_out and g.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_votes_are_exact_neighbours():
    rng = np.random.default_rng(2)
    model = quality.Model(np.ones(quality.DIMS, np.float32), rng.standard_normal((quality.DIMS, 8)).astype(np.float32), np.zeros((8, 0)), np.zeros(0), np.zeros(0), 0.5)
    counts = rng.poisson(0.01, (200, quality.DIMS))
    model.vectors, model.labels, model.votes = model.project(counts[:120]).T.copy(), rng.integers(0, 2, 120).astype(float), np.ones(120)
    got = model.score(counts[120:])
    for row, s in zip(model.project(counts[120:]), got, strict=True):
        sims = row @ model.vectors
        near = np.argsort(-sims)[: quality.NEIGHBOURS]
        w = np.maximum(sims[near], 0) ** quality.SHARPNESS
        assert abs(s - (w * model.labels[near]).sum() / w.sum()) < 1e-5


def test_quality_bears_awkward_rows(spark, rows):
    df = cases.table(spark, rows)
    labels = spark.createDataFrame([(r[0], int(r[0] % 2), 0) for r in rows if r[0]] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.train(df, labels)).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    none = cases.table(spark, [])
    blank = quality.train(none, labels.limit(0))
    assert quality.score(none, blank).collect() == []
    assert {g.score for g in quality.score(df, blank).collect()} == {0.5}


def check_packing(got, sizes, lengths):
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for g in got:
        pieces[g.doc_id].append((g.piece, g.from_token, g.size))
        bins[g.bin_id].append(g)
    for b in bins.values():
        at = 0
        for g in sorted(b, key=lambda g: g.offset):
            assert g.offset == at
            at += g.size
        assert {g.used for g in b} == {at} and {g.capacity for g in b} == {min(c for c in lengths if c >= at)}
    assert sum(g.size for g in got) == sum(sizes)
    return bins


def test_packing(spark, rows):
    lengths = (32, 64, 256)
    got = packing.pack_documents(cases.table(spark, rows), lengths, block_rows=40).collect()
    sizes = [len([w for w in (r[1] or "").replace("\n", " ").replace("\t", " ").split(" ") if w]) + 1 for r in rows]
    bins = check_packing(got, sizes, lengths)
    assert sum(b[0].used for b in bins.values()) / sum(b[0].capacity for b in bins.values()) > 0.85
    again = packing.pack_documents(cases.table(spark, rows[::-1], partitions=5), lengths, block_rows=40).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.pack_documents(cases.table(spark, [])).collect() == []


def slow_pack(sizes, lengths, overhead, attention):
    """The method by looking at every bin and, to open one, at every piece to come."""
    price = lambda c: c + overhead + c * c / attention
    least = lambda u: min(c for c in lengths if c >= u)
    bins, todo = [], sorted(sizes, reverse=True)
    while todo:
        s = todo.pop(0)
        open_ = [b for b in bins if b[0] - b[1] >= s]
        if open_:
            best = min(open_, key=lambda b: b[0] - b[1])
        else:
            per_token = {}
            for c in (c for c in lengths if c >= s):
                held = s
                for t in todo:
                    held += t if held + t <= c else 0
                per_token[c] = price(least(held)) / held
            best = [min(per_token, key=lambda c: (per_token[c], c)), 0]
            bins.append(best)
        best[1] += s
    return sorted((o, least(u), u) for o, u in bins)


@pytest.mark.parametrize("attention", [128, 10**9])
@pytest.mark.parametrize("seed", range(6))
def test_pack_is_best_fit_into_the_cheapest_bins(seed, attention):
    rng = np.random.default_rng(seed)
    sizes, lengths = rng.integers(1, 65, rng.integers(1, 200)), (16, 32, 48, 64)
    bins, offsets, capacity, opened = packing.pack(sizes, lengths, 4, attention)
    used = np.bincount(bins, weights=sizes).astype(int)
    slow = slow_pack(sizes.tolist(), lengths, 4, attention)
    # bins of equal room are alike, so only what they were opened with is certain
    assert sorted(opened) == sorted(o for o, _, _ in slow) and used.sum() == sizes.sum()
    assert sorted(capacity) == sorted(c for _, c, _ in slow)


def test_a_middle_length_wins_where_it_fits():
    _, _, capacity, opened = packing.pack(np.full(100, 1450), (1024, 1500, 4096))
    assert set(opened) == {1500} == set(capacity)
    sizes = np.random.default_rng(0).lognormal(5.5, 1, 20_000).astype(int).clip(1, 4096)
    cost = lambda lengths: sum(map(packing.sequence_cost, packing.pack(sizes, lengths)[2].tolist()))
    assert len(set(packing.pack(sizes)[3])) > 3
    assert all(cost(packing.LENGTHS) < cost((c,)) for c in (4096,))


def best_cost(sizes, lengths, price):
    """The least cost of any packing, by trying every partition."""
    best = float("inf")

    def go(k, bins):
        nonlocal best
        if k == len(sizes):
            best = min(best, sum(price(min(c for c in lengths if c >= b)) for b in bins))
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= lengths[-1]:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(8))
def test_pack_is_near_the_optimum(seed):
    sizes, lengths = np.random.default_rng(seed).integers(1, 65, 7), (16, 32, 48, 64)
    price = lambda c: packing.sequence_cost(c, 4, 512)
    got = sum(map(price, packing.pack(sizes, lengths, 4, 512)[2].tolist()))
    best = best_cost(sizes.tolist(), lengths, price)
    assert best - 1e-9 <= got <= 1.35 * best


def test_pipeline_stages(spark, rows):
    scratch = Scratch(spark, "test-pipeline")
    docs = scratch.table(cases.table(spark, rows), "in")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, SF), name.replace(" ", ""))
        seen[name] = (docs.collect(), out.collect())
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
    before, after = seen["SimHash near-dedup"]
    from tests.llm.test_near import brute_likeness

    assert len(after) == len(set(brute_likeness([tuple(r)[:5] for r in before])))
    assert {key(r) for r in after} <= {key(r) for r in before}
    before, after = seen["mixing"]
    taken = collections.Counter()
    for g in mixing.mix(docs.sparkSession.createDataFrame(before, cases.table(spark, []).schema)).collect():
        taken[g.doc_id] += -(-g.taken // g.size) if g.size else 0
    assert collections.Counter(r.doc_id for r in after) == +taken
    before, after = seen["line dedup"]
    lost = line_dedup.dedup_lines(docs.sparkSession.createDataFrame(before, cases.table(spark, []).schema), removed="n").collect()
    assert len(after) == sum(1 for r in lost if not r.n or r.text.strip())


def test_pipeline_on_documents(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and sum(g.size for g in got) > 0
    check_packing(got, [g.size for g in got], packing.LENGTHS)
    ids = {r.doc_id for r in queries.documents(spark, SF).select("doc_id").collect()}
    assert {g.doc_id for g in got} <= ids
    # most documents are clean and unlike others, so most stay
    assert len({g.doc_id for g in got}) > 0.5 * len(ids)
