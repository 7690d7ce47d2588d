import collections
import re

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from tests.llm import cases

from larderflow.llm import likeness, line_dedup, simhash


@pytest.fixture(scope="module")
def rows():
    return cases.awkward()


def slow_print(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_the_book(rows):
    for r in rows:
        assert simhash.simhash((r[1] or "").encode()) == slow_print(r[1])


def brute_components(rows, radius):
    prints = [slow_print(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                up[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    return [(r[0], f"{p:016x}", min((d for d in low[find(i)] if d is not None), default=None)) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]


@pytest.mark.parametrize("radius,tile", [(3, 16384), (12, 7)])
def test_near_duplicates(spark, rows, radius, tile):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of it " * 6
    rows = rows + [cases.doc(7000 + i, base + f" end{i}") for i in range(25)]
    got = simhash.near_duplicates(cases.table(spark, rows), radius, tile=tile).select("doc_id", simhash.hex_print(), "component_id").collect()
    null_last = lambda t: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in t)
    assert sorted(map(null_last, map(tuple, got))) == sorted(map(null_last, brute_components(rows, radius)))


def test_tile_forest_connects_what_links_connect():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 30, dtype=np.uint64)
    a = np.unique(np.concatenate([centre ^ np.uint64(1 << int(b)) for b in rng.integers(0, 63, 12)]))
    b = np.setdiff1d(centre ^ np.uint64(5), a)
    for other in (None, b):
        u, v = simhash.tile_forest(a, other, 3)
        assert (np.bitwise_count(u ^ v) >= 1).all()
        nodes = np.unique(a if other is None else np.concatenate([a, b]))
        right = a if other is None else b

        def labels(edges):
            up = {int(n): int(n) for n in nodes}  # noqa: B023
            def find(x):
                while up[x] != x:  # noqa: B023
                    x = up[x]  # noqa: B023
                return x
            for x, y in edges:
                x, y = find(int(x)), find(int(y))
                up[max(x, y)] = min(x, y)
            return {n: find(n) for n in up}

        links = [(x, y) for x in a for y in right if int(x ^ y).bit_count() <= 3]
        assert labels(links) == labels(zip(u, v, strict=True))


def test_empty(spark):
    assert simhash.near_duplicates(cases.table(spark, [])).collect() == []
    assert line_dedup.dedup_lines(cases.table(spark, [])).collect() == []


def brute_lines(rows, min_words):
    """By definition: every line in a run that occurs earlier and has enough words goes."""
    count = lambda line: len(re.findall("[^\x20\x09-\x0d]+", line))
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, line_key(d[1])))
    seqs = [d[1].split("\n") for d in docs]
    places = [(d, i) for d, s in enumerate(seqs) for i in range(len(s))]
    starts = collections.defaultdict(list)
    gone = collections.defaultdict(set)
    for d, i in places:
        for e, j in starts[seqs[d][i]]:
            k = 0
            while i + k < len(seqs[d]) and j + k < len(seqs[e]) and seqs[d][i + k] == seqs[e][j + k]:
                k += 1
            if sum(map(count, seqs[d][i : i + k])) >= min_words:
                gone[d].update(range(i, i + k))
        starts[seqs[d][i]].append((d, i))
    return {doc: ("\n".join(x for i, x in enumerate(s) if i not in gone[d]), len(gone[d])) for d, (doc, s) in enumerate(zip(docs, seqs, strict=True))}


def line_key(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


@pytest.mark.parametrize("min_words", [1, 5, 20, 50])
@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, min_words, seed):
    rows = cases.awkward(seed)
    loop = "\n".join(["go on", "again", ""] * 20)
    rows += [cases.doc(8000, loop), cases.doc(8001, "x\n" + loop + "\ny"), cases.doc(8002, "60 " * 60 + "\na\nb\nc"), cases.doc(8003, "60 " * 60 + "\na\nb\nd")]
    df = cases.table(spark, rows)
    out = line_dedup.dedup_lines(df, min_words, removed="removed")
    assert out.columns == [*df.columns, "removed"]
    want = brute_lines(rows, min_words)
    want = sorted((r[0] is None, r[0] or 0, *(want[r[0], r[1]] if r[1] is not None else ("null", 0))) for r in rows)
    got = out.select("doc_id", "text", "removed").collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, "null" if g.text is None else g.text, g.removed) for g in got) == want


def brute_likeness(rows, width=5):
    """Labels by comparing all pairs of texts on their shingles themselves."""
    sets = []
    for r in rows:
        words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def near_copies(n=40, words=120):
    """Texts at all similarities around 0.8, in chains and stars; first two that share exactly 4 of 5 shingles, then two that share fewer."""
    rng = np.random.default_rng(5)
    out = [" ".join(f"e{i}" for i in range(40)), " ".join(f"e{i}" for i in range(36)) + " x0 x1 x2 x3"]
    out += [" ".join(f"f{i}" for i in range(40)), " ".join(f"f{i}" for i in range(35)) + " y0 y1 y2 y3 y4"]
    for base in range(4):
        text = [f"w{base}_{i}" for i in range(words)]
        for _ in range(n):
            copy = text.copy()
            for at in rng.integers(0, words, rng.integers(0, 8)):
                copy[at] = f"z{rng.integers(10**9)}"
            out.append(" ".join(copy))
    return [cases.doc(5000 + i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("tile", [16384, 50])
def test_similar_links_all_that_brute_force_links(spark, rows, tile):
    rows = rows + near_copies()
    docs = cases.table(spark, [(*r[:4], i) for i, r in enumerate(rows)])
    got = {g.key: g for g in simhash.similar(docs, keys="n_chars", tile=tile).collect()}
    assert sorted(got) == list(range(len(rows)))
    want, ours, theirs = brute_likeness(rows), collections.defaultdict(set), collections.defaultdict(set)
    for i, label in enumerate(want):
        ours[got[i].label].add(i)
        theirs[label].add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))
    for members in theirs.values():
        assert {got[i].component_id for i in members} == {min((rows[i][0] for i in members if rows[i][0] is not None), default=None)}
    sizes = sorted(len(m) for m in theirs.values() if rows[min(m)][0] and 5000 <= rows[min(m)][0] < 6000)
    assert sizes[0] == 1 and sizes[-1] > 10


def test_pipeline_drops_copies_at_four_fifths(spark):
    a, b, c, d = near_copies(0)[:4]
    kept = corpus_pipeline.near_duplicates(spark, cases.table(spark, [a, b, c, d]), "").collect()
    assert sorted(r.doc_id for r in kept) == [a[0], c[0], d[0]]


def test_sets_at_four_fifths_share_a_band():
    rng = np.random.default_rng(3)
    for shared, only in [(4, 1)] * 300 + [(8, 2)] * 300 + [(80, 20)] * 300 + [(4000, 1000)] * 20:
        a = rng.integers(0, 2**64, shared + only, dtype=np.uint64)
        assert (likeness.bands(a) == likeness.bands(a[:shared])).any()
    a, b = (rng.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    assert (likeness.bands(a) == likeness.bands(rng.permutation(a))).all() and not (likeness.bands(a) == likeness.bands(b)).any()


def test_unlike_texts_are_not_compared(spark, monkeypatch):
    """What goes to comparisons is bounded by the texts, not by their pairs; groups just under the similarity are compared."""
    real, sent = simhash._alike, spark.sparkContext.accumulator(0)

    def counted(*args):
        def over(batches):
            def tap():
                for b in batches:
                    sent.add(len(b.column("rows").flatten()))
                    yield b

            return real(*args)(tap())

        return over

    monkeypatch.setattr(simhash, "_alike", counted)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"u{w}" for w in rng.integers(0, 10**6, 60)) for _ in range(400)]
    a, b, c, d = near_copies(0)[:4]
    docs = cases.table(spark, [cases.doc(i, t) for i, t in enumerate([*texts, a[1], b[1], c[1], d[1]])])
    got = {r.doc_id: r.component_id for r in simhash.similar(docs, keys="doc_id", tile=50).collect()}
    assert got == {i: i for i in range(404)} | {401: 400}
    assert 0 < sent.value <= 404


def test_likeness_of_nothing(spark):
    assert simhash.similar(cases.table(spark, []), keys="n_chars").collect() == []


def test_pipeline_keeps_unlike_groups_of_one_id(spark):
    a, b, c, d = near_copies(0)[:4]
    rows = [cases.doc(1, a[1]), cases.doc(2, b[1]), cases.doc(1, c[1]), cases.doc(3, c[1] + " "), cases.doc(None, d[1])]
    kept = corpus_pipeline.near_duplicates(spark, cases.table(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == sorted([(1, a[1]), (1, c[1]), (0, d[1])])
