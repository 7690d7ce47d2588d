import collections
import hashlib
import math
import re
import unicodedata

import numpy as np
import pytest
import xxhash
from tests.llm import cases

from larderflow.llm import exact_dedup, fingerprints, license_scan, mixing, sharding
from larderflow.llm.scratch import Scratch

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = [chr(c) for c in (*range(9, 14), 32)]


def words(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


@pytest.fixture(scope="module")
def rows():
    return cases.awkward()


@pytest.fixture(scope="module")
def empty(spark):
    return cases.table(spark, [])


def test_dedup(spark, rows):
    got = exact_dedup.dedup(cases.table(spark, rows)).collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[hashlib.sha256((r[1] or "").translate(LOW).encode()).hexdigest()].append(r[0])
    assert len(got) == len(rows)
    for g in got:
        ids = groups[g.text_sha256]
        known = [i for i in ids if i is not None]
        assert (g.keep_id, g.group_size) == (max(known, default=None), len(ids))
    kept = collections.Counter(g.text_sha256 for g in got if g.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert all(g.doc_id == g.keep_id for g in got if g.kept)


def test_dedup_against_earlier_batches(spark, empty):
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "t").path, buckets=4)
    run = lambda name, *rows: {
        r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup_batch(cases.table(spark, [cases.doc(*x) for x in rows]), index, name).collect()
    }
    assert run("a", (1, "x"), (2, "X"), (3, "y")) == {1: (2, False), 2: (2, True), 3: (3, True)}
    again = run("b", (9, "x"), (10, "z"))
    assert again == {9: (2, False), 10: (10, True)}
    assert run("b", (9, "x"), (10, "z")) == again
    assert index.read().count() == 3
    more = index.compact(Scratch(spark, "t").path)
    assert sorted(more.read().collect()) == sorted(index.read().collect())
    reopened = exact_dedup.DigestIndex(spark, index.spark.sql(f"DESCRIBE EXTENDED {index.name}").filter("col_name = 'Location'").first()[1], buckets=4)
    assert reopened.read().count() == 3
    plan = index.read().join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_dedup_rerun_keeps_the_same_rows_under_other_partitioning(spark, rows):
    index = exact_dedup.DigestIndex(spark, Scratch(spark, "t").path, buckets=4)
    plain = lambda got: sorted(map(str, got.collect()))
    once = plain(exact_dedup.dedup_batch(cases.table(spark, rows), index, "a"))
    assert sum("kept=True" in r for r in once) == index.read().count()
    for partitions in (1, 7):
        assert plain(exact_dedup.dedup_batch(cases.table(spark, rows[::-1], partitions=partitions), index, "a")) == once


@pytest.mark.parametrize("op", [exact_dedup.dedup, fingerprints.fingerprint, sharding.shard, mixing.mix, license_scan.scan])
def test_empty_table(empty, op):
    assert op(empty).collect() == []


def canon(text):
    fold = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(fold.split())


@pytest.mark.parametrize("bits", [128, 8])
def test_fingerprints(spark, rows, bits):
    rows = [r for r in rows if r[0] is not None]
    first = {}
    rows = [first.setdefault(r[0], r) for r in rows if r[0] not in first]
    got = {r.doc_id: r for r in fingerprints.fingerprint(cases.table(spark, rows), bits).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    pairs = [(r[0], r[1] or "", order[(i + 1) % len(order)][1] or "") for i, r in enumerate(order)]
    short = lambda t: (f"{xxhash.xxh64_intdigest(canon(t).encode(), 42):016x}" + "0" * 16)[: bits // 4]
    buckets = collections.defaultdict(set)
    for _, text, _ in pairs:
        buckets[short(text)].add(canon(text))
    if bits == 8:
        assert any(len(b) > 1 for b in buckets.values())
    texts = collections.defaultdict(set)
    for doc_id, text, after in pairs:
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        texts[g.fingerprint].add(canon(text))
        assert g.near_edited == float(canon(text) == canon(edited)) or bits == 8
        assert g.near_next == float(canon(text) == canon(after))
        assert (g.fingerprint == g.edited_fingerprint) == (g.near_edited == 1.0)
        if bits == 128:
            assert g.fingerprint[:16] == short(text)[:16]
    assert all(len(t) == 1 for t in texts.values())
    assert len(texts) == len({canon(t) for _, t, _ in pairs})


def test_fingerprints_bear_awkward_rows(spark, rows):
    assert fingerprints.fingerprint(cases.table(spark, rows)).count() == len(rows)
    one = fingerprints.fingerprint(cases.table(spark, [cases.doc(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


@pytest.mark.parametrize("blocks", [1, 2, 40, 3000])
def test_successors_at_any_number_of_key_ranges(spark, blocks):
    ids = [((i * 7919) % 2003 - 1000) * 10**12 for i in range(2003)]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    order = sorted(ids, reverse=True)
    want = {i: f"text {order[(at + 1) % len(order)]}" for at, i in enumerate(order)}
    got = fingerprints._with_next(docs, blocks).collect()
    assert len(got) == len(ids) and {r.doc_id: r.next for r in got} == want


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 17, 3], 4, 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and sorted(m.sum(axis=0)) == [6, 6, 6, 7]
    # the mean of a cell over many draws is row x column / total
    mean = np.mean([sharding.communication_matrix([10, 30], 4, s) for s in range(3000)], axis=0)
    assert np.allclose(mean, [[2.5] * 4, [7.5] * 4], atol=0.1)


def test_communication_matrix_has_the_hypergeometric_law(monkeypatch):
    law = [math.comb(6, k) * math.comb(4, 5 - k) / math.comb(10, 5) for k in range(1, 6)]
    for limit in (10**9, 4):  # numpy's sampler, and the one for great counts
        monkeypatch.setattr(sharding, "NUMPY_TOTAL", limit)
        seen = collections.Counter(int(sharding.communication_matrix([6, 4], 2, s)[0, 0]) for s in range(4000))
        assert all(abs(seen[k] / 4000 - p) < 0.03 for k, p in zip(range(1, 6), law, strict=True))


def test_communication_matrix_beyond_a_billion_rows():
    counts = [2 * 10**9 + 7, 3, 0, 5 * 10**9, 10**6] * 3
    m = sharding.communication_matrix(counts, 24, 1)
    assert m.sum(axis=1).tolist() == counts and m.min() >= 0
    assert np.ptp(m.sum(axis=0)) <= 1
    # great cells lie within a few standard deviations of row x column / total
    mean = counts[0] / 24
    assert np.abs(m[0] - mean).max() < 6 * mean**0.5 and np.abs(m[0] - mean).max() > 0.1 * mean**0.5


def test_shuffle_is_uniform(spark):
    rows = [cases.doc(i, "x") for i in range(12)]
    df = cases.table(spark, rows, clash=False).coalesce(2).persist()
    seen = collections.Counter()
    for seed in range(16):
        for g in sharding.shard(df, shards=3, seed=seed).collect():
            seen[g.doc_id, g.shard * 4 + g.slot] += 1
    df.unpersist()
    # 144 cells of 16 / 12 on average: chi-squared has 121 degrees of freedom
    chi = sum((seen[i, at] - 16 / 12) ** 2 / (16 / 12) for i in range(12) for at in range(12))
    assert 70 < chi < 185


def test_shards(spark, rows):
    got = sharding.shard(cases.table(spark, rows), shards=7).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, g.size) for g in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8) for r in rows)
    by = collections.defaultdict(list)
    for g in got:
        by[g.shard].append(g.slot)
        assert (g.law, g.grown_shard) == ("rows", None)
    assert set(by) == set(range(7))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def fill(sizes, most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, total = {}, set(names), sum(sizes.values())
    while open_:
        share = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > most * sizes[s]}
        if not full:
            target |= {s: share * w[s] for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        open_ -= full
    return target


@pytest.mark.parametrize("skew", [1, 40])
def test_mixing(spark, rows, skew):
    rows = rows + [cases.doc(5000 + i, "w " * (30 * skew), source="hot") for i in range(40)]
    got = mixing.mix(cases.table(spark, rows)).collect()
    again = mixing.mix(cases.table(spark, rows[::-1], partitions=5)).collect()
    key = lambda g: (g.doc_id is None, g.doc_id or 0, g.size, g.taken, g.target)
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = fill(sizes)
    taken, source = collections.Counter(), {r[0]: r[3] for r in rows if r[0] is not None}
    for g in got:
        if g.doc_id is not None:
            assert g.source_size == sizes[source[g.doc_id]]
            assert math.isclose(g.target, want[source[g.doc_id]], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= g.taken <= 3 * g.size
        taken[source.get(g.doc_id, "s")] += g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_licenses(spark, rows):
    mit = license_scan.TEXTS["MIT"].replace("MIT License\n", "MIT Licence\n\nCopyright (c) 2019 A Person\n").upper().replace(" ", "  ")
    more = [
        cases.doc(9001, mit), cases.doc(9002, "text\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT Licence"),
        cases.doc(9003, license_scan.TEXTS["MIT"] + " Except on Mondays."), cases.doc(9004, "SPDX-License-Identifier: ISC"),
        cases.doc(9005, "© 2020 all rights reserved"),
    ]
    got = {g.doc_id: g for g in license_scan.scan(cases.table(spark, rows + more)).collect()}
    assert got[9001].license == "MIT" and got[9003].license is None and got[9004].license == "ISC"
    assert (got[9002].license, got[9002].n_notices, got[9002].line_licenses) == (None, 2, "Apache-2.0,MIT")
    assert got[9005].canonical_sha256 == hashlib.sha256(b"").hexdigest() and got[9005].license is None
    assert all(g.license is None and g.n_notices == 0 for i, g in got.items() if i is None or i < 9000)


def test_licenses_known_by_full_text(spark):
    from pathlib import Path

    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {f.stem: f.read_text() for f in folder.glob("*.txt")}
    assert set(texts) == set(license_scan.FILES)
    full = list(texts.items()) + list((license_scan.TEXTS | license_scan.MORE_TEXTS).items())
    full += [("GPL-2.0-only", texts["GPL-2.0-only"].split("How to Apply These Terms")[0]), ("Apache-2.0", texts["Apache-2.0"].split("APPENDIX")[0])]
    bsd = """Copyright (c) 2020, A Person
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
    third = "\n* Neither the name of the copyright holder nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.\n"
    full += [("BSD-2-Clause", bsd.format("")), ("BSD-3-Clause", bsd.format(third).replace("* Redistributions of", "1. Redistributions of").replace("* Redistributions in", "2. Redistributions in").replace("* Neither", "3. Neither"))]
    indent = lambda header: re.sub("^    ", "", header, flags=re.M)
    gpl3 = texts["GPL-3.0-only"]
    at = gpl3.index("    This program is free software: you can")
    full.append(("GPL-3.0-or-later", "Copyright (C) 2020 A Person\n\n" + indent(gpl3[at : gpl3.index("\n\nAlso add information", at)])))
    mpl = texts["MPL-2.0"]
    full.append(("MPL-2.0", mpl[mpl.index("  This Source Code Form is subject to the terms of") : mpl.index("If it is not possible or desirable")]))
    got = {g.doc_id: g.license for g in license_scan.scan(cases.table(spark, [cases.doc(i, t) for i, (_, t) in enumerate(full)])).collect()}
    assert [(key, got[i]) for i, (key, _) in enumerate(full)] == [(key, key) for key, _ in full]
