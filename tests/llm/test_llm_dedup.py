"""Deduplication, fingerprints and repetition against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from huntlake.llm import fingerprints as fingerprints_module
from huntlake.llm import ngram_join
from huntlake.llm.components import components
from huntlake.llm.fingerprints import compared_with_next, edits, fingerprint, fingerprints, likeness, root, with_following
from huntlake.llm.queries import QUERIES
from huntlake.llm.repetition import quality_rules, repeats
from huntlake.llm.substrings import without_repeats
from huntlake.llm.words import WordHashes, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def components_by_force(docs):
    sets = {}
    for d, x in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), x))
        sets[d] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    holders, shared, least = defaultdict(list), Counter(), {d: d for d in sets}
    for d in sorted(sets):
        for s in sets[d]:
            holders[s].append(d)
    for found in holders.values():
        shared.update((a, b) for i, b in enumerate(found) for a in found[:i])

    def top(d):
        while least[d] != d:
            d = least[d]
        return d
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((top(a), top(b)))
            least[b] = a
    return {d: (len(s), top(d)) for d, s in sets.items()}


def near_copies():
    rng = random.Random(5)
    base = [[rng.choice("abcdefghij") for _ in range(rng.choice([3, 4, 5, 8, 30, 60]))] for _ in range(12)]
    docs = {}
    for i in range(220):
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            x[rng.randrange(len(x))] = rng.choice("abcdefghijXY")
        docs[i] = " ".join(x) + (" the common line of all of us here" if i % 3 == 0 else "")
    docs.update({300: "", 301: " \n ", 302: "one", 303: "ONE", 304: "z " * 30_000})
    return docs


def frame(spark, docs, *more):
    rows = [(d, x, 1, "k") for d, x in docs.items()] + [(d, x, 2, None) for d, x in more]
    return spark.createDataFrame(rows, "doc_id long, text string, n long, key string")


@pytest.mark.parametrize("frequent", [20, 3])
def test_ngram_join(spark, monkeypatch, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = near_copies()
    got = ngram_join.near_duplicates(frame(spark, docs, (302, "one"), (400, None), (None, docs[0]))).collect()
    want = [(d, *v) for d, v in components_by_force(docs | {400: ""}).items()]
    want += [(302, 1, 302), (None, len(components_by_force({0: docs[0]})) and components_by_force({0: docs[0]})[0][0], None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("frequent", [20, 10_000])
def test_ngram_join_families(spark, monkeypatch, frequent):
    """Variants of texts that are not there themselves, from one changed word to many, with neighbours just inside and just outside."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rng, docs = random.Random(8), {}
    for size in (40, 75, 150):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(9)}" for _ in range(size)]
        for _ in range(90):
            x = list(base)
            for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 7])):
                at = rng.randrange(len(x))
                if rng.random() < 0.3:
                    del x[at]
                else:
                    x[at] = rng.choice([f"new{rng.randrange(1000)}", "same", base[0]])
            docs[len(docs)] = " ".join(x)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, docs)).collect()}
    assert got == components_by_force(docs) and len({c for _, c in got.values()}) > 20


def test_ngram_join_far_members(spark, monkeypatch):
    """Members too far from each other to be linked meet only at columns that can be the first they share."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 10)
    rng, docs, stored = random.Random(6), {}, {}
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(900)}" for _ in range(150)]
    for i in range(240):
        x, gone = list(base), rng.sample(range(150), 9 if i % 3 else 2)
        docs[i] = " ".join(w for at, w in enumerate(x) if at not in gone)

    def keep(df, name):
        stored[name] = store(df, name)
        return stored[name]

    store = ngram_join.store
    monkeypatch.setattr(ngram_join, "store", keep)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame(spark, docs)).collect()}
    assert got == components_by_force(docs) and len({c for _, c in got.values()}) > 100
    formed = lambda rows: rows.alias("x").join(rows.alias("y"), "key").where("x.root < y.root").count()
    assert 3 * formed(stored["near"]) < formed(stored["mixed"]), (formed(stored["near"]), formed(stored["mixed"]))


def test_ngram_join_query(spark, sf):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op3_ngram_join"](spark, sf).collect()}
    assert got == components_by_force(documents(spark, sf))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(500, 500 + i) for i in range(50)]
    least = {n: n for e in edges for n in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in least.items() if n in got} and {n for a, b in edges if a != b for n in (a, b)} <= set(got)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removal_by_force(docs):
    seen, out = set(), {}
    for d in sorted(docs):
        w, gone = WORD.findall(docs[d]), set()
        for i in range(len(w) - 19):
            k = tuple(w[i:i + 20])
            if k in seen:
                gone.update(range(i, i + 20))
            seen.add(k)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(spark, sf):
    rng = random.Random(3)
    base = [[rng.choice("abcd") for _ in range(60)] for _ in range(5)]
    docs = {}
    for i in range(150):
        x = []
        for _ in range(rng.choice([1, 2, 3])):
            a = rng.randrange(40)
            x += rng.choice(base)[a:a + rng.choice([10, 19, 20, 21, 30])] + [f"u{rng.randrange(10 ** 6)}"] * rng.choice([0, 1])
        docs[i] = " ".join(x)
    docs.update({300: "x y " * 40, 301: "x y " * 40, 302: "x  y\n" * 40, 310: "", 311: "é " * 25, 312: "z " * 30_000})
    out, left = without_repeats(frame(spark, docs, (400, None), (301, docs[301])))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert out.count() == len(docs) + 2
    assert got == removal_by_force(docs | {400: ""})
    assert {hashlib.sha256(r.kept.encode()).hexdigest() for r in left.collect()} <= {v[2] for v in got.values()}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_substring_dedup"](spark, sf).collect()}
    assert got == removal_by_force(documents(spark, sf))


def test_window_hashes():
    hashes = WordHashes(lower=False)
    for k in (1, 5, 8, 20):
        words = [random.choice("ab") for _ in range(60)]
        by = defaultdict(set)
        for i, h in enumerate(runs(hashes(" ".join(words)), k).tolist()):
            by[tuple(words[i:i + k])].add(h)
        assert all(len(v) == 1 for v in by.values()) and len({*map(tuple, by.values())}) == len(by)
        assert len(runs(hashes("a"), k)) == (k == 1)


def test_fingerprints(spark):
    docs = {9: "a b.\nc d.\n\ne f.", 7: "a b.\nc x.\n\ne f.", 5: "", 3: "Ünïcode " * 50, 1: "one"}
    got = {r.doc_id: r for r in compared_with_next(frame(spark, docs, (2, None), (7, docs[7]), (None, "no id"))).collect()}
    ids = sorted([*docs, 2], reverse=True)
    for d, after in zip(ids, ids[1:] + ids[:1]):
        x, y = docs.get(d, ""), docs.get(after, "")
        half = len(x) // 2
        want = x[:len(x) - half] + y[:half]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(x), hashlib.sha256(want.encode()).hexdigest()), d
        assert (got[d].fingerprint == got[d].edited_fingerprint) == (x == want)
        assert 0 <= got[d].near_next <= 1 and got[d].near_edited == (1 if x == want else got[d].near_edited)
    pair = spark.createDataFrame([(docs[9], docs[7])], "x string, y string")
    a, b = fingerprint(F.col("x")), fingerprint(F.col("y"))
    row = pair.select(edits(a, b).alias("e"), edits(a, a).alias("none"), likeness(a, b).alias("near"), root(a).alias("r")).first()
    assert [tuple(x) for x in row.e] == [(0, 1)] and row.none == [] and 0 < row.near < 1 and len(row.r) == 64
    with pytest.raises(ValueError):
        fingerprints(pair.withColumnRenamed("x", "text").withColumn("Fingerprint", F.lit(1)))
    assert fingerprints(frame(spark, {}, (1, None))).first().fingerprint


@pytest.mark.parametrize("slice_rows,quantiles", [(1, 1000), (3, 2), (1000, 1000)])
def test_following_across_slices(spark, monkeypatch, slice_rows, quantiles):
    monkeypatch.setattr(fingerprints_module, "QUANTILES", quantiles)
    rng = random.Random(3)
    rows = [(rng.randrange(40), rng.choice(["a", "b\nc", "", "long " * 50])) for _ in range(90)] + [(7, None), (None, "x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    least = {d: min(x or "" for e, x in rows if e == d) for d, _ in rows if d is not None}
    ids = sorted(least, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    want = sorted((d is not None, d or 0, x or "", least[after[d]] if d is not None else "") for d, x in rows)
    got = with_following(df, slice_rows).withColumn("same", fingerprint(F.col("following")) == F.col("next_fingerprint")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.text, r.following) for r in got) == want and all(r.same for r in got)
    assert with_following(df.limit(0), slice_rows).collect() == []


def test_fingerprint_query(spark, sf):
    rows, docs = QUERIES["op1_fingerprints"](spark, sf).collect(), documents(spark, sf)
    texts = defaultdict(set)
    for r in rows:
        texts[r.fingerprint].add(docs[r.doc_id])
    assert len(rows) == len(docs) and all(len(t) == 1 for t in texts.values()) and len(texts) == len(set(docs.values()))
    assert np.mean([r.near_edited for r in rows]) > 0.4 > 0.05 > np.mean([r.near_next for r in rows])
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1]))
    for r in rows:
        x, y = docs[r.doc_id], docs[after[r.doc_id]]
        half = len(x) // 2
        edited = x[:len(x) - half] + y[:half]
        assert (r.n_chars, r.edited_sha256) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        mine, theirs = {line for part in x.split("\n\n") for line in part.split("\n")}, {line for part in edited.split("\n\n") for line in part.split("\n")}
        assert r.n_edited == len(theirs - mine)


def test_suffix_repeats():
    rng = np.random.default_rng(1)
    for _ in range(60):
        doc = np.repeat(np.arange(3), rng.integers(0, 25, 3))
        w = rng.integers(0, 3, len(doc))
        for i, best in enumerate(repeats(w, doc)):
            want = 0
            for j in range(len(w)):
                k = 0
                while i != j and max(i, j) + k < len(w) and doc[i + k] == doc[j + k] == doc[i] == doc[j] and w[i + k] == w[j + k]:
                    k += 1
                want = max(want, k)
            assert best == want


def test_quality_rules(spark, sf):
    docs = documents(spark, sf) | {-1: "", -2: "a " * 20_000, -3: "x # y\nx # y\n\n \nz", -4: " ".join(f"w{i}" for i in range(80)),
                                   -5: " ".join(f"w{i}" for i in [*range(60), *range(25), *range(60, 110)])}
    got = {r.doc_id: r for r in quality_rules(frame(spark, docs, (-6, None))).collect()}
    assert got[-6].n_words == 0 and not got[-6].kept and len(got) == len(docs) + 1
    for d, x in docs.items():
        r, w = got[d], WORD.findall(x)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i:i + 3])].append(i)
        again = {k for v in at.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
        lines = [x for x in x.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(again)), d
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert got[-4].kept and not got[-5].kept and not got[-5].base_failed
    assert quality_rules(frame(spark, {})).count() == 0


def test_ngram_join_broadcasts_no_table(spark, monkeypatch):
    """Small joins of its steps stay shuffles, so that the driver keeps no thread and memory of them; the session's setting comes back."""
    plans, write, key = [], ngram_join.store, "spark.sql.autoBroadcastJoinThreshold"

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(ngram_join, "store", seen)
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(i, f"one two three four five six seven {i % 3}") for i in range(9)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: i % 3 for i in range(9)}
    assert plans and not any("BroadcastExchange" in x for x in plans)
    assert spark.conf.get(key) == before
