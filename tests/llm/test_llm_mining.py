"""Collocations, conversation tries and pairwise quality against brute force, SQL and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import data
from oracle import compare, connect

from huntlake.llm import automata, pairwise_quality, prefix_trie
from huntlake.llm.collocations import collocations, floor_score
from huntlake.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrases(rows, least=10, top=2000, covered=50):
    """(lang, rank, phrase, a, l, r, n, score) by counting everything in dictionaries."""
    f = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        long = {p: v for p, v in c.items() if len(p) == 3 and v >= least}
        gone = {q for p, v in long.items() for q in (p[:2], p[1:]) if 100 * v >= covered * c[q]}
        found = []
        for p, a in c.items():
            if len(p) > 1 and a >= least and p not in gone:
                s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n, -s))
    return sorted(out, key=repr)


def made_texts():
    rnd = random.Random(4)
    words = ["the", "of", "New", "york", "city", "Été", "x\x01", "a|b", "İ", "ｗ"]
    rows = []
    for i in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b"]) for _ in range(rnd.randint(0, 60)))
        rows.append((text, rnd.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", None), ("Hot Pair " * 3000, "en"), ("hot pair " * 5, "xx"), ("only. single! words?", "yy")]


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize("options", [
    {}, {"range_bytes": 500, "chunk_words": 300}, {"range_bytes": 500, "chunk_words": 300, "fan": 4, "group_bytes": 2000},
    {"least": 1, "top": 7, "range_bytes": 900, "covered": 100}])
def test_collocations(spark, options):
    rows = made_texts()
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(5)
    got = sorted((tuple(r) for r in collocations(docs, **options).select(*COLUMNS).collect()), key=repr)
    assert got == phrases(rows, **{k: v for k, v in options.items() if k in ("least", "top", "covered")})


def test_collocations_long_text_and_none(spark, monkeypatch):
    """A text longer than a segment is counted across its segments; no rows give no rows."""
    rnd = random.Random(1)
    text = "".join(rnd.choice("ab cd ef gh".split()) + rnd.choice("    .") for _ in range(5000))
    builder, parts = automata.Builder(), []
    monkeypatch.setattr(automata, "SEGMENT_BYTES", 64)
    for _ in range(2):
        builder.add([text.encode()], [b"en"])
        parts.append(builder.take())
    assert builder.take() is None
    whole = automata.union(parts)
    want = Counter()
    for piece in re.split("[.]", text):
        w = piece.split()
        for k in (1, 2, 3):
            want.update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    got = {}
    for k in (1, 2, 3):
        _, rows = automata.sequences(whole, k)
        got.update({tuple(whole.words[int(i)].as_py().decode() for i in r): int(n) for r, n in zip(rows, whole.weight[k])})
    assert got == {p: 2 * n for p, n in want.items()}
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations(empty).collect() == []


def test_automata_split_and_union():
    """Parts between any borders add up to the whole, and blocks read back as written."""
    rnd = random.Random(2)
    builder = automata.Builder()
    builder.add([" ".join(rnd.choice("abcdefgh") for _ in range(400)).encode() for _ in range(3)], [b"x", b"", b"yy"])
    whole = builder.take()

    def flat(a):
        return {(int(lang), *map(int, ids)): int(w) for k in range(4) for (lang, ids), w in
                zip(zip(*automata.sequences(a, k)), a.weight[k])} | {"words": a.words.to_pylist(), "langs": a.langs.to_pylist()}

    for n in (1, 3, 20):
        marks = sorted(set(automata.borders(whole, n)) | {(b"", b"", b"", b""), (b"x", b"b", b"", b""), (b"x", b"c", b"zz", b""), (b"zz", b"", b"", b"")})
        parts = [p for _, p in automata.split(whole, marks)]
        assert flat(automata.union([automata.load(automata.dump(p)) for p in parts])) == flat(whole)
        assert len(parts) > 1


def test_scores_beyond_64_bits():
    a, l, r = (np.array(x, np.int64) for x in ([10**12, 7, 3_000_000], [10**13, 9, 3_000_001], [3 * 10**12, 8, 1 << 31]))
    assert floor_score(a, l, r).tolist() == [10**6 * int(x) ** 2 // (int(y) * int(z)) for x, y, z in zip(a, l, r)]


def nodes(rows, block=20, shared=4):
    """Rows of the trie from (conv_id, turn, role, text), with every prefix as a tuple."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs[c].append((t is not None, t or 0, r, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest(), x))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}
    new = {c: own.get(c - c % block, [])[:(h := zlib.crc32(str(c).encode()) % shared)] + v[h:] for c, v in own.items()}
    members, kids, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in new.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        own_saving = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own_saving
            leaves[k[:d]] += not kids[k]
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(new[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()), key=repr)


def made_conversations():
    rnd = random.Random(3)
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(["a", None, "b"]), rnd.choice(["x", "y  z", "", None])) for c in rnd.choices(range(90), k=300)]
    rows += [(20, i, "u", f"same {i}") for i in range(50)] + [(c, i, "u", f"same {i}") for c in (23, 24, 25, 31, 37) for i in range(40 + c % 3)]
    rows += [(1000 + c, 0, "system", "hot start") for c in range(60)] + [(1000 + c, 1, "u", f"q{c % 7}") for c in range(60)]
    return rows + [(None, 1, "a", "b"), (205, 0, "a", "alone")]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 50, "segment": 7}, {"shard_rows": 40, "segment": 5, "hot_rows": 30}])
def test_prefix_trie(spark, options):
    rows = made_conversations()
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "conv_id long, turn long, role string, text string, n int, p int, d int").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df, **options).collect()), key=repr)
    assert got == nodes(rows)


def test_prefix_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(none).collect() == []


def test_slots_are_minimal_and_perfect():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    assert sorted(prefix_trie.Slots(keys)(keys).tolist()) == list(range(len(keys)))
    assert len(prefix_trie.Slots(keys[:0])(keys)) == len(keys)


def test_equal_digests_of_different_turns_are_seen():
    turn = [b"x" * 32, b"y" * 32]
    batch = pa.RecordBatch.from_pydict({**{c: pa.array([1, 1], pa.int64()) for c in ("d", "p", "q")}, "above_p": pa.array([0, 0]), "above_q": pa.array([0, 0]),
                                        "n": pa.array([1, 1]), "member": pa.array([3, 4]), "words": pa.array([1, 1]), "turn": pa.array(turn)})
    assert pa.Table.from_batches(prefix_trie._count(iter([batch]), 100)).column("clash").to_pylist() == [True]


@pytest.mark.parametrize("name", ["op12_collocations", "op13_prefix_trie"])
def test_queries_against_sql(spark, name):
    assert compare(connect(SMALL), QUERIES[name](spark, SMALL), ORACLES[name]) in (None, "no rows")


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_quality"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.7)).all()
    both = rows[rows.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.95
    assert (both[both.quality == 1].predicted == 1).mean() > 0.98
    good, bad = (both[both.quality == q].score.to_numpy() for q in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.98


def test_held_out_labels_are_never_learned(spark):
    """Turning every held-out label round, and languages, sources and ids of other rows, changes no score."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(pairwise_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit(None).cast("string"), "strength": F.lit(1), "good": F.lit(0)})
    assert data(pairwise_quality.quality(docs, labels)) == data(pairwise_quality.quality(other, turned))


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(None, "no id"), (1, None), (1, None), (2, ""), (3, "word " * 200_000), (4, "$$$ *** ###"), (5, "a plain line of words")],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, 0), (5, 1), (7, None)], "doc_id long, quality int")
    got = pairwise_quality.quality(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert [r.score for r in pairwise_quality.quality(docs, labels.limit(0)).collect()] == [0.7] * 7
    assert pairwise_quality.quality(docs.limit(0), labels).collect() == []


def test_pairs_rank_by_the_feature_that_matters():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 5))
    good = x[:, 2] + 0.3 * rnd.normal(size=600) > 0
    w = pairwise_quality.fit_pairs(x[good], x[~good])
    assert np.argmax(np.abs(w)) == 2 and w[2] > 0 and np.abs(np.delete(w, 2)).max() < w[2] / 3


def test_level_of_the_quantile():
    assert pairwise_quality.best_level(np.array([0, 0, 0, 5, 5]), np.array([4, 3, 0, 0, 1])) in (2, 3)
    assert pairwise_quality.best_level(np.array([3.0, 4]), np.array([0.0, 0])) == 0
