"""Secrets, toxicity, personal data, mixing and the pipeline."""

import hashlib
import heapq
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from huntlake.llm import mixing, sanitise, secret_scan, toxicity
from huntlake.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def spans(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if valid(k, m.group())]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


ODD = ["a@b.c_d@e.f x@y", "x@y.z.@q.r..s", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1.1", "4465758382889437 4539 1488 0343 6467 4539-1488--0343",
       "+1 (663) 555-6869 +44", "é+1 (663) 555-6869 ü a.b@c-d.de, 001.002.003.0004", "", "😀 x@y.zz 12.13.14.15", " 4" * 3000 + " x",
       "1.1.1.1 " * 1000, "a" * 100_000 + "@b.c", "9" * 100_000, "+999999999999999999999 4539148803436467"]


def test_base_spans(spark):
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(ODD)] + [(0, ODD[0], 1), (77, None, 2), (None, "p@q.r", 3)], "doc_id long, text string, base int")
    got = sanitise.find_personal(df).select("doc_id", "text", sanitise.printed(F.col("base")).alias("b")).collect()
    assert len(got) == len(ODD) + 3
    for r in got:
        assert r.b == spans(r.text)


def test_personal_query(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op6_personal_data"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        count = Counter(s.split(":")[0] for s in want.split(","))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(count[k] for k in PATTERNS)


def test_disclosing_terms(spark):
    rng = random.Random(1)
    common = [f"{a}{b}ord" for a in "abcdef" for b in "ghijk"]
    text = lambda *extra: " ".join([*rng.sample(common, 8), *extra, *rng.sample(common, 8)])
    docs = [(i, text("zorbax", "reach", "me@x.org") if i < 4 else text("quuxly", "or", "you@y.org") if i < 8 else text("quuxly") if i < 12 else text()) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_base": F.lit(1), "_owner": F.lit("x")})
    got = {r.doc_id: r for r in sanitise.sanitised(df).collect()}
    assert list(got[0].asDict()) == df.columns and len(got) == 60
    n, both = 60, {"zorbax": (4, 4, 4), "quuxly": (4, 4, 8)}
    for word, (n_both, n_entity, n_term) in both.items():
        ratio = np.log2(n * n_both / (n_entity * n_term)) / np.log2(n / n_entity)
        assert (ratio >= sanitise.GENERALISE) == (word == "zorbax")
    for i in range(60):
        assert "@" not in got[i].text and "zorbax" not in got[i].text
        assert ("[EMAIL]" in got[i].text) == (i < 8)
        if i >= 8:
            assert got[i].text == docs[i][1]
        elif i >= 4:
            assert "quuxly" in got[i].text
    none = df.limit(0)
    assert sanitise.sanitised(none).count() == 0 and sanitise.find_personal(none).count() == 0
    nulls = spark.createDataFrame([(None, None, None, 1), (1, None, None, 1)], "doc_id long, text string, source string, text_ int")
    assert sorted(map(tuple, sanitise.sanitised(nulls).collect()), key=repr) == sorted(map(tuple, nulls.collect()), key=repr)


def test_secrets(spark):
    rng = random.Random(4)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    good = [f'first line\napi_key = "{key(40)}" and more' if i % 2 else f"the token: {key(32)}" for i in range(40)]
    bad = [f"see http://host/path/{key(20)}/x" if i % 3 == 0 else f"number 44657583828{rng.randrange(10 ** 8)} here" if i % 3 == 1 else f"commit hash {key(40)} done" for i in range(60)]
    rows = [(i, t, 0.5) for i, t in enumerate(good + bad)] + [(0, good[0], 0.1), (500, None, 1.0), (501, "x" * 100_000 + "1", 1.0), (None, good[1], 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, probability double")
    got = secret_scan.scan(df).collect()
    kept, values = Counter(r.doc_id for r in got if r.kept), dict(rows_[:2] for rows_ in rows)
    assert set(kept) == {*range(40), None} and kept[0] == 2
    for r in got:
        if r.doc_id is not None:
            assert hashlib.sha256(values[r.doc_id][r.start:r.stop].encode()).hexdigest() == r.value_sha256
    held = [r for r in got if r.doc_id is not None]
    train = secret_scan.candidates(df.where("doc_id % 2 = 0")).withColumn("label", (F.col("doc_id") < 40).cast("double"))
    test = secret_scan.scan(df.where("doc_id % 2 = 1"), train).collect()
    assert np.mean([r.kept == (r.doc_id < 40) for r in test]) > 0.9 and held
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_secrets_query_has_no_python(spark, sf):
    df = QUERIES["op4_secret_scan"](spark, sf)
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
    tokens = {(r.doc_id, m.start(1)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()
              for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
    assert tokens == {(r.doc_id, r.start) for r in df.collect() if r.kept}


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.random((1500, 6)) < 0.3
    score = x @ np.array([2.0, 1.5, 1.0, 0, 0, -1.0]) + rng.logistic(size=1500) * 0.5
    grades = np.digitize(score, [1.0, 2.5])
    rows, cols = np.nonzero(x)
    w, t = toxicity.fit_ordinal(rows, cols, grades, 6)
    assert t[0] < t[1] and w[0] > w[1] > w[2] > 0.5 > abs(w[3]) and w[5] < 0
    p = toxicity.Ordinal({}, t).at_least(x @ w)
    assert (np.digitize(p.sum(axis=1), [0.5, 1.5]) == grades).mean() > 0.7


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"{a}{b}e" for a in "abcdefgh" for b in "klmnop"]
    def text(i):
        return " ".join(rng.sample(plain, 20) + (["vile"] * (i % 4 == 0) + ["nasty", "Foul!"] * (i % 8 == 0)) + rng.sample(plain, 10))
    docs = [(i, text(i), "score") for i in range(400)]
    df = spark.createDataFrame(docs + [(900, None, None), (901, "", None), (None, "vile", None), (4, docs[4][1], "again"), (902, "vile " * 50_000, "")], "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    got = [r for r in toxicity.score(df, model).collect()]
    assert len(got) == 405
    for r in got:
        if r.doc_id is not None and r.doc_id < 400:
            assert r.toxic == (r.doc_id % 4 == 0) and 0 <= r.severity <= 2 and (r.grade > 0) == r.toxic
    assert {r.toxic for r in got if r.doc_id in (900, 901)} == {False} and all(r.toxic for r in got if r.doc_id in (None, 902))
    assert np.mean([r.severity for r in got if r.doc_id and r.doc_id % 8 == 0 and r.doc_id < 400]) > np.mean([r.severity for r in got if r.doc_id and r.doc_id % 8 == 4 and r.doc_id < 400])
    left = toxicity.without_toxic(df, model)
    assert left.columns == df.columns and left.count() == 302
    none = toxicity.fit(df, labels.limit(0))
    assert toxicity.without_toxic(df, none).count() == 405 and toxicity.score(df.limit(0), none).count() == 0


def test_toxicity_query(spark, sf):
    got = {r.doc_id: r.toxic for r in QUERIES["op5_toxicity"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([got[r.doc_id] for r in labels if not r.toxic]) < 0.05


@pytest.mark.parametrize("parts", [[1], [3, 1], [5, 3, 2], [1, 1, 1, 97], [7, 7, 7, 7, 1]])
def test_turns(parts):
    period, out = sum(parts), mixing.turns(parts)
    assert [t for _, _, t, _, _ in out] == list(range(period))
    given, j = Counter(), Counter()
    for lane, block, turn, release, due in out:
        j[lane] += 1
        assert block == j[lane] and release <= turn < due and (release, due) == mixing.window_of(block, parts[lane], period)
        given[lane] += 1
        assert all(abs(given[i] - (turn + 1) * p / period) < 1 for i, p in enumerate(parts))
    assert given == Counter(dict(enumerate(parts)))


def test_whole_parts():
    assert sum(mixing.whole_parts([5, 3, 1.5, 1e-9], 100)) == 100 and min(mixing.whole_parts([5, 1e-9], 100)) == 1
    with pytest.raises(ValueError):
        mixing.whole_parts([1.0] * 5, 4)


def test_schedule(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(i, ["a", "b", None, "c"][(i % 7) % 4], i) for i in range(700)] + [(3, "a", -1), (None, "b", -2), (None, "b", -3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _turn long")
    found, names = mixing.schedule(docs, [("a", 3.0), ("b", 1.0)], other=2.0, block=5, period=12)
    got = found.select("source", *[F.col(c).alias(k) for k, c in names.items()]).collect()
    assert len(got) == len(rows) and names["turn"] != "_turn" and set(docs.columns) <= set(found.columns)
    lane = lambda s: {"a": 0, "b": 1}.get(s, 2)
    size = Counter(lane(s) for _, s, _ in rows)
    assert {(lane(r.source), r.block, r.place) for r in got} == {(i, k // 5 + 1, k % 5) for i, n in size.items() for k in range(n)}
    blocks = {(lane(r.source), r.block): (r.turn, r.release, r.deadline) for r in got}
    assert len({t for t, _, _ in blocks.values()}) == len(blocks)
    # earliest deadline first, simulated turn by turn over all periods
    parts, want = mixing.whole_parts([3.0, 1.0, 2.0], 12), {}
    ready, following = [], [1, 1, 1]
    for turn in range(12 * 80):
        for i, p in enumerate(parts):
            while mixing.window_of(following[i], p, 12)[0] <= turn:
                heapq.heappush(ready, (mixing.window_of(following[i], p, 12)[1], p, i, following[i]))
                following[i] += 1
        _, _, i, j = heapq.heappop(ready)
        want[i, j] = (turn, *mixing.window_of(j, parts[i], 12))
    assert blocks == {k: want[k] for k in blocks}
    assert mixing.schedule(docs.limit(0), [("a", 1.0)])[0].count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and sorted(map(tuple, mixed.collect()), key=repr) == sorted(rows, key=repr)


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.withColumns({"_kept": F.lit(None).cast("int"), "turn": F.lit(None).cast("string"), "_previous": F.lit(None).cast("string"), "n_tokens": F.lit(None).cast("string")})
    nulls = spark.createDataFrame([(None,) * 9, (10 ** 7, None, "en", None, 0, 1, "", "x", None)], extra.schema)
    docs = extra.unionByName(nulls)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        rows = out.collect()
        sizes.append(len(rows))
        if name != "byte_bpe":
            assert out.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
        if name == "ngram_join":
            from test_llm_dedup import components_by_force
            left = {r.doc_id: r.text or "" for r in rows if r.doc_id is not None}
            assert all(d == c for d, (_, c) in components_by_force(left).items())
        if name == "personal_data":
            assert not [r for r in rows if r.text and spans(r.text)]
    assert sizes[0] > sizes[1] > 0 and sizes[1] == sizes[2] == sizes[3] == sizes[4]
    assert all(r.intact for r in rows) and all(r.turn is not None for r in rows if r.doc_id is not None)


def test_pipeline_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_secret_scan_counts_words_of_all_documents_and_fits_on_all_findings(spark):
    # more words than any fixed number, most of them in documents without a candidate
    names = ["w" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(1000, 5000)]
    docs = [(i, " ".join(names)) for i in range(2)] + [(2, "see " + names[3999] + "9" + names[3998] + "12345678")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = secret_scan.dictionary(df)
    assert {r.word for r in known.collect()} == set(names)
    found = secret_scan.described(secret_scan.candidates(df), known).collect()
    assert [round(r.covered * len(r.value)) for r in found] == [len(names[3999] + names[3998])]
    # 20,300 findings, 300 of them of the rarer kind, all seen
    rows = spark.range(20_300).select(
        (F.col("id") % 20_000 < 300).cast("double").alias("label"), F.col("id").cast("string").alias("value"), F.lit("").alias("before"),
        *[(F.col("id") % 7).cast("double").alias(c) for c in secret_scan.FEATURES])
    seen = []

    def spy(rows):
        seen.append(rows.count())
        return rows

    real, secret_scan.pin = secret_scan.pin, lambda df: spy(real(df))
    try:
        assert secret_scan.fit(rows, trees=2, depth=2) is not None
    finally:
        secret_scan.pin = real
    assert seen == [20_300]
