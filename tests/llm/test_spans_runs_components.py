"""Personal data, periodic runs and whitening against brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import periodic_runs, personal_data, queries, whitening

# --- personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(p) <= 255 for p in hit.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0
    return True


def brute_strict(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "", re.A)
        if passes(kind, m.group())
    ]


def strict_spans(row):
    return [(s.kind, s.start, s.end) for s in row.spans if s.strict]


def test_personal_data_query_equals_plain_patterns(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op11_pii(spark, sf_dir).collect()
    assert len(found) == len(texts) and sum(r.n_email for r in found) > 0
    for r in found:
        spans = brute_strict(texts[r.doc_id])
        listed = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in PLAIN]
        assert set(listed) <= set(r.spans.split(",")) | {""}


ODD_TEXTS = [
    "a@b.c_x@y.z and q@w.e.r.t-@u.v",
    "x" * 30_000 + "@b.cd " + "1." * 9_000 + "@a.b@c.d",
    "1.2.3.4.5.6.7.8 0001.255.256.1 255.255.0255.1 999999999999.1.1.1",
    "4111 1111-1111 1111 and 41111111111111112 " + "4" * 20_000 + " 4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1",
    "+1 (569) 555-8554 +1((((((( +12 +1-2 +49 30 123456 7 8 9) . +" + "1" * 16,
    "é😀 mail é.a@b.co 😀 10.0.0.1 +44 20 7946 0958",
    "+1.2.3.4.5.6.7.8.9 @ @. a@. a@b a@-.- %@1.1.1.1",
    " ".join(f"u{i}@h.org 10.0.{i % 300}.9" for i in range(2_000)),
]


def test_strict_forms_of_odd_texts(spark):
    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, None, "", "a@b.c"])] + [(None, "a@b.c"), (0, ODD_TEXTS[0])]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, candidates string, code string")
    found = personal_data.find_personal_data(docs).collect()
    assert sorted((str(r.doc_id), sorted(strict_spans(r))) for r in found) == sorted(
        (str(i), sorted(brute_strict(t))) for i, t in rows
    )
    assert all(r.spans == sorted(r.spans, key=lambda s: (list(PLAIN).index(s.kind), s.start)) for r in found)
    assert personal_data.find_personal_data(docs.limit(0)).count() == 0


def test_loose_forms_are_added_where_the_trees_are_sure(spark):
    texts = [f"please call +1 (5{i % 10}9) 555-{1000 + i} or mail u{i}@h.org today" for i in range(400)]
    # Numbers after "order" of the same shape that do not pass.
    texts += [f"order +1 {i % 10} of it, order +2 {i} gone" for i in range(400)]
    texts += ["please call (569) 555-8554 now", "write to bob [at] mail (dot) example.com now", "order 1234.1234.1234.1234 now"]
    texts += ["please call +1 (569) 555-8554 now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans if not s.strict] for r in personal_data.find_personal_data(docs).collect()}
    assert found.pop(800) == [("phone", "(569) 555-8554")]
    assert found.pop(801) == [("email", "bob [at] mail (dot) example.com")]
    assert not any(found.values())


def test_trees_rank_shapes_by_how_often_they_pass(spark):
    base = personal_data.CODES // 4 * personal_data.CARD
    rows = [(base + c, half, 100, passed) for c, passed in ((0, 0), (600, 50), (1200, 100)) for half in (0, 1)]
    rows.append((base + 1300, 0, 0, 0))
    counts = spark.createDataFrame(rows, "code int, half int, n bigint, passed bigint")
    scores = personal_data.scored_codes(counts)
    by_code = {r.code - base: r.score for r in scores.collect()}
    assert len(by_code) == 4 and by_code[0] < by_code[600] < by_code[1200]
    assert {r.kind: r.threshold for r in personal_data.thresholds(counts, scores).collect()} == {personal_data.CARD: by_code[1200]}


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 1024, 5_000])
def test_running_results_of_long_arrays(spark, n):
    values = [(i * 7919) % 1000 - 300 for i in range(n)]
    df = spark.createDataFrame([(values,)], "v array<bigint>")
    both = df.select(
        personal_data.running(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"),
        personal_data.running(F.col("v"), F.lit(-(2**40)), F.greatest).alias("m"),
    ).first()
    assert both.s == np.cumsum(values).tolist() and both.m == np.maximum.accumulate(np.array(values, int)).tolist()


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op11_pii(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Arrow" not in plan and "Python" not in plan


# --- periodic runs


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            run = w[i : j + q]
            smaller = any(all(a == b for a, b in zip(run, run[d:])) for d in range(1, q))
            if len(run) >= max(6, 4 * q) and not smaller:
                out.append((i, len(run), q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return [x for i, x in enumerate(w) if i not in gone]


def some_words(rng, n, kinds):
    w = [b"%d" % rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 5 else 0):
        a, p = rng.randrange(n), rng.randint(1, n // 5)
        for i in range(a + p, min(n, a + rng.randint(2, 7) * p + rng.randrange(3))):
            w[i] = w[i - p]
    return w


def test_runs_against_brute_force():
    rng = random.Random(5)
    seen = 0
    for _ in range(400):
        texts = [some_words(rng, rng.choice([0, 1, 5, 6, 20, 90, 200]), rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(1, 5))]
        found, kept = periodic_runs.runs_of_texts(texts)
        for w, runs, rest in zip(texts, found, kept):
            expected = brute_runs(w)
            seen += len(expected)
            assert [tuple(r) for r in runs.tolist()] == expected and rest == collapsed(w, expected)
    assert seen > 500


def test_wavelet_successor_against_scan():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 100):
        values = rng.permutation(n)
        tree = periodic_runs.WaveletMatrix(values)
        lo = rng.integers(0, n, 200)
        hi = np.array([rng.integers(a, n) + 1 for a in lo])
        bound = rng.integers(0, n + 1, 200)
        expected = [min((v for v in values[a:b] if v >= c), default=n) for a, b, c in zip(lo, hi, bound)]
        assert tree.successor(lo, hi, bound, n).tolist() == expected


def test_runs_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.op12_periodic_runs(spark, sf_dir).collect()
    assert len(found) == len(texts) and sum(r.n_runs > 0 for r in found) > 10
    for r in found:
        w, h = (texts[r.doc_id] or "").encode().split(), zlib.crc32(str(r.doc_id).encode())
        n, g = len(w), h // 10
        if n > 1_500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(collapsed(w, runs))).hexdigest()


def test_runs_of_odd_rows(spark):
    rows = [(1, "a " * 9), (None, None), (None, "x y\tx y\nx y x y\xa0"), (2, ""), (2, ""), (3, " \t"), (4, "w " * 300_000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id bigint, text string, runs string")
    began = time.time()
    found = periodic_runs.periodic_runs(docs).collect()
    assert time.time() - began < 60
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    assert got == [
        ("1", 9, [(0, 9, 1)], "a"),
        ("2", 0, [], ""),
        ("2", 0, [], ""),
        ("3", 0, [], ""),
        ("4", 300_000, [(0, 300_000, 1)], "w"),
        ("None", 0, [], ""),
        ("None", 8, [], "x y x y x y x y\xa0"),
    ]
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


# --- whitening


@pytest.mark.parametrize("d", [1, 2, 3, 8, 40])
@pytest.mark.parametrize("kind", ["random", "steep", "equal", "rank", "ties"])
def test_eigenpairs_against_library(d, kind):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.normal(size=(d, d)))
    values = {
        "random": rng.random(d),
        "steep": np.logspace(0, -12, d),
        "equal": np.full(d, 3.0),
        "rank": np.r_[np.zeros(d // 2), rng.random(d - d // 2)],
        "ties": np.round(rng.random(d) * 3),
    }[kind]
    a = q @ np.diag(values * 1e5) @ q.T
    a = (a + a.T) / 2
    e, v = whitening.eigenpairs(a)
    scale = max(np.abs(a).max(), 1)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * scale * d, rtol=0)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13) and np.allclose(a @ v, v * e, atol=1e-12 * scale)


def test_polar_factor_is_the_sign_of_the_matrix():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(12, 12)))
    values = np.r_[-np.logspace(0, -9, 6), np.logspace(-8, 1, 6)]
    sign = whitening.polar(q @ np.diag(values) @ q.T)
    assert np.allclose(sign, q @ np.diag(np.sign(values)) @ q.T, atol=1e-6)
    assert whitening.polar(np.zeros((3, 3))) is None


def test_whitening_query_against_library(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    x = np.array([np.floor(1024 * np.array(e, float)) for e in rows["embedding"]]).astype(int) + 100_000
    n, total = len(x), x.sum(axis=0)
    z = x - total / n
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1], u[:, ::-1]
    found = queries.op13_whitening(spark, sf_dir).toPandas()
    assert len(found) == 8 * n and (found["n"] == n).all()
    exact = {i: int(((n * v - total) ** 2).sum()) for i, v in zip(rows["vec_id"], x)}
    assert [exact[i] for i in found["vec_id"]] == found["deviation"].tolist()
    y = found.pivot(index="vec_id", columns="component", values="whitened").loc[rows["vec_id"]].to_numpy()
    expected = z @ u[:, :8] / np.sqrt(e[:8])
    assert np.allclose(y, expected * np.sign((y * expected).sum(axis=0)), atol=1e-9)
    assert np.allclose(found.groupby("component")["explained"].first(), e[:8] / e.sum(), rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9


def test_whitening_of_odd_rows(spark):
    kind = "vec_id bigint, embedding array<float>, x string, at int"
    bad = [None, [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0]]
    good = [[0.0, 0.0], [3.0, 0.0], [3.0, 0.0], [0.0, 1.0]]
    rows = [(i, v, "x", 0) for i, v in enumerate(bad)] + [(None, v, "x", 0) for v in good]
    found = whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.vec_id, r.component) for r in found) == [(None, 1)] * 4 + [(None, 2)] * 4
    y = np.array([[r.whitened for r in found if r.component == c] for c in (1, 2)])
    assert np.allclose(y @ y.T / 4, np.eye(2)) and found[0].identity_error < 1e-12 and found[0].n == 4
    # Equal rows vary in nothing; one dimension alone varies below.
    found = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "x", 0)] * 3, kind)).collect()
    assert len(found) == 6 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in found} == {(None, None, None, 0)}
    found = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], "x", 0) for i in range(3)], kind)).collect()
    assert {r.component for r in found if r.whitened is None} == {2} and found[0].identity_error < 1e-12
    for empty in ([], [(1, None, "x", 0)], [(1, [], "x", 0)]):
        assert whitening.whiten(spark.createDataFrame(empty, kind)).collect() == []
    with pytest.raises(ValueError, match="1 to 2 entries"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], "x", 0), (2, [1.0, 2.0], "x", 0)], kind))


def test_deviation_beyond_64_bits(spark):
    big = 2.0**33
    rows = [(1, [big, -big]), (2, [0.0, 0.0]), (3, [-big, 5.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    x = [[int(v * 1024) + 100_000 for v in e] for _, e in rows]
    total = [sum(c) for c in zip(*x)]
    exact = {i: sum((3 * a - s) ** 2 for a, s in zip(v, total)) for (i, _), v in zip(rows, x)}
    assert {r.vec_id: int(r.deviation) for r in found} == exact
