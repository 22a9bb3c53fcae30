from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from threadloom.llm import infill, polytope, queries, whitening

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clashing(df):
    for name in ("id", "grp", "v", "white", "node", "component", "n_links", "block", "family", "links", "a.dot", "tick`s", "values", "x", "n", "deviation"):
        df = df.withColumn(name, F.lit(f"clash {name}"))
    return df


def brute_infill(i, text):
    t = text or ""
    h = [int(hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(t)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill(spark):
    more = [(20 + k, t, "en", "a", 0) for k, t in enumerate(["\x01\x02a\x02\x01", "\x020\x021\x02", "<P", "a<P>b", "<<S", "😀é漢\n\r\n", "<S>", "$1 \\ $0", "M><", "\x01", "xy"] * 9)]
    plain = spark.createDataFrame([(*r, 0) for r in cases.ROWS] + more, cases.SCHEMA)
    for df in (plain, cases.odd(spark).withColumns({"body": F.lit(1), "fim_n": F.lit("x"), "form": F.lit("x"), "marked": F.lit(2)})):
        got = infill.infilled(df).withColumn("back", infill.restored(F.col("fim_output"), F.col("fim_form"))).collect()
        assert len(got) == df.count() and all(r.back == (r.text or "") for r in got)
        for r in got:
            n, form, p, m, out = brute_infill(r.doc_id, r.text)
            assert (r.fim_n, r.fim_form, r.fim_output) == (n, form, out)
            assert (None if form == "plain" else len(r.fim_prefix), None if form == "plain" else len(r.fim_middle)) == (p, m)
    assert {r.fim_form for r in infill.infilled(plain).collect()} == {"plain", "psm", "spm"}
    assert infill.infilled(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("unit", ["word", "line"])
def test_infill_by_other_units(spark, unit):
    pattern = {"word": r"\s*\S+|\s+$", "line": r"[^\n]*\n|[^\n]+"}[unit]
    import re

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a b  c\nd e", " x\n\ny \n", "\x01 \x02\n\x01\x02 z", "one"] * 12)], "doc_id bigint, text string")
    for r in infill.infilled(df, unit=unit).collect():
        units = re.findall(pattern, r.text)
        assert "".join(units) == r.text and r.fim_n == len(units)
        if r.fim_form != "plain":
            assert r.fim_prefix + r.fim_middle + r.fim_suffix == r.text
            for cut in (r.fim_prefix, r.fim_prefix + r.fim_middle):
                assert cut in {"".join(units[:k]) for k in range(len(units) + 1)}


def test_infill_query(spark):
    texts = {r.doc_id: r.text for r in queries.documents(spark, DIR).collect()}
    got = queries.op11_marker_injection(spark, DIR).collect()
    assert len(got) == len(texts)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in got:
        assert tuple(r)[1:] == (*(x := brute_infill(r.doc_id, texts[r.doc_id]))[:4], sha(x[4]), sha(texts[r.doc_id] or ""))


def brute_links(rows, least=0.93):
    """n_links and component of every row, by all pairs."""
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    links = Counter()
    for n, a in enumerate(good):
        for b in good[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], np.float64) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    at[max(root(a), root(b))] = min(root(a), root(b))
    of = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            of[root(k)] = min(of.get(root(k), rows[k][0]), rows[k][0])
    return Counter((rows[k][0], links[k], of[root(k)] if rows[k][0] is not None else None) for k in range(len(rows)))


def vectors(rng, dims=16):
    rows, f = [], lambda x: [float(np.float32(y)) for y in x]
    for k in range(12):
        centre = rng.normal(size=dims)
        for _ in range(6):
            rows.append((len(rows), f(centre + rng.normal(size=dims) * [0.02, 0.2, 0.32][k % 3]), k % 2))
    # a chain of links, copies, one direction in other lengths, labels that differ
    for k in range(20):
        rows.append((len(rows), f([math.cos(k * 0.3), math.sin(k * 0.3), *[0] * (dims - 2)]), 3))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows += [(500, f(2 * np.array(rows[0][1])), rows[0][2]), (501, rows[0][1], None), (502, rows[0][1], 7), (503, rows[0][1][:5], 0)]
    return rows


ODD = [(600, None, 0), (601, [], 0), (602, [0.0] * 16, 0), (603, [1.0, None], 0), (604, [float("nan"), 1.0], 0), (605, [float("inf"), 1.0], 0), (None, [1.0, 2.0], 0), (None, None, None), (606, [1.0, 2.0], 0), (606, [1.0, 2.0], 0), (606, [-2.0, 1.0], 0), (607, [-2.0, 1.01], 0), (608, [5.0], 1), (609, [-5.0], 1), (610, [2.5], 1), (611, [3e38, 3e38], 4), (612, [1e-40, 1e-40], 4)]


@pytest.mark.parametrize("size", [2048, 3])
def test_near_vectors(spark, monkeypatch, size):
    """Against all pairs; with tiny blocks as with large ones."""
    monkeypatch.setattr(polytope, "SKETCH_BLOCK", size)
    monkeypatch.setattr(polytope, "VECTOR_BLOCK", size)
    rows = vectors(np.random.default_rng(5)) + ODD
    got = polytope.near_vectors(clashing(spark.createDataFrame(rows, SCHEMA))).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == brute_links(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert polytope.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (4, [-1.0, 0.0], 0)]
    got = polytope.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)])


def test_tight_blocks_are_linked_without_comparing(spark, monkeypatch):
    monkeypatch.setattr(polytope, "VECTOR_BLOCK", 40)
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in np.float32(rng.normal(size=8) * 0.01 + [9, 1, 0, 0, 0, 0, 0, 0])], 1) for k in range(300)]
    seen = []
    real = polytope.judged
    monkeypatch.setattr(polytope, "judged", lambda *a: seen.append(real(*a)) or seen[-1])
    got = polytope.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all((r.n_links, r.component_id) == (299, 0) for r in got) and len(got) == 300
    assert {r.verdict for r in seen[0].collect()} == {"all"} and seen[0].count() > 20


def test_polytope_recall():
    """Pairs at the threshold share a bucket and pass by their sketches; so does nearly no pair of random vectors."""
    rng = np.random.default_rng(0)
    u = polytope.units(rng.normal(size=(4000, 64)))
    w = rng.normal(size=u.shape)
    w = polytope.units(w - (w * u).sum(1, keepdims=True) * u)
    v = 0.93 * u + math.sqrt(1 - 0.93**2) * w
    a, b = polytope.codes(u), polytope.codes(v)
    assert (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean() > 0.999
    apart = lambda x, y: np.bitwise_count(polytope.sketches(x).view(np.uint64) ^ polytope.sketches(y).view(np.uint64)).sum(1)
    assert (apart(u, v) <= polytope.sketch_limit(0.93)).mean() > 0.9999 and (apart(u, u[::-1]) <= polytope.sketch_limit(0.93)).mean() < 0.001
    h = polytope.hadamard(np.eye(8))
    assert (h @ h.T == 8 * np.eye(8)).all()
    assert np.allclose(np.linalg.norm(polytope.rotated(u, 3), axis=1), 1)


def test_near_vectors_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/check_h/embeddings.parquet").filter("label IN (0, 1)").select("vec_id", "embedding", "label").collect()]
    ids, labels = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    x = polytope.units(np.array([r[1] for r in rows], np.float64))
    on = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.vec_id: r.n_links for r in polytope.near_vectors(df).collect()}
    expected = dict(zip(ids.tolist(), (on.sum(1) - 1).tolist(), strict=True))
    assert got.keys() == expected.keys() and all(got[k] <= expected[k] for k in got) and sum(got.values()) >= 0.999 * sum(expected.values())


def brute_whitening(rows, components=4):
    good = [(i, [int(math.floor(256 * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n = len(fit)
    s = [sum(int(x[k]) for x in {tuple(x) for _, x in good}) for k in range(fit.shape[1])]
    y = fit - np.array(s) / n
    value, vector = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-value)[:components]
    return good, n, s, value[order], vector[:, order], value.sum()


def test_whitening(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 6)) @ np.diag([3, 2, 1.5, 1, 0.5, 0.2]) + 5
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(base)] + [(900 + k, [float(x) for x in base[0]]) for k in range(80)]
    odd = [(None, [float(x) for x in base[1]]), (700, None), (701, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (702, [float("nan")] * 6), (703, [float("-inf")] * 6), (704, [-0.0] * 6)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").repartition(7)
    got = whitening.with_whitening(clashing(df)).collect()
    good, n, s, value, vector, trace = brute_whitening(rows + odd)
    assert Counter(r.vec_id for r in got) == Counter({i: 4 * c for i, c in Counter(i for i, _ in good).items()})
    known = {i: x for i, x in good}
    signs = {}
    for r in got:
        x = known[r.vec_id]
        k = r.component - 1
        assert r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        assert abs(r.explained - value[k] / trace) < 1e-9 and r.identity_error < 1e-9
        z = (np.array(x) - np.array(s) / n) @ vector[:, k] / math.sqrt(value[k])
        if abs(z) > 1e-3:
            signs.setdefault(k, np.sign(z) == np.sign(r.whitened))
            assert abs(z - (r.whitened if signs[k] else -r.whitened)) < 1e-8


def test_whitening_of_little(spark):
    """Empty tables and single vectors have no components; a plane in three dimensions has two; odd lengths are left out."""
    make = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert whitening.with_whitening(make([])).count() == 0
    assert whitening.with_whitening(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rng = np.random.default_rng(1)
    flat = [(k, [float(a), float(b), 0.0]) for k, (a, b) in enumerate(rng.integers(-9, 9, (50, 2)))]
    got = whitening.with_whitening(make([*flat, (99, [1.0, 2.0])])).collect()
    assert {r.component for r in got} == {1, 2} and {r.vec_id for r in got} == set(range(50)) and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12


def test_whitening_of_large_numbers(spark):
    """Sums and deviations stay exact where longs do not hold them, and a far mean costs no digits."""
    rng = np.random.default_rng(4)
    base = [[int(a) + 2**44 for a in v] for v in rng.integers(-1000, 1000, (200, 3))]
    df = spark.createDataFrame([(k, [a / 256 for a in v]) for k, v in enumerate(base)], "vec_id bigint, embedding array<double>").repartition(5)
    model, rows = whitening.fit(df, components=3)
    assert model.sums == tuple(sum(c) for c in zip(*base, strict=True)) and model.n == 200
    y = np.array([[a - 2**44 for a in v] for v in base], float)
    value = np.linalg.eigvalsh(np.cov(y.T, bias=True))[::-1]
    assert np.allclose(model.variances, value, rtol=1e-10) and whitening.identity_error(rows, model) < 1e-9
    assert whitening.deviations(np.array([[2**44] * 3]), 10**9, (5, 6, 7)) == [sum((10**9 * 2**44 - s) ** 2 for s in (5, 6, 7))]
