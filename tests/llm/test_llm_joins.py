"""The n-gram join, the filter audit and the whitening against brute force, and their defined cases."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOWER, SCHEMA, WORD, odd_rows

from lurewatch.llm import filter_audit, ngram_join, queries, whitening
from lurewatch.llm.common import table


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def true_links(texts):
    """All links, by comparing all pairs; the components; the number of links of each."""
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    found = {i: set() for i in texts}
    ids = sorted(i for i in texts if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 10 * min(len(sets[a]), len(sets[b])) >= 9 * max(len(sets[a]), len(sets[b])):
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 90 * (len(sets[a]) + len(sets[b]) - n):
                    found[a].add(b)
                    found[b].add(a)
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), len(found[i])) for i in texts}


def near_texts(seed, groups, size):
    """Copies with a few changed words, at similarities on both sides of 0.9; some copies of copies."""
    rng, out = random.Random(seed), []
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(60)]
    for _ in range(groups):
        first = [word() for _ in range(rng.choice((4, 40, 120, 400)))]
        now = first
        for _ in range(rng.randrange(1, size)):
            now = list(rng.choice((first, now)))
            for _ in range(rng.randrange(0, 1 + max(1, len(now) // 40))):
                now[rng.randrange(len(now))] = word()
            out.append(" ".join(now))
        out.append(" ".join(passage + [word() for _ in range(rng.choice((3, 20, 60)))]))
    return dict(enumerate(out))


def as_result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in frame.collect()}


def test_op11_matches_all_pairs(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = as_result(queries.op11_ngram_join(spark, data))
    want = true_links(texts)
    assert got == want and sum(n for _, _, n in want.values()) > 10


@pytest.mark.parametrize("hot, few, block_sets", [(32, 1 << 16, 1024), (3, 0, 4)])
def test_op11_near_copies(spark, monkeypatch, hot, few, block_sets):
    """The same links with hot columns thinned, ids by a bitmap, several blocks a component and an order that knows no hot shingle."""
    for name, value in (("HOT", hot), ("FEW", few), ("BLOCK_SETS", block_sets), ("CHUNK", 8)):
        monkeypatch.setattr(ngram_join, name, value)
    if not few:
        monkeypatch.setattr(ngram_join, "order", lambda docs: np.zeros(ngram_join.CELLS, np.int64))
    texts = near_texts(hot, 25, 14)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = true_links(texts)
    assert as_result(ngram_join.classified(docs)) == want and max(n for _, _, n in want.values()) > 4


def test_op11_product_keeps_every_link(spark):
    """The product's pairs hold all links, and few others."""
    texts = near_texts(8, 20, 10)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    _, sets = ngram_join.classes(docs)
    reps = {r.rep for r in sets.collect()}
    pairs = {(r.a, r.b) for r in ngram_join.product(sets.select(F.posexplode("firsts").alias("pos", "key"), "rep", "n", F.col("rep").alias("team"))).collect()}
    sets = {i: shingle_set(texts[i]) for i in reps}
    linked = {(a, b) for a in reps for b in reps if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])}
    assert linked and linked <= pairs and len(pairs) <= 3 * len(linked)


def test_op11_odd(odd, empty):
    got = {}
    for r in ngram_join.classified(odd.withColumn("rep", F.lit(1)).withColumn("key", F.lit("x"))).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.n_links))
    assert sum(map(len, got.values())) == len(odd_rows())
    assert all(got[k] == [(0, k, 0)] for k in (1, 2, 3))
    assert got[4] == [(1, 4, 0)] and got[5] == [(4, 5, 2)] and got[6] == [(4, 5, 2)] * 2
    assert got[7][0][1] == got[8][0][1] == 7 and got[7][0][2] == 1
    assert all(r[1] is None and r[2] == 0 for r in got[None])
    assert ngram_join.classified(empty).isEmpty()


def test_op12_matches_sql(spark, data):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    sql, ours = con.sql(queries.SQL["op12_filter_audit"]), queries.op12_filter_audit(spark, data)
    assert sorted(sql.columns) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(sql.columns).collect())) == sorted(sql.fetchall())


def failing(rows):
    """The mask of each row, by hand."""
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, *_ in rows:
        t = text or ""
        w = WORD.findall(t)
        fails = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and t in least and i > least[t])
        out.append(sum(1 << k for k, f in enumerate(fails) if f))
    return out


def audited(rows, masks, labels):
    """The whole report, order by order and document by document."""
    out = {}
    for order in permutations(range(5)):
        for (i, _, _, source, *_), mask in zip(rows, masks, strict=True):
            gone = False
            for step, k in enumerate(order, 1):
                one = out.setdefault((source or "", "".join("ABCDE"[x] for x in order), step), [0] * 6)
                fails = mask >> k & 1
                good, toxic = labels.get(i, (0, 0))
                for place, hit in enumerate((not fails and not gone, fails and not gone, fails and gone, mask == 1 << k, fails and not gone and good, fails and not gone and toxic)):
                    one[place] += bool(hit)
                gone = gone or fails
    for (part, order, step), one in list(out.items()):
        one.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == order[step - 1]) if len(one) == 6 else 0)
    return {k: tuple(v) for k, v in out.items()}


def test_op12_odd(spark, odd, empty):
    more = [(20, "A B # C", "en", "s1", 1), (21, "A B # C", "en", None, 1), (None, "A B # C", "en", "s1", 1), (19, "word " * 60, "en", "s1", 1), (22, " ".join(f"w{k}" for k in range(60)), "en", "s1", 1), (23, "ÄÖ ABC", "en", "s1", 1), (24, "\x1c \x85 a b", "en", "s1", 1)]
    rows = [(i, t, lang, s and s[:4], n) for i, t, lang, s, n in odd_rows()] + more
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit("clash")).withColumn("mask", F.lit(0))
    masks = failing(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.part, r.n_words, r.n_distinct, r.mask) for r in filter_audit.judged(docs).collect())
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    assert got == sorted((r[0] is None, r[0] or 0, r[3] or "", len(w), len(set(w)), m) for r, w, m in zip(rows, words, masks, strict=True))
    labels = spark.createDataFrame([(20, 1, 0), (20, 0, 1), (21, None, 1), (None, 1, 1), (22, 1, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    want = audited(rows, masks, {20: (1, 1), 21: (0, 1), 22: (1, 0)})
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert got == want and len(want) == 600 * len({p for p, _, _ in want})
    assert filter_audit.audit(empty, labels).isEmpty()


def test_op12_matrix_round_trip(spark):
    """Shards and dictionary give back every text's words; several blocks share the dictionary."""
    rng = random.Random(3)
    texts = {i: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(6)
    shards, words = filter_audit.matrix(docs)
    word = {r.code: r.word for r in words.collect()}
    assert len(set(word.values())) == len(word)
    found, n = {}, 0
    for s in shards.collect():
        n += 1
        for k, i in enumerate(s.doc_ids):
            a, b = s.indptr[k : k + 2]
            found[i] = sorted(w for c, m in zip(s.columns[a:b], s.counts[a:b], strict=True) for w in [word[c]] * m)
    assert n > 4 and found == {i: sorted(t.split()) for i, t in texts.items()}


def whitened_by_hand(rows):
    x = np.array([np.floor(1024 * np.array(v, float)) + 100_000 for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    k = min(8, x.shape[1])
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    exact = (n * x.astype(int).astype(object) - s.astype(int).astype(object)) ** 2
    return n, exact.sum(axis=1), c @ vectors / np.sqrt(values), values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_op13_matches_numpy(spark, size):
    rows = [(r.vec_id, r.embedding) for r in table(spark, f"/root/testdata/{size}", "embeddings").orderBy("vec_id").collect()]
    n, deviation, scores, share = whitened_by_hand(rows)
    got = queries.op13_whitening(spark, f"/root/testdata/{size}").toPandas()
    assert len(got) == 8 * n and (got.n == n).all() and (got.identity_error == got.identity_error[0]).all() and got.identity_error[0] < 1e-9
    assert np.array_equal(got[got.component == 1].sort_values("vec_id").deviation.to_numpy(), deviation.astype(np.int64))
    for k in range(8):
        own = got[got.component == k + 1].sort_values("vec_id")
        w = own.whitened.to_numpy()
        assert np.abs(w - np.sign(w @ scores[:, k]) * scores[:, k]).max() < 1e-8 and abs(own.explained.iloc[0] / share[k] - 1) < 1e-10


def test_op13_odd(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    good = [(i, rng.normal(size=3).round(3).tolist()) for i in range(30)] + [(None, [0.5, 0.25, -3.0]), (5, [9.0, 1.0, 1.0]), (5, [9.0, 1.0, 1.0]), (6, [2000.5, -3000.25, 12345.0])]
    bad = [(40, None), (41, [1.0, None, 2.0]), (42, [nan, 1.0, 1.0]), (43, [1.0, inf, 1.0]), (44, []), (45, [1.0, 2.0])]
    rows = good + bad
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("x")).withColumn("n", F.lit(0))
    got = whitening.whitened(frame).collect()
    n, deviation, scores, share = whitened_by_hand(good)
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in good for _ in range(3))
    for k in range(3):
        w = sorted((r.deviation, r.whitened) for r in got if r.component == k + 1)
        want = sorted(zip(deviation.astype(np.int64).tolist(), scores[:, k].tolist(), strict=True))
        sign = np.sign(sum(a[1] * b[1] for a, b in zip(w, want, strict=True)))
        assert [a[0] for a in w] == [b[0] for b in want] and all(abs(sign * a[1] - b[1]) < 1e-8 for a, b in zip(w, want, strict=True))
    few = lambda rows: whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count()
    assert few([]) == few(bad[:5]) == few([(1, [1.0, 2.0])]) == few([(1, [1.0, 2.0])] * 3) == 0
    assert few([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [7.0, 8.0])]) == 3  # one component: the others are zero
    huge = whitening.whitened(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [3.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in huge) and any(r.deviation is None for r in huge)


@pytest.mark.parametrize("values", [[9, 9, 9, 5, 5, 2, 1, 1, 1, 0], [7, 3, 3 - 1e-9, 1e-3, 1e-6], [4] * 12, [1e12, 1, 1e-3], [2]])
def test_op13_counts_and_clusters(values):
    """Equal and nearly equal eigenvalues: right values, orthogonal vectors, small residuals; inertia at each gap."""
    rng = np.random.default_rng(len(values))
    q = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    e, x = whitening.leading(v)
    top = max(values)
    want = [w for w in sorted(values, reverse=True)[:8] if w > 1e-9 * top]
    assert len(e) == len(want) and np.abs(e - want).max() < 1e-13 * len(values) * top
    assert np.abs(x @ x.T - np.eye(len(e))).max() < 1e-13 and np.linalg.norm(v @ x.T - x.T * e, axis=0).max() < 1e-13 * len(values) * top
    for s in (0.5 * top, 1.5 * top, -1.0):
        assert whitening._ldl_counts(v, s) == (sum(w > s for w in values), sum(w < s for w in values))


def test_op13_products_are_exact(spark):
    rows = [(i, [float(i % 7) * 1e4, -float(i) * 3e5 + 0.5, 0.25 * i]) for i in range(50)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    model = whitening.fit(frame)
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    n, s = len(x), [sum(r[k] for r in x) for k in range(3)]
    trace = sum(sum((n * r[k] - s[k]) ** 2 for r in x) for k in range(3)) / n**3
    assert abs(model.trace / trace - 1) < 1e-15 and model.n == n and [n * int(c) + r for c, r in zip(model.centre, model.rest, strict=True)] == s


