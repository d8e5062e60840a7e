"""Fixity audit, soft mixing, vector search and the pipeline."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cindergrid.llm import common
from cindergrid.llm import fixity as X
from cindergrid.llm import mixing as M
from cindergrid.llm import multiindex as N
from cindergrid.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, file string, node int"


def pages(spark, n=700):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5), "f", 1) for i in range(n)]
    return spark.createDataFrame([*rows, (None, None, None, None, None), (None, "u", "é", None, None), (3, "http://h/3", "<p>3</p>" * 3, "f", 1)], PAGES)


def test_records_are_warc(spark):
    rows = X.warc_records(pages(spark)).collect()
    assert len(rows) == 703
    by = {}
    for r in rows:
        by.setdefault(r.file, []).append(r)
        head, body, end = bytes(r.record).partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(end) == size + 4 and end.endswith(b"\r\n\r\n") and r.length == len(r.record)
    for own in by.values():
        own.sort(key=lambda r: r.number)
        assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()


def test_audit_finds_what_differs(spark):
    one = common.stage(X.warc_records(pages(spark)), "one")
    two = X.decayed(one).where("not (file = 1 and number >= 180)")
    found = {(r.file, r.number): r for r in X.audit(one, two).collect()}
    a, b = ({(r.file, r.number): hashlib.sha256(r.record).hexdigest() for r in t.collect()} for t in (one, two))
    assert set(found) == {k for k in a.keys() | b.keys() if a.get(k) != b.get(k)} and len(found) > 10
    assert all((r.sha256_one, r.sha256_two) == (a.get(k), b.get(k)) for k, r in found.items())
    assert X.audit(one, one).count() == 0
    none = one.where("false")
    assert X.audit(none, none).count() == 0 and X.audit(none, one).count() == 703


def test_tree_covers_ranges(spark):
    one = common.stage(X.warc_records(pages(spark, 600)), "one")
    levels = [level.collect() for level in X.tree(one)]
    assert len(levels) == 4 and len(levels[-1]) == len({r.file for r in levels[0]})
    for r in levels[1]:
        own = sorted((c for c in levels[0] if c.file == r.file and c.node // X.FANOUT == r.node), key=lambda c: c.node)
        content = "".join(c.hash for c in own)
        assert r.hash == hashlib.sha256(f"{own[0].first}|{own[-1].last}|{content}".encode()).hexdigest()


def test_fixity_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    frame = QUERIES["op1_merkle_fixity"](spark, SF)
    wanted = con.execute(SQL["op1_merkle_fixity"])
    names = [c[0] for c in wanted.description]
    rows = [dict(zip(names, r, strict=True)) for r in wanted.fetchall()]
    assert sorted(map(str, rows)) == sorted(str({n: r[n] for n in names}) for r in frame.collect()) and set(names) == set(frame.columns)


def test_posteriors_against_counts(spark):
    docs = spark.createDataFrame(
        [(1, "good fine good"), (2, "bad awful"), (3, "good bad"), (4, None), (5, "  "), (6, "new words only " * 100), (None, "Good")], "doc_id bigint, text string"
    )
    labelled = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x"), (9, "y"), (1, "x")], "k bigint, domain string")
    found = {r.k: r for r in M.posteriors(docs, labelled, ("x", "y")).collect()}
    own = {"x": ["good", "fine", "good", "good", "bad"], "y": ["bad", "awful"]}
    bucket = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(M.BUCKETS))).first()[0] for w in "good fine bad awful new words only".split()}
    prior = {"x": 6 / 9, "y": 3 / 9}
    for key, text in ((1, "good fine good"), (3, "good bad"), (4, ""), (6, "new words only " * 100), (None, "good")):
        words, logs = text.split(), {}
        for d in "xy":
            counts = Counter(bucket[w] for w in own[d])
            like = [math.log((counts[bucket[w]] + 0.5) / (len(own[d]) + 0.5 * M.BUCKETS)) for w in words]
            logs[d] = math.log(prior[d]) + (np.mean(like) * min(M.EVIDENCE, len(words)) if words else 0)
        share = np.exp([logs["x"], logs["y"]]) / np.exp([logs["x"], logs["y"]]).sum()
        assert found[key].p == pytest.approx(share.tolist()) and found[key].tokens == len(words)


@pytest.mark.parametrize("floor", [0.0, 1.0])
def test_rates_against_numpy(spark, floor):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.4, 0.3, 0.3], 300)
    tokens = draw.integers(0, 500, 300)
    members = spark.createDataFrame([(i, int(t), q.tolist()) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "k bigint, tokens bigint, p array<double>")
    targets = {"a": 0.45, "b": 0.35, "c": 0.2}
    rows = sorted(M.rates(members, targets, ("a", "b", "c"), floor).collect(), key=lambda r: r.k)
    rate = np.array([r.rate for r in rows])
    total = tokens.sum()
    now = p.T @ tokens / total
    goal = np.array(list(targets.values()))
    goal = goal * (now / goal).max() if floor else goal
    # the same descent in numpy
    gram = (p * tokens[:, None]).T @ p / total / np.sqrt(np.outer(goal, goal))
    step, mine = 1 / np.linalg.eigvalsh(gram).max(), np.ones(300)
    for _ in range(2000):
        mine = np.maximum(floor, mine - step * (p @ ((p.T @ (tokens * mine) / total - goal) / goal)))
    loss = [((p.T @ (tokens * r) / total - goal) ** 2 / goal).sum() for r in (np.ones(300), rate, mine)]
    assert (rate >= floor).all() and loss[1] <= loss[2] + 2e-2 * loss[0]
    if not floor:
        # the rates themselves need not be unique where they cannot meet the targets
        assert np.abs(rate - mine).max() < 0.05
        assert np.abs(p.T @ (tokens * rate) / total / goal - 1).max() <= 2e-3


def test_targets_out_of_reach_end_at_the_least_squares(spark):
    # both documents are half one domain, so nine tenths of one cannot be reached
    members = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 30, [0.5, 0.5])], "k bigint, tokens bigint, p array<double>")
    rows = M.rates(members, {"a": 0.9, "b": 0.1}, ("a", "b")).collect()
    share = sum(r.tokens * r.rate for r in rows) / 80
    loss = lambda x: (x - 0.9) ** 2 / 0.9 + (x - 0.1) ** 2 / 0.1
    assert loss(share) == pytest.approx(min(loss(x) for x in np.linspace(0, 1, 10_001)), rel=1e-3)
    assert {r.rate for r in M.rates(members, {"a": 0.0, "x": 1.0}, ("a", "b")).collect()} == {1.0}


def test_mixing_of_edge_documents(edge_docs, no_docs, labels):
    rows = M.fit(edge_docs, labels).collect()
    assert len(rows) == edge_docs.count() and all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 for r in rows)
    mixed = M.mix(edge_docs, labels)
    assert mixed.columns == edge_docs.columns
    before, after = (Counter(map(tuple, d.collect())) for d in (edge_docs, mixed))
    assert set(before) == set(after) and all(after[r] >= n for r, n in before.items())
    assert M.fit(no_docs, labels).count() == 0 and M.mix(no_docs, labels).count() == 0
    assert M.mix(edge_docs, labels.limit(0)).count() >= edge_docs.count()


def test_mixing_query_meets_its_targets(spark):
    found = QUERIES["op4_soft_mixing"](spark, SF).toPandas()
    total = found.tokens.sum()
    for domain, share in M.TARGETS.items():
        assert (found.tokens * found.rate * found[f"p_{domain}"]).sum() / total == pytest.approx(share, rel=5e-3)
    plan = QUERIES["op4_soft_mixing"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def exact(ids, data, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = (data * data[q]).sum(1)
        order = np.lexsort((ids, -score))
        out[int(ids[q])] = [int(ids[i]) for i in order if i != q][:k]
    return out


def test_cells_come_in_order():
    draw = np.random.default_rng(2)
    index = N.MultiIndex(draw.normal(size=(500, 8)))
    query = draw.normal(size=8)
    cells = list(index.order(query))
    width = len(index.books[1])
    score = [index.books[0][c // width] @ query[:4] + index.books[1][c % width] @ query[4:] for c in cells]
    assert sorted(cells) == list(range(index.cells)) and np.all(np.diff(score) <= 1e-12)


def by_rows(rows, k=20):
    """query_id, rank, vec_id, score of the nearest other rows of every row whose key is divisible by 20."""
    data = np.array([v for _, v in rows], np.float32).astype(float)
    found = []
    for i, (key, _) in enumerate(rows):
        if key % 20 == 0:
            scores = [(-float((data[j] * data[i]).sum()), rows[j][0]) for j in range(len(rows)) if j != i]
            found += [(key, n + 1, other, -minus) for n, (minus, other) in enumerate(sorted(scores)[:k])]
    return found


def test_search_on_edge_vectors(spark):
    draw = np.random.default_rng(5)
    good = [(i, draw.normal(size=6).round(1).tolist()) for i in range(1, 90)]
    same = [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 0.0]) for i in range(100, 180)]
    bad = [
        (200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (300, [1.0]),
        (320, []), (None, [1.0] * 6), good[0], good[19],
    ]
    table = spark.createDataFrame(good + same + bad, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as v", "2 as cell", "3 as label")
    rows = N.search(table).collect()
    # repeated keys are rows of their own, as candidates and as queries
    taking = good + same + [good[0], good[19]]
    assert sorted(rows) == sorted(by_rows(taking))
    twice = [(5, [9.0] * 6), (5, [-1.0] * 6), (20, [1.0] * 6), (20, [2.0] * 6), (7, [9.0] * 6)]
    assert sorted(N.search(spark.createDataFrame(twice, "vec_id bigint, embedding array<float>")).collect()) == sorted(by_rows(twice))
    few = N.search(table.where("vec_id in (20, 21, 22)")).collect()
    assert len(few) == 6 and N.search(table.where("false")).count() == 0 and N.search(table.where("vec_id = 40")).count() == 0


def test_search_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    wanted = exact(table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float))
    rows = QUERIES["op7_multi_index"](spark, sf).toPandas()
    assert rows.groupby("query_id").size().eq(20).all() and set(rows.query_id) == set(wanted)
    assert np.mean([len(set(own.vec_id) & set(wanted[q])) / 20 for q, own in rows.groupby("query_id")]) >= 0.9


def test_pipeline_stages(spark):
    docs = common.read(spark, SF, "documents")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = common.stage(step(spark, docs, SF), name)
        assert docs.columns == columns
        counts.append(docs.count())
        if name in ("quality", "near_duplicates"):
            assert all(texts[r.doc_id] == r.text for r in docs.collect())
    assert counts[0] >= counts[1] > counts[2] >= counts[3] > 0 and counts[4] >= counts[3]
    assert counts[1] > 0.8 * counts[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}
    assert all(len(r.ids) == 4 * r.length for r in rows)


def test_pipeline_on_no_documents(spark, tmp_path):
    for table in ("documents", "labels"):
        common.read(spark, SF, table).limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
