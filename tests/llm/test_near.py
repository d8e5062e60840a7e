"""Near-duplicate documents and repeated passages against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import DOCS, WORDS, prose, row

from cindergrid.llm import blocks, common
from cindergrid.llm import orderhash as O
from cindergrid.llm import passages as P
from cindergrid.llm.components import components
from cindergrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def unite(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("seed", "most"), [(0, 20), (1, 1_000_000), (2, 50)])
def test_components_are_union_find(spark, seed, most):
    draw = random.Random(seed)
    links = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 240)]
    frame = spark.createDataFrame([*links, (None, 3), (7, 7)], "a bigint, b bigint")
    rows = components(frame, links_per_task=most).collect()
    found = {r.node: r.root for r in rows}
    assert len(rows) == len(found)
    wanted = unite({n for link in links for n in link}, links)
    assert found == {n: r for n, r in wanted.items() if n != r}
    assert components(frame.where("false")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_aligned_is_the_common_subsequence(a, b):
    one, two = (O.labelled(np.array(x, np.uint64), 2) for x in (a, b))
    table = np.zeros((len(one) + 1, len(two) + 1), int)
    for i, x in enumerate(one):
        for j, y in enumerate(two):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    shared = table[-1, -1]
    wanted = shared / (len(one) + len(two) - shared)
    found = O.aligned(np.array(a, np.uint64), np.array(b, np.uint64), 2)
    assert (found >= 0.8) == (wanted >= 0.8 - 1e-12)
    if wanted >= 0.8:
        assert found == pytest.approx(wanted)


def test_sketch_keeps_text_order():
    words = np.arange(1, 9, dtype=np.uint64) * np.uint64(7919)
    marks = O.labelled(words)
    assert (O.sketches(marks) == O.sketches(marks.copy())).all()
    assert not (O.sketches(marks[::-1].copy()) == O.sketches(marks)).any()
    assert len(set(O.labelled(np.ones(20, np.uint64)).tolist())) == 16


def edited(text, places, mark):
    words = text.split()
    for i in places:
        words[i] = f"{mark}{i}"
    return " ".join(words)


def classes_of(rows):
    return {r.doc_id: r.class_id for r in rows}


def test_planted_near_copies(spark):
    rows = []
    for g in range(6):
        base = prose(10 + g, 240)
        rows.append(row(100 * g + 50, base))
        for i in range(12):
            rows.append(row(100 * g + i, edited(base, [(37 * i + 5) % 240, (61 * i + 90) % 240], f"w{i}x")))
    rows += [row(1000 + i, prose(40 + i, 200)) for i in range(20)]
    # half of the words are a passage that all share
    rows += [row(2000 + i, prose(99, 80) + "\n" + prose(60 + i, 80)) for i in range(20)]
    found = classes_of(O.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    for g in range(6):
        assert {found[100 * g + i] for i in (*range(12), 50)} == {100 * g}
    assert all(found[n] == n for n in found if n >= 1000)


def test_near_duplicates_of_edge_documents(edge_docs, no_docs):
    rows = O.near_duplicates(edge_docs).collect()
    assert len(rows) == edge_docs.where("doc_id is not null").count()
    found = classes_of(rows)
    assert found == {n: n for n in range(1, 13)} | {10: 1}
    kept = O.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count() - 1
    assert O.near_duplicates(no_docs).count() == 0 and O.keep_one(no_docs).count() == 0


def test_near_duplicate_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    found = classes_of(QUERIES["op5_order_minhash"](spark, SF).collect())
    hashes = common.WordHashes()
    words = {d.doc_id: (hashes.of(d.text) >> np.uint64(32)) for d in docs}
    links = [(a, b) for a, b in combinations(words, 2) if (words[a].tolist() == words[b].tolist()) or O.aligned(words[a], words[b]) >= 0.8]
    assert found == unite(words, links)


def test_planted_passages(spark):
    rows, passage = [], prose(777, 62)
    for i in range(6):
        own = prose(20 + i, 120).split()
        rows.append(row(i + 1, " ".join(own[:50]) + " " + passage + " " + " ".join(own[50:])))
    paragraph = prose(500, 90)
    near = edited(paragraph, [40], "other")
    rows += [row(11, prose(41, 60) + "\n" + paragraph), row(12, near + "\n" + prose(42, 70)), row(13, prose(43, 100))]
    line = prose(600, 13)
    rows += [row(20 + i, prose(70 + i, 40) + "\n" + line + "\n" + prose(90 + i, 40)) for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    found = P.repeated_passages(docs).collect()
    assert {r.doc_id: r.keeper_doc_id for r in found} == {2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 12: 11}
    left = {r.doc_id: r for r in P.without_passages(docs).collect()}
    texts = {r[0]: r[1] for r in rows}
    for i in (2, 3, 4, 5, 6):
        assert passage not in left[i].text and left[i].n_chars == len(left[i].text)
        assert left[i].text.split() == texts[i].replace(passage, " ").split()
    assert left[12].text.strip() == prose(42, 70)
    assert all(left[n].text == texts[n] for n in texts if n not in (2, 3, 4, 5, 6, 12))


def test_passages_of_edge_documents(edge_docs, no_docs):
    found = P.repeated_passages(edge_docs).collect()
    assert [(r.doc_id, r.keeper_doc_id) for r in found] == [(10, 1)]
    left = P.without_passages(edge_docs)
    assert left.columns == edge_docs.columns and left.count() == edge_docs.count() - 1
    assert P.repeated_passages(no_docs).count() == 0 and P.without_passages(no_docs).count() == 0


def test_bands_reach_the_wanted_recall():
    assert 1 - (1 - P.SIMILARITY**P.ROWS) ** P.BANDS >= 0.985
    draw = np.random.default_rng(4)
    met = 0
    for _ in range(200):
        a = draw.integers(1, 2**60, 80).astype(np.uint64)
        b = a.copy()
        b[int(draw.integers(0, 80))] += np.uint64(1)
        assert P.jaccard(a, b) >= 0.8
        met += bool(set(P.band_keys(a)) & set(P.band_keys(b)))
    assert met >= 190


def test_passage_query_leaves_no_long_repeat(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    spans = QUERIES["op10_paragraph_minhash"](spark, SF).collect()
    for r in spans:
        assert r.keeper_doc_id < r.doc_id and 0 <= r.start < r.end <= len(docs[r.doc_id])
        # what goes is in the keeper, word by word but for edited paragraphs
        words = common.WordHashes()
        a, b = (np.unique(common.shingles(words.of(t))) for t in (docs[r.doc_id][r.start : r.end], docs[r.keeper_doc_id]))
        assert len(np.intersect1d(a, b)) >= 0.5 * len(a)


def test_paragraph_families_against_all_pairs(spark):
    draw = random.Random(5)
    base = prose(900, 100).split()

    def changed(words, number, mark):
        out = list(words)
        for start in draw.sample(range(0, 100, 5), number):
            out[start + 2] = f"{mark}{start}"
        return out

    # paragraphs of one template at about 0.75, some with a copy at about 0.88 of their own
    texts = {}
    for i in range(60):
        own = changed(base, 2, f"v{i}x")
        texts[2 * i + 1] = " ".join(own)
        if i % 2:
            texts[2 * i + 2] = " ".join(changed(own, 1, f"c{i}x"))
    docs = spark.createDataFrame([row(k, t) for k, t in texts.items()], DOCS)
    hashes = common.WordHashes()
    words = {k: hashes.of(t) for k, t in texts.items()}
    bands = {k: set(P.band_keys(w)) for k, w in words.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if bands[a] & bands[b] and P.jaccard(words[a], words[b]) >= 0.8]
    wanted = unite(texts, links)
    table = common.stage(P._table(docs, "doc_id", "text"), "blocks")
    met = P._met(table)
    found = {r.k: r.keeper for r in P._near(met, P._cut(docs, "doc_id", "text", met, P._wanted(table))).collect()}
    assert found == {k: r for k, r in wanted.items() if k != r}
    assert 25 <= len(found) < 70


def test_passages_cut_anywhere_and_of_short_lines(spark):
    draw = random.Random(8)
    # sentences of about 25 words, so that a cut passage holds hardly a whole one
    long = [" ".join(w.lower().strip(".") for w in prose(300 + i, 90).split()) for i in range(8)]
    listed = "\n".join(" ".join(w.title() for w in prose(400 + i, 3).split()) for i in range(18))
    texts, spans = {}, {}
    for n, passage in enumerate([*(" ".join(t.split()[7 : 7 + 50 + 4 * i]) for i, t in enumerate(long)), listed, " ".join(long[0].split()[:49])]):
        for side in range(2):
            own = [f"h{n}x{side}x{i}" for i in range(90)]
            at = draw.randint(10, 80)
            head = " ".join(own[:at]) + " "
            texts[2 * n + side + 1] = head + passage + " " + " ".join(own[at:])
            spans[2 * n + side + 1] = (len(head), len(head) + len(passage), len(passage.split()))
    docs = spark.createDataFrame([row(k, t) for k, t in texts.items()], DOCS)
    found = {r.doc_id: (r.start, r.end, r.words, r.keeper_doc_id) for r in P.repeated_passages(docs).collect()}
    assert found == {k: (*spans[k], k - 1) for k in range(2, 20, 2)}


def test_passage_in_an_earlier_text_than_its_longest_copy(spark):
    """The first text has only a part of the passage; the whole of it is in the second and the third."""
    passage = [f"p{i}" for i in range(70)]
    rows = [row(n, " ".join([f"a{n}x{i}" for i in range(40)] + own + [f"b{n}x{i}" for i in range(40)])) for n, own in ((1, passage[20:65]), (2, passage), (3, passage))]
    found = [(r.doc_id, r.words, r.keeper_doc_id) for r in P.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()]
    assert found == [(3, 70, 2)]


def test_near_copies_in_a_family_against_all_pairs(spark):
    draw, base = random.Random(34), prose(950, 480).split()
    # texts at 0.78 to each other and one pair above 0.8, whose buckets all have another pivot
    chosen = []
    while len(chosen) < 60:
        places = set(draw.sample(range(5, 475, 6), 6))
        if all(len(places & c) < 2 for c in chosen):
            chosen.append(places)
    texts = {i + 1: " ".join(f"v{i}x{n}" if n in c else w for n, w in enumerate(base)) for i, c in enumerate(chosen)}
    same = sorted(chosen[19])[:2]
    other = draw.sample([p for p in range(5, 475, 6) if p not in chosen[19]], 4)
    texts[100] = " ".join(f"v19x{n}" if n in same else f"u{n}" if n in other else w for n, w in enumerate(base))
    hashes = common.WordHashes()
    words = {k: hashes.of(t) for k, t in texts.items()}
    keys = {k: set(O.sketches(O.labelled(w)).tolist()) for k, w in words.items()}
    links = [(a, b) for a, b in combinations(texts, 2) if keys[a] & keys[b] and O.aligned(words[a], words[b]) >= 0.8]
    found = classes_of(O.near_duplicates(spark.createDataFrame([row(k, t) for k, t in texts.items()], DOCS)).collect())
    assert links and found == unite(texts, links)


def test_runs_of_words_against_every_window(spark):
    """Copies, passages cut anywhere, loops of few words and rows of one key: each window of 50 words is looked up."""
    draw = random.Random(3)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text}
    shared = [prose(2000 + i, 150).split() for i in range(4)]
    for n in range(40):
        own = [f"z{n}x{i}" for i in range(60)]
        part, size = draw.choice(shared), draw.choice((49, 50, 51, 64, 90, 140))
        at = draw.randint(0, 150 - size)
        texts[10_000 + n] = " ".join(own[:30] + part[at : at + size] + own[30:])
        texts[20_000 + n] = texts[10_000 + draw.randrange(n + 1)]
    for n in range(6):
        texts[30_000 + n] = " ".join(["one two three"] * (30 + n) + [f"e{n}"] + ["one"] * 70)
    hashes = common.WordHashes()
    words = {k: [hashes[c] for c in t.split()] for k, t in texts.items()}
    first: dict[tuple, int] = {}
    for k in sorted(words):
        for i in range(len(words[k]) - 49):
            first.setdefault(tuple(words[k][i : i + 50]), k)
    wanted = set()
    for k, own in words.items():
        places = [i for i in range(len(own) - 49) if first[tuple(own[i : i + 50])] < k]
        begin = [i for n, i in enumerate(places) if n == 0 or i - places[n - 1] > 50]
        for i in begin:
            last = max(p for p in places if p >= i and not any(i < b <= p for b in begin))
            wanted.add((k, i, last - i + 50))
    docs = spark.createDataFrame([row(k, t) for k, t in texts.items()], DOCS)
    table = common.stage(P._table(docs, "doc_id", "text"), "blocks")
    found = P._repeated(P._cut(docs, "doc_id", "text", P._met(table), P._wanted(table))).collect()
    assert {(r.k, len(texts[r.k][: r.a].split()), r.words) for r in found} == wanted and len(found) == len(wanted)
    assert all(r.keeper < r.k and len(texts[r.k][r.a : r.b].split()) == r.words for r in found)
    assert len(wanted) > 60


def test_open_buckets_against_all_pairs(spark, monkeypatch):
    """Three buckets over several blocks: one large root and a few others, roots of one member, one root alone."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    draw = np.random.default_rng(9)
    base, sets, members = np.arange(100, dtype=np.uint32), {}, []
    for n in range(90):
        own = base.copy()
        own[draw.choice(100, 13, replace=False)] = 1000 * n + 500 + np.arange(13)
        sets[n] = own
        root = 0 if n < 40 else 1000 if n < 45 else n
        members += [(key, n, root, n // 2) for key in (1, 2) if key == 1 or n >= 45] + ([(3, n, 0, n)] if n < 40 else [])
    for n in range(40, 90, 6):
        sets[n + 100] = np.concatenate([sets[n][:95], np.arange(5, dtype=np.uint32) + 200_000 + 10 * n])
        members += [(1, n + 100, n + 100, n + 100), (2, n + 100, n + 100, n + 100)]
    rows = spark.createDataFrame(members, "key long, id long, root long, part long")
    words = spark.createDataFrame([(n, bytearray(w.astype("<u4").tobytes())) for n, w in sets.items()], "id long, w binary")
    found = blocks.settled(rows, words, lambda w: w, 0.8).collect()
    root, part = {m[1]: m[2] for m in members}, {m[1]: m[3] for m in members}
    near = [(a, b) for a, b in combinations(sets, 2) if root[a] != root[b] and part[a] != part[b] and len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8]
    assert near and unite(sets, near) == unite(sets, [(r.a, r.b) for r in found])
