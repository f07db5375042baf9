"""Operators 11 to 13 against brute force: ranked search, divergence of sources, near-duplicate vectors."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataq.llm import corpus_queries, cover_tree, dedup_queries, embedding_dedup, lexical_search, source_divergence

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LETTERS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
CLASH = "score string, rank string, n string, terms string, tf string, salt string, `w.x` string, term string, p string, group string"
TIES = ["c"] * 10


def texts():
    r = random.Random(3)
    words = ["Alpha", "beta", "É", "é", "gamma3", "42", "delta-x", "Ωmega", "ALPHA", "eta", "日本", "iota_", "k"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(120)]
    rows += [(120, None), (121, ""), (122, "... --- !!!"), (123, "alpha " * 20_000), (7, "alpha beta"), (7, "alpha beta"), (None, "alpha beta"), (124, "alpha beta"), (125, "x" * 100_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *TIES) for i, t in texts()], f"doc_id long, text string, {CLASH}").repartition(5)


def ranked_by_brute_force(rows, items, top=20):
    held = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    n, words = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(Counter)
    for item, t in items:
        asked[item].update(WORD.findall((t or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for doc, tf, size in held:
            m = 75 + 25 * size * n // words
            scores.append((sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 12 * m)) for t, k in terms.items() if t in tf), doc))
        best = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:top]
        out += [(item, k + 1, doc, score) for k, (score, doc) in enumerate(best)]
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta BETA"), (2, "é 42 nowhere"), (3, None), (4, ""), (5, "日本 gamma3 gamma3 k"), (6, "unheard of"), (None, "eta k"), (8, "delta"), (8, "x iota"), (9, "x" * 100_000)]


def test_lexical_search_ranks_as_brute_force(spark, docs):
    items = spark.createDataFrame([(i, t, "c", "c") for i, t in ITEMS], "item_id long, text string, score string, doc_id string")
    found = sorted((tuple(r) for r in lexical_search.search(docs, items).collect()), key=str)
    assert found == ranked_by_brute_force(texts(), ITEMS)


def test_items_in_blocks_are_ranked_as_in_one(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    monkeypatch.setattr(lexical_search, "MOST_ITEMS", 3)
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 4)
    monkeypatch.setattr(lexical_search, "BLOCK_ROWS", 7)
    blocks = [b.num_rows for b in lexical_search.in_item_blocks(items, 3)]
    assert len(blocks) > 2 and sum(blocks) == len(ITEMS)
    assert sorted((tuple(r) for r in lexical_search.search(docs, items, 5).collect()), key=str) == ranked_by_brute_force(texts(), ITEMS, 5)


def test_lexical_search_of_nothing(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.search(docs.where("false"), items).collect() == []
    assert lexical_search.search(docs, items.where("false")).collect() == []


def test_merged_rows_are_sums():
    r = np.random.default_rng(0)
    dense = r.integers(0, 5, (6, 9)) * 10**12
    rows, docs = np.nonzero(dense)
    offsets = np.searchsorted(rows, np.arange(7))
    columns, sums = lexical_search.merged(np.array([0, 3, 5]), np.array([2, 1, 7]), offsets, docs.astype(np.uint16), dense[rows, docs])
    want = 2 * dense[0] + dense[3] + 7 * dense[5]
    assert (want[columns] == sums).all() and (want[np.setdiff1d(np.arange(9), columns)] == 0).all()


def diverging_by_brute_force(rows, most=200, min_docs=3):
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = LETTERS.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in df[lang].items() if n >= min_docs)
        groups = {s: {t: c[t] for t in kept} for (g, s), c in counts.items() if g == lang}
        every = {t: sum(c[t] for c in groups.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in groups.items()}, share(every)
        for s in groups:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in groups if o != s]
            terms = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < most]
    return sorted(out)


def sourced():
    r = random.Random(8)
    words = ["Alpha", "alpha", "béta", "Ωmega", "eta3theta", "日本", "x", "y", "z", "once", "ZZ", "é", "É"]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["a", "b", "c", None]), " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for _ in range(150)]
    rows += [("fr", "a", "rare"), ("fr", "b", None), ("it", "a", ""), ("en", "d", "123 !!"), ("en", "e", "hapax"), ("en", "big", "alpha beta " * 30_000), ("de", "a", "x"), ("de", "a", "x")]
    return rows


def test_source_divergence_is_that_of_brute_force(spark, monkeypatch):
    rows = spark.createDataFrame([(k, *r, *TIES) for k, r in enumerate(sourced())], f"doc_id long, lang string, source string, text string, {CLASH}").repartition(4)
    found = lambda: sorted(tuple(r) for r in source_divergence.divergences(rows).select("lang", "source", "part", "item", "value", "rank").collect())
    want = diverging_by_brute_force(sourced())
    assert found() == want
    monkeypatch.setattr(source_divergence, "MOST_GROUPS", 2)  # joined in parts instead of broadcast
    assert found() == want
    assert source_divergence.divergences(rows.where("false")).collect() == []
    few = sorted(tuple(r) for r in source_divergence.divergences(rows, 2, 3).select("lang", "source", "part", "item", "value", "rank").collect())
    assert few == diverging_by_brute_force(sourced(), 3, 2)


def test_billionths_stay_exact_where_a_product_would_overflow(spark):
    r = random.Random(1)
    pairs = [(0, 1), (1, 1), (9 * 10**15, 9 * 10**15)] + [(a, a + r.randrange(10**15)) for a in (r.randrange(8 * 10**15) for _ in range(50))]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", source_divergence.billionths(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in rows] == [10**9 * r.a // r.b for r in rows]


def linked_by_brute_force(rows, least=0.95):
    """rows (vec_id, list or None) to sorted (vec_id, n_links, component_id, kept)."""
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            x, y = rows[a][1], rows[b][1]
            if fine[a] and fine[b] and len(x) == len(y):
                x, y = (np.array(v, np.float64) / max(map(abs, v)) for v in (x, y))
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        least_id = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[a][0], len(links[a]), least_id, rows[a][0] is not None and rows[a][0] == least_id))
    return sorted(out, key=str)


def vectors():
    r = np.random.default_rng(11)
    rows = [(int(i), r.normal(size=16).tolist()) for i in range(150)]
    for size, noise in ((40, 0.05), (60, 0.2), (30, 0.3)):
        centre = r.normal(size=16)
        rows += [(len(rows) + k, (centre + noise * r.normal(size=16)).tolist()) for k in range(size)]
    same = rows[5][1]
    rows += [(1000 + k, same) for k in range(120)] + [(7, same), (None, same), (None, r.normal(size=16).tolist()), (3, rows[3][1]), (2000, [x * 1e-30 for x in same]), (2001, [-x for x in same])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [1.0, None] + [0.0] * 14), (3004, [math.nan] * 16), (3005, [math.inf] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [2.0, 4.0]), (3008, same[:15])]
    rows += [(4000, [3e-320] + [0.0] * 15), (4001, [1e300] + [0.0] * 15)]
    return rows


def test_embedding_dedup_links_what_brute_force_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CHUNK_BYTES", 8 * 16 * 40)  # several cells, some of several chunks
    rows = vectors()
    df = spark.createDataFrame([(i, v, *TIES) for i, v in rows], f"vec_id long, embedding array<double>, {CLASH.replace('`w.x`', 'rep')}").repartition(3)
    assert sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str) == linked_by_brute_force(rows)
    assert embedding_dedup.near_duplicates(df.where("false")).collect() == []
    assert {(r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df.where("embedding is null")).collect()} == {(0, 3000, True)}


def test_vectors_of_single_precision(spark):
    rows = [(i, np.float32(v).tolist()) for i, v in vectors() if v and len(v) == 16 and None not in v and i != 4000]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted((tuple(r) for r in embedding_dedup.near_duplicates(df).collect()), key=str) == linked_by_brute_force(rows)


@pytest.mark.parametrize(("width", "groups"), [(8, [(50, 0.1), (100, 0.3), (30, 0.02)]), (64, [(300, 0.15), (300, 0.25), (200, 0.35)]), (2, []), (3, [(200, 0.5)])])
def test_traversals_find_all_links_and_components(width, groups):
    r = np.random.default_rng(width)
    parts = [r.normal(size=(300, width))] + [r.normal(size=width) / math.sqrt(width) + noise * r.normal(size=(size, width)) / width for size, noise in groups]
    points = cover_tree.unit(np.concatenate(parts))
    r.shuffle(points)
    one, two = points[: len(points) // 2], points[len(points) // 3 :]
    weights = [r.integers(1, 5, len(x)) for x in (one, two)]
    trees = [cover_tree.Tree(x) for x in (one, two)]
    for t, x in zip(trees, (one, two), strict=True):
        assert (t.units == x[t.order]).all()
        far = [cover_tree.distances(t.units[a : a + 1], t.units[a:b]).max() for a, b in zip(t.low, t.high, strict=True)]
        assert (np.array(far) <= t.radius + 1e-7).all()  # covering radii
    links = one @ two.T >= 0.95
    counts, back, roots = cover_tree.traverse(*trees, math.sqrt(0.1), *weights).settle()
    assert (counts == links @ weights[1]).all() and (back == weights[0] @ links).all()
    a, b = np.nonzero(links)
    want = cover_tree.connected(a, b + len(one), len(one) + len(two))
    assert len(set(zip(want.tolist(), roots.tolist(), strict=True))) == len(set(want.tolist())) == len(set(roots.tolist()))


def test_traversals_leave_far_balls_alone(monkeypatch):
    """Clusters that are far apart are never compared point by point."""
    r = np.random.default_rng(2)
    centres = np.eye(20)
    tree = cover_tree.Tree(cover_tree.unit(np.repeat(centres, 100, axis=0) + 0.02 * r.normal(size=(2000, 20))))
    compared = []
    take = cover_tree._take
    monkeypatch.setattr(cover_tree, "_take", lambda links, linked, ka, kb: (compared.append(linked.size), take(links, linked, ka, kb)))
    counts, _, _ = cover_tree.traverse(tree, tree, math.sqrt(0.1), np.ones(2000, np.int64), np.ones(2000, np.int64)).settle()
    assert (counts == 100).all() and sum(compared) < 2000 * 2000 / 10


def test_blocks_of_chunks_meet_once_and_are_few():
    """All pairs of chunks that may be near meet in one pair of blocks; a chunk is sent to each block once, not to each other chunk."""
    r = np.random.default_rng(4)
    centres, radius, most = cover_tree.unit(r.normal(size=(60, 3))), r.uniform(0, 0.4, 60), math.sqrt(0.1)
    for per, reach in ((8, radius), (1, radius), (8, np.full(60, 2.0))):
        owner = np.repeat(np.arange(60), r.integers(0, 4, 60))
        blocks, met, n_sent = -(-len(owner) // per), [], 0
        for block in range(blocks):
            for other, held in embedding_dedup.meetings(block, per, owner, centres, reach, most):
                n_sent += len(held)
                met += [(i, j) for i in held[held // per == block] for j in held[(held // per == other)] if i <= j]
        near = {(i, j) for i in range(len(owner)) for j in range(i, len(owner)) if cover_tree.distances(centres[owner[i]][None], centres[owner[j]][None])[0, 0] <= reach[owner[i]] + reach[owner[j]] + most}
        assert near <= set(met) and len(met) == len(set(met)) and n_sent <= len(owner) * blocks


def test_loose_balls_of_few_points_are_no_nodes():
    """On vectors without structure points are compared as one product and not pair by pair of small balls."""
    points = cover_tree.unit(np.random.default_rng(6).normal(size=(1500, 16)))
    tree = cover_tree.Tree(points)
    size = tree.high - tree.low
    assert not ((size > 1) & (size <= 32) & (tree.radius > 0.3 + 1e-6)).any()
    counts, _, _ = cover_tree.traverse(tree, tree, math.sqrt(0.1), np.ones(1500, np.int64), np.ones(1500, np.int64)).settle()
    assert (counts == (points[tree.order] @ points[tree.order].T >= 0.95).sum(axis=1)[np.argsort(tree.order)]).all()


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_source_divergence", "op13_embedding_dedup"])
def test_queries_have_the_rows_of_their_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    queries, sql = corpus_queries.QUERIES | dedup_queries.QUERIES, corpus_queries.ORACLES | dedup_queries.ORACLES
    df = queries[name](spark, sf_dir)
    want = con.sql(sql[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in want.columns) for r in df.collect()))) == sorted(map(str, want.fetchall()))
