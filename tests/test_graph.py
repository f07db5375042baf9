"""Components and lineages of any shape; long chains take few rounds."""

import random

from pyspark.sql import functions as F

from strataq.operators import graph, ingest


def components(edges):
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return sorted((x, root(x)) for x in up)


def rounds_of(monkeypatch):
    made, keep = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name="step": (made.append(name), keep(df, name))[1])
    return made


def test_components_of_any_shape(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(k, (k * 7) % 97 + 2000) for k in range(2000, 2097)]
    links = spark.createDataFrame([*edges, (5, None), (None, 6), (None, None)], "a long, b long")
    got = sorted(tuple(x) for x in graph.connected(links).collect())
    assert got == [x for x in components(edges) if any(x[0] in e and e[0] != e[1] for e in edges)]
    assert graph.connected(links.where("a < 0")).collect() == []
    names = spark.createDataFrame([("b", "c"), ("c", "a"), ("x", "y")], "a string, b string")
    assert sorted(tuple(x) for x in graph.connected(names).collect()) == [("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")]


def test_a_chain_of_ten_thousand_versions_takes_few_rounds(spark, monkeypatch):
    made = rounds_of(monkeypatch)
    links = spark.range(1, 10_000).selectExpr("id + 1 AS document_id", "id AS supersedes")
    start = spark.createDataFrame([(10_000,), (77_777,)], "document_id long")
    found = ingest.lineage(links, start)
    assert found.where("root = 10000").count() == 10_000 and [tuple(r) for r in found.where("root = 77777").collect()] == [(77_777, 77_777)]
    assert made.count("labels") - 1 <= 15


def test_a_shuffled_chain_takes_few_rounds(spark, monkeypatch):
    made = rounds_of(monkeypatch)
    order = list(range(2_000))
    random.Random(3).shuffle(order)
    got = graph.connected(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"))
    assert {r.component for r in got.collect()} == {0} and got.count() == 2_000
    assert made.count("labels") - 1 <= 15


def test_versions_of_one_source_are_chained_in_one_run_over_them(spark):
    """The next version is found by a running minimum: no frame reaches to the end of the group, which would be quadratic in it."""
    docs = spark.range(3_000).selectExpr("id AS document_id", "'o' AS owner_id", "'u' AS source_uri", "'t' AS title", "id % 2 = 0 AS is_url", "if(id % 5 = 0, 'failed', 'ready') AS status")
    chained = ingest.chain_versions(docs).select("document_id", "version", "supersedes", "superseded_by")
    want = []
    for parity in (0, 1):
        own = [k for k in range(3_000) if k % 2 == 1 - parity]
        ready = [k for k in own if k % 5]
        place = {k: i for i, k in enumerate(ready)}
        n = 0
        for k in own:
            last, following = (ready[n - 1] if n else None), (ready[place[k] + 1] if k in place and place[k] + 1 < len(ready) else None)
            want.append((k, n + 1, last, following))
            n += k in place
    assert sorted(tuple(r) for r in chained.collect()) == sorted(want)
    assert "unboundedfollowing" not in chained._jdf.queryExecution().executedPlan().toString().lower()


def test_many_starts_of_one_component_are_told_whole_in_few_bytes_and_tasks_side_by_side(spark, tmp_path):
    """Starts times documents come as tiles; all documents told in turn for each start took more than a byte a row, all in one task."""
    n = 8_001
    links = spark.range(1, n).selectExpr("id AS document_id", "0L AS supersedes")
    start = spark.range(n).where("id % 16 = 0").selectExpr("id AS document_id").union(spark.createDataFrame([(77_777,)], "document_id long"))
    ingest.lineage(links, start).write.parquet(str(tmp_path / "told"))
    told = spark.read.parquet(str(tmp_path / "told"))
    by_root = {r.root: (r.n, r.different, r.low, r.high) for r in told.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("different"), F.min("document_id").alias("low"), F.max("document_id").alias("high")).collect()}
    assert by_root == {k: (n, n, 0, n - 1) for k in range(0, n, 16)} | {77_777: (1, 1, 77_777, 77_777)}
    files = [f.stat().st_size for f in (tmp_path / "told").glob("*.parquet")]
    assert sum(files) < 0.5 * told.count()
    assert len([size for size in files if size > 10_000]) > 1


def test_tiles_end_where_their_component_does(spark):
    """Components of any size around those of a tile, by names."""
    sizes = [2, 255, 256, 257, 1_023, 1_024, 1_025, 1_500]
    ids = {s: [f"{s}-{k:04}" for k in range(s)] for s in sizes}
    links = spark.createDataFrame([(a, of[0]) for of in ids.values() for a in of[1:]], "document_id string, supersedes string")
    start = spark.createDataFrame([(name,) for of in ids.values() for name in of[:300] + of[:1]], "document_id string")
    got = ingest.lineage(links, start).groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("different"), F.count_distinct(F.substring_index("document_id", "-", 1)).alias("components"))
    assert {tuple(r) for r in got.collect()} == {(name, s, s, 1) for s, of in ids.items() for name in of[:300]}


def test_many_starts_of_one_owner_are_told_whole_in_few_bytes(spark, tmp_path):
    """Tiles hold one owner's documents: of two owners whose links run across, each start has its own owner's alone."""
    n = 8_001
    links = spark.range(2, n).selectExpr("id AS document_id", "id % 2 AS supersedes").union(spark.range(7, n, 50).selectExpr("id AS document_id", "id + 1 AS supersedes"))
    owners = spark.range(n + 50).selectExpr("id AS document_id", "if(id % 2 = 0, NULL, 'o') AS owner_id")
    ingest.lineage(links, spark.range(n).where("id % 16 < 2").selectExpr("id AS document_id"), owners).write.parquet(str(tmp_path / "told"))
    told = spark.read.parquet(str(tmp_path / "told"))
    by_root = {r.root: (r.n, r.different, r.strange) for r in told.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("different"), F.count_if(F.expr("(document_id - root) % 2 <> 0")).alias("strange")).collect()}
    assert by_root == {k: (n // 2 + 1 - k % 2, n // 2 + 1 - k % 2, 0) for k in range(n) if k % 16 < 2}
    assert sum(f.stat().st_size for f in (tmp_path / "told").glob("*.parquet")) < 0.5 * told.count()
