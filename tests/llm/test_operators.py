"""Each operator against a brute-force version, and over nulls, empty and long texts, ties and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strataq.llm import base_queries, chat_format, decontamination, language_id, lm_scoring, ngram_join, packing, quality_rules, sharding, suffix_dedup, url_filters

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus() -> list[tuple]:
    """Copies, near copies, shared passages, short, empty, null and very long texts."""
    r = random.Random(5)
    syllables = ["an", "ther", "ion", "ñe", "que", "der", "ß", "ou", "lé", "st", "in"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows: list[tuple] = []
    passage = text(60)
    for i in range(30):
        rows.append((i, text(r.randint(1, 150)) + "\n" + (passage if i % 3 == 0 else text(20)) + " " + text(10)))
    base = rows[4][1]
    for i in range(30, 45):  # near copies of one text, each changed elsewhere
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    rows += [(45, base), (46, base), (47, None), (48, ""), (49, " \n\t "), (50, "two words"), (51, "TWO  words"), (52, "a" * 500), (53, "a" * 500), (54, "Two"), (55, "é" * 130)]
    rows += [(56, text(6000)), (57, "#### %%% " * 40), (58, "x " * 300), (46, base), (59, "1 2 3 4 5 6 7 8 9")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = ["lang", "score", "n", "node", "gram", "start", "rank", "size", "slot", "record", "chunk"]
    return spark.createDataFrame([(i, t, "en" if i % 2 else None, *(["c"] * 10)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def joined_by_brute_force(rows):
    """doc_id, set size and component of each row: rows that repeat a doc_id are one document, empty sets are alone."""
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()})
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and (100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) or rows[a][0] is not None and rows[a][0] == rows[b][0]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root(k)] += [i] * (i is not None)
    return sorted(((i, len(sets[k]), min(least[root(k)], default=None) if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def test_ngram_join_links_what_brute_force_links(docs, rows):
    assert sorted((tuple(r) for r in ngram_join.ngram_join(docs).collect()), key=str) == joined_by_brute_force(rows)


def near_texts(r, n_words, changes, copies):
    words = [f"w{r.randrange(10**6)}" for _ in range(n_words)]
    for _ in range(copies):
        own = list(words)
        for k in r.sample(range(n_words), r.randint(0, changes)):
            own[k] = f"w{r.randrange(10**6)}"
        yield " ".join(own)


@pytest.mark.parametrize("items", [1_000_000, 700])
def test_ngram_join_of_chains_and_large_groups(spark, monkeypatch, items):
    """Copies around the threshold, passages in many texts, null and repeated ids; with blocks of a few sets also."""
    monkeypatch.setattr(ngram_join, "GROUP_ITEMS", items)
    r = random.Random(items)
    texts = [t for size, changes, copies in ((40, 2, 30), (120, 6, 30), (200, 9, 12), (12, 1, 8), (6, 1, 6), (5, 1, 3)) for t in near_texts(r, size, changes, copies)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [f"{t} {passage}" for t in near_texts(r, 25, 5, 10)] + [f"{' '.join(f'x{r.random()}' for _ in range(140))} {passage}" for _ in range(12)]
    words = texts[0].split(" ")
    texts += [" ".join(words[k:]) for k in range(1, 12)]  # shorter and shorter ones: a chain
    r.shuffle(texts)
    rows = [(r.choice([None, k, k, k, k, k - 1 if k % 9 == 1 else k]), t) for k, t in enumerate(texts)] + [(3, ""), (None, None), (500, texts[5]), (500, texts[60]), (None, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x) for x in ngram_join.ngram_join(df).collect()), key=str) == joined_by_brute_force(rows)


def test_ngram_join_links_through_null_and_repeated_ids(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = (" ".join(words[k : k + 50]) for k in (0, 5, 10))  # a and b are linked, b and c are, a and c are not
    x, y = " ".join(words[:30])[::-1], "another text of some other words than those"
    for rows in ([(1, a), (None, b), (3, c)], [(1, a), (2, b), (3, c)], [(1, x), (5, x), (5, y), (9, y)], [(None, x), (None, x)]):
        got = ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((tuple(r) for r in got), key=str) == joined_by_brute_force(rows)
        assert len({r.component_id for r in got}) == 1


def test_trie_prunes_but_finds_all():
    import numpy as np

    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(60), r.randint(1, 40))), np.uint64) for _ in range(80)]
    trie = ngram_join.Trie.of(sets)
    for a in sets:
        A = set(a.tolist())
        assert sorted(trie.probe(a, 80)) == [k for k, b in enumerate(sets) if 100 * len(A & set(b.tolist())) >= 80 * len(A | set(b.tolist()))]
    near = [np.unique(np.concatenate([s[r.randint(0, 3) :], [r.randrange(60)]]).astype(np.uint64)) for s in sets for _ in range(3)]
    alike = [[100 * len(set(a.tolist()) & set(b.tolist())) >= 80 * len(set(a.tolist()) | set(b.tolist())) for b in near] for a in near]
    own = list(range(len(near)))
    for _ in near:
        own = [min(own[j] for j, x in enumerate(row) if x) for row in alike]
    groups = ngram_join.grouped(near, 80)
    assert [groups.of(k) for k in range(len(near))] == own


def kept_by_brute_force(spark, rows, length=100):
    """What suffix_dedup returns: a string goes if it also starts at a smaller (doc_id, tag of the text, start)."""
    rows = [(i, g, (t or "").encode()) for i, t, g in spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.hash("text")).collect()]
    first, expected = {}, []
    for i, g, raw in rows:
        for p in range(len(raw) - length + 1 if i is not None else 0):
            s = raw[p : p + length]
            first[s] = min(first.get(s, (i, g, p)), (i, g, p))
    for i, g, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1 if i is not None else 0):
            if first[raw[p : p + length]] < (i, g, p):
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, gap in zip(raw, gone, strict=True) if not gap)
        expected.append((i, len(raw), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(expected, key=str)


def test_suffix_dedup_removes_what_starts_earlier(spark, docs, rows):
    got = suffix_dedup.suffix_dedup(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == kept_by_brute_force(spark, rows)


def test_suffix_dedup_of_one_id_with_two_texts(spark, rows):
    a, b, c = rows[3][1], rows[6][1], rows[9][1]
    some = [(5, a + b), (5, "x" + b), (3, b[20:]), (7, c + a), (7, c), (None, a), (9, "yy" + a[5:]), (9, a)]
    df = spark.createDataFrame([(*r, "z") for r in some], "doc_id long, text string, `a.b` string")
    got = suffix_dedup.suffix_dedup(df, text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == kept_by_brute_force(spark, some)
    assert {r.record["a.b"] for r in got} == {"z"}


def test_suffix_dedup_across_the_parts_of_a_very_long_text(spark):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_400_000))
    some = [(1, long), (2, long[524_200:524_500] + "#" + long[1_048_500:1_048_700]), (3, long + "!")]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix_dedup.suffix_dedup(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (500, 2), 3: (1_400_000, 1)}


def test_sharding_is_gapless_and_grows_into_the_new_shard_only(docs, rows):
    got = sharding.assignment(docs, bucket_bytes=2000).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    once, again = (sharding.assignment(df, 3, bucket_bytes=8000).collect() for df in (docs, docs.repartition(7)))
    assert sorted(again) == sorted(once)  # slots too: the order doesn't depend on the partitioning
    by_id = [[r.slot for r in sorted(once, key=lambda r: r.doc_id) if r.shard == s] for s in range(3)]
    assert all(slots != sorted(slots) for slots in by_id)


def test_sharding_scatters_rows_that_are_alike(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("t"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(1)).alias("text"))
    scattered = sharding.scatter(docs, 4, 20_000)
    held = scattered.groupBy("shard", "bucket").agg(F.sum("size").alias("n")).collect()
    assert sum(r.n for r in held) == docs.agg(F.sum(F.octet_length("text") + 8)).first()[0]
    assert len({r.shard for r in held}) == 1 and max(r.n for r in held) < 2 * 20_000 * 4  # the shard holds what four were to hold
    slots = sorted(r.slot for r in sharding.gather(scattered).select("slot").collect())
    assert slots == list(range(100_000))


def test_shards_are_written_whole(docs, rows, spark, tmp_path):
    sharding.write_shards(docs.withColumns({"shard": F.lit("x"), "bucket": F.lit("y"), "a.b": F.lit("z")}), str(tmp_path / "out"), 4, 2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.record["shard"], r.record["bucket"], r.record["a.b"]) for r in back.collect()} == {("x", "y", "z")}
    key = lambda x: (x[0], x[1] or "")
    assert sorted(((r.record.doc_id, r.record.text) for r in back.collect()), key=key) == sorted(rows, key=key)


def test_packing_places_each_token_once(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    got = packing.pack(docs).collect()
    by, place = defaultdict(list), defaultdict(list)
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(own) == r.length
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))
        by[r.doc_id].append((r.start, r.length))
        place[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _ in rows)
    for i, pieces in by.items():
        assert sum(n for _, n in pieces) == len(ids[i]) * copies[i]
    for pieces in place.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048


def test_ids_are_the_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert t.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n", "<|endoftext|",  "a\r\n\tb  c", "ñandú—“x” 日本語 🙂 don't", "  lead", "0123456789 " * 5, "\x00\x85\u00a0x", "'S 'll"):
        assert packing.encode(text, path).tolist()[:-1] == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\u3000"])
def test_packing_takes_runs_of_a_million_blanks(blank):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "before <|endoftext|>" + blank * 1_000_000 + "after"
    assert packing.encode(text, public_tokenizers.path("byte_bpe_50k.json")).tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_column_generation_beats_first_fit_on_a_known_case():
    runs = packing.plan({6: 20, 5: 20, 4: 20, 1: 20}, 16)
    assert sum(n for n, _, _ in runs) == 20  # 6 + 5 + 4 + 1 fill a sequence
    made = Counter()
    for n, sizes, copies in runs:
        assert (sizes * copies).sum() <= 16
        made.update({int(s): int(c) * n for s, c in zip(sizes, copies, strict=True)})
    assert made == {6: 20, 5: 20, 4: 20, 1: 20}


def test_packing_of_many_rows_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 100)
    docs = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 2000, "one two three").alias("text")).repartition(5)
    got = packing.pack(docs)
    assert got.count() == 3000
    by = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("upto"), F.countDistinct("offset").alias("k"), F.count("*").alias("of")).collect()
    assert all(r.n == r.upto <= 2048 and r.k == r.of for r in by)
    assert sum(r.n for r in by) == 2000 * 4 + 1000 and len(by) <= 3000 // (2048 // packing.WIDTH) + 1


def test_sequences_are_padded_except_at_a_power_of_two(docs):
    ids = packing.sequences(packing.pack(docs, with_ids=True)).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in ids)


def chats(spark):
    rows = [(1, 0, "system", "s & <|end|>"), (1, 1, "user", "hi"), (1, 2, "assistant", "<|turn|>a"), (1, 3, "user", None), (1, 4, "assistant", "b&amp;&lt;|"), (1, 5, "user", "bye"), (2, 0, "user", "only"), (3, 0, "assistant", ""), (4, 0, None, "x"), (4, 0, None, "x"), (None, 0, "assistant", "n"), (-9, 0, "user", "</s>[INST] ok [/INST]"), (-9, None, "assistant", "t<|text|>")]
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string"), rows


def test_chat_format_reads_back(spark):
    turns, rows = chats(spark)
    examples = chat_format.format_chats(turns)
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert examples.where("loss_start is not null").count() == sum(r == "assistant" for said in by.values() for _, r, _ in said)
    got = {r.conv_id: r for r in chat_format.read_back(examples).collect()}
    for c, said in by.items():
        said = sorted(said)
        loss = "".join(t for _, r, t in said if r == "assistant")
        r = got[c]
        assert r.n_turns == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf_dir}/conversations.parquet')")
    rel = con.sql(base_queries.OP5_SQL)
    df = base_queries.op5_chat_format(spark, sf_dir)
    assert sorted(tuple(r[c] for c in rel.columns) for r in df.collect()) == sorted(rel.fetchall())


def test_url_rules_and_templates(spark):
    urls = [None, "no scheme", "http://A.COM/en/x?q#f", "https://www.example.com/en/7", "http://b.net/de/1", "x://example.net/de/81", "http://a.org/es/", "http://com?x/en/", "://h/p#", "http://notcom.community/en/"]
    bad, good = [f"http://s.org/{p}/{k}" for p in ("es",) for k in range(40)], [f"http://t.net/de/{k}" for k in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls + bad + good)), "page_id long, url string").withColumn("template", F.lit("clash"))
    got = {r.page_id: r for r in url_filters.judge_urls(pages).collect()}
    assert [(got[k].host, got[k].path) for k in (0, 1, 2, 7, 8)] == [("", ""), ("", ""), ("a.com", "/en/x"), ("com", ""), ("h", "/p")]
    assert [got[k].rule for k in range(10)] == [None, None, "com/en/", "example.com/en/7", "net/de/", "example.net/de/8", "org/es/", None, None, None]
    assert [got[k].verdict for k in range(2, 7)] == ["block", "allow", "allow", "block", "block"]
    assert len(got) == len(urls + bad + good)


def test_url_templates_reject_by_purity(spark):
    rules = [url_filters.Rule("block", "h.org", "/spam/1"), url_filters.Rule("allow", "h.org", "/good/1")]
    urls = [f"http://h.org/{p}/{k}" for p in ("spam", "good") for k in range(100, 300)]
    got = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules, url_filters.TreeLimits(smoothing=1.0)).collect()
    assert {(u.path.split("/")[1], u.verdict) for u in got} == {("spam", "block"), ("good", "allow")}


def test_templates_without_labels_are_not_rejected(spark):
    rules = [url_filters.Rule("block", "a.org", "/es/")]
    urls = [f"http://a.org/es/{k}" for k in range(20)] + ["http://shop.example.info/about/us", "https://wiki.test/page", "http://a.org/fr/3"]
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got == dict.fromkeys(range(20), "block") | {20: "allow", 21: "allow", 22: "allow"}
    spam = url_filters.Rule("block", "b.org", "/x/spam1")  # urls beside it, of the same template, are rejected with it
    many = [f"http://b.org/x/spam{k}" for k in range(100, 200)] * 2 + ["http://b.org/x/other"]
    got = {r.page_id: r.verdict for r in url_filters.judge_urls(spark.createDataFrame(list(enumerate(many)), "page_id long, url string"), [spam, *rules], url_filters.TreeLimits()).collect()}
    assert got[200] == "block" and set(got.values()) == {"block"}


def templates_by_brute_force(urls, rules, limits):
    """page_id: (template, verdict), by the definitions in the operator's docstring."""
    rows = []
    for page_id, url in urls:
        m = re.search(r"^.*?://(.*)$", url or "", re.S)
        rest = m[1] if m else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(LOWER)
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        ruled = max(fits, key=lambda r: len(r.name)).verdict if fits else None

        def shape(x):
            if re.fullmatch("[0-9]+", x):
                return "{num}"
            if re.fullmatch(r"[0-9]+\.[A-Za-z0-9]+", x):
                return "{num}." + x.split(".")[1]
            return "{id}" if re.fullmatch(r"(?=.*[0-9])[0-9a-fA-F-]{8,}", x) else x

        rows.append([page_id, host, [shape(x) for x in path.split("/") if x], ruled])
    below = Counter((h, tuple(p[:k])) for _, h, p, _ in rows for k in range(min(len(p), limits.depth) + 1))
    for row in rows:
        _, h, p, _ = row
        rare = lambda k: not p[k].startswith("{") and (below[h, tuple(p[: k + 1])] < limits.min_support or below[h, tuple(p[: k + 1])] < limits.min_share * below[h, tuple(p[:k])])  # noqa: E731, B023
        row[2] = ["{word}" if k < limits.depth and rare(k) else x for k, x in enumerate(p)]
    for level in range(max((min(len(r[2]), limits.depth) for r in rows), default=0), 0, -1):
        groups = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r[2]) > level:
                groups[r[1], tuple(r[2][: level - 1])][r[2][level - 1]].append(r)
        for branches in groups.values():
            pool = [r for b in branches.values() for r in b]
            n = lambda rs: (len(rs), sum(r[3] is not None for r in rs), sum(r[3] == "block" for r in rs))
            all_n, all_l, all_b = n(pool)
            children = Counter(r[2][level] for r in pool)
            merge = []
            for name, own in branches.items():
                own_n, own_l, own_b = n(own)
                if len(branches) < 2 or own_l < limits.min_labels:
                    continue
                share = all_b / all_l
                near = abs(own_b / own_l - share) <= limits.max_z * math.sqrt(max(share * (1 - share), 0.01) / own_l)
                if near and sum(min(c / own_n, children[k] / all_n) for k, c in Counter(r[2][level] for r in own).items()) >= 1 - limits.max_distance - 1e-12:
                    merge.append(name)
            for name in merge:
                for r in branches[name]:
                    r[2][level - 1] = "{branch}"
    labelled = [r for r in rows if r[3]]
    prior = sum(r[3] == "block" for r in labelled) / len(labelled) if labelled else 0.0
    by = defaultdict(list)
    for r in rows:
        by[r[1], tuple(r[2])].append(r[3])
    purity = {k: (v.count("block") + limits.smoothing * prior) / (sum(x is not None for x in v) + limits.smoothing) if sum(x is not None for x in v) >= limits.min_labels else 0 for k, v in by.items()}
    return {i: ("/" + "/".join(p), v or ("block" if purity[h, tuple(p)] >= limits.purity else "allow")) for i, h, p, v in rows}


def test_url_tree_equals_brute_force(spark):
    r = random.Random(6)
    rules = [url_filters.Rule("block", "h.org", "/a/x/"), url_filters.Rule("block", "h.org", "/b/x/"), url_filters.Rule("block", "h.org", "/c/bad"), url_filters.Rule("allow", "h.org", "/a/good"), url_filters.Rule("allow", "i.net", "/d/"), url_filters.Rule("block", "h.org", "/d/e/f/"), url_filters.Rule("block", "h.org", "/d/g/f/")]
    urls = []
    for _ in range(2500):
        top = r.choice("abcd")
        path = [top]
        if top in "ab":
            path += [r.choice(["x", "x", "good", "other", "rare" + str(r.randrange(300))]), r.choice(["news", "12", "item"]), str(r.randrange(99))]
        elif top == "c":
            path += [r.choice(["bad", "bad1", "fine"]), f"{r.randrange(9)}.html"]
        else:
            path += [r.choice("egk"), "f", r.choice(["p", "q"]), "s", "t", "u", "v", "w", str(r.randrange(5))]
        urls.append(f"https://{r.choice(['h.org', 'www.h.org', 'i.net', 'H.org'])}/{'/'.join(path[: r.randint(1, len(path))])}{r.choice(['', '?q=1', '#z', '/'])}")
    urls += [None, "", "mailto:x", "http://h.org", "http://h.org/" + "very/" * 400 + "long", "x://" + "h" * 3000]
    rows = list(enumerate(urls))
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    for limits in (url_filters.TreeLimits(), url_filters.TreeLimits(min_labels=4, max_distance=0.5, max_z=4.0, purity=0.6, smoothing=2.0), url_filters.TreeLimits(min_labels=4, max_distance=0.5, max_z=4.0, depth=3)):
        got = {x.page_id: (x.template, x.verdict) for x in url_filters.judge_urls(pages, rules, limits).collect()}
        assert got == templates_by_brute_force(rows, rules, limits)
    assert any("{branch}" in t for t, _ in got.values()) and any(v == "block" for _, v in got.values())


def test_suffix_dedup_of_many_equal_rows(spark):
    text = " ".join(f"word{k} some{k % 7}" for k in range(100))
    rows = [(1, text)] * 400 + [(2, text + " end")] + [(3, "alone " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    ranges = suffix_dedup.repeats(docs).collect()
    assert max(len(r.ranges) for r in ranges) <= 3 * len(text) // 25  # not once more for each row
    got = suffix_dedup.suffix_dedup(docs).collect()
    size = len(text.encode())
    assert len(got) == 402 and {(r.doc_id, r.n_removed) for r in got} == {(1, 0), (2, size), (3, 0)}  # rows of one doc_id and text are one document


def test_language_id_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_id_without_letters_or_labels(spark, docs, rows):
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id in (47, 48, 49, 57, 59):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lm_scores_equal_brute_force(docs, rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    counts = [None, *(Counter(tuple(w[k : k + n]) for _, w in words for k in range(len(w) - n + 1)) for n in (1, 2, 3))]
    total, expected = sum(len(w) for _, w in words), []
    for i, w in words:
        score, backed = 0.0, 0
        for k in range(len(w)):
            most = min(k + 1, 3)
            for n in range(most, 0, -1):
                g = tuple(w[k - n + 1 : k + 1])
                if n == 1 or counts[n][g] >= 2:
                    score += math.log(counts[n][g] / (counts[n - 1][g[:-1]] if n > 1 else total)) + (most - n) * math.log(0.4)
                    backed += n < most
                    break
        expected.append((i, len(w), backed, score))
    got = sorted((r.doc_id, r.n_words, r.n_backed_off, r.score) for r in lm_scoring.lm_scores(docs).collect())
    for a, b in zip(got, sorted(expected), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3])


def test_decontamination_finds_copies_and_templates(spark):
    item = "If Anna buys 12 apples for 30 dollars at the old market near the river how much does each apple cost in the end"
    other = "a wholly different question about the height of seven mountains in the far north of that wide country"
    same = "Intro words here. " + item.upper().lower().replace("anna", "Anna") + " Trailing words."
    changed = item.replace("Anna", "Boris").replace("12", "15").replace("30", "45")
    mixed = " ".join(w if k % 3 else "zz" for k, w in enumerate(item.split()))
    docs = spark.createDataFrame([(1, same, 0), (2, changed, 0), (3, mixed, 0), (4, None, 0), (5, "", 0), (6, other[:40], 0), (None, item, 0), (7, item + " " + "filler " * 3000, 0), (7, item, 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(10, item, "x"), (11, other, "x"), (12, None, "x"), (13, "short", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated_pairs(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (7, 10)}


def leaks_by_brute_force(docs, bench, window=8, literals=4, shortest=1):
    """Pairs to be reported: coverage of an item by windows that meet it, alignment by alignment, with consistent slots."""
    parts = re.compile(r"\d[\d.,]*|[\u4e00-\u9fff\u3040-\u30ff]|[^\W\d_\u4e00-\u9fff\u3040-\u30ff]+")

    def read(text):
        words = parts.findall(text or "")
        canon = []
        for k, w in enumerate(words):
            if w[0].isdigit():
                canon.append("#n")
            elif w[0] != w[0].lower():
                canon.append("#a")
            elif w in decontamination.UNITS and k and words[k - 1][0].isdigit():
                canon.append("#u")
            else:
                canon.append(w.lower())
        return words, canon

    def marks(words, canon, size, both=False):
        for k in range(len(words) - size + 1):
            own = canon[k : k + size]
            poor = size < window or sum(w[0] != "#" for w in own) < literals
            if not poor:
                yield k, (size, False, tuple(own))
            if poor or both:
                yield k, (size, True, tuple(w.lower() for w in words[k : k + size]))

    found = set()
    for item_id, item in bench:
        words, canon = read(item)
        if item_id is None or len(words) < shortest:
            continue
        size = min(window, len(words))
        theirs = defaultdict(list)
        for k, m in marks(words, canon, size, True):
            theirs[m].append(k)
        for doc_id, text in docs:
            said, form = read(text)
            shifts = defaultdict(set)
            for k, m in marks(said, form, size) if doc_id is not None else ():
                for at in theirs.get(m, ()):
                    shifts[k - at].add(at)
            covered = set()
            for shift, places in shifts.items():
                own = {i for p in places for i in range(p, p + size)}
                values = {(words[i], said[i + shift]) for i in own if canon[i][0] == "#"}
                if not values or len({a for a, _ in values}) / len(values) >= 0.75:
                    covered |= own
            if covered and (len(covered) >= 0.5 * len(words) or len(covered) >= 30):
                found.add((doc_id, item_id))
    return found


def test_decontamination_equals_brute_force(spark, monkeypatch):
    r = random.Random(11)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in "xyz"]
    word = lambda: r.choice([*plain, *plain, "12", "3,5", "Anna", "Ohm", "kg", "Berlin", "7"])
    bench = [(k, " ".join(word() for _ in range(r.choice([2, 4, 5, 7, 8, 9, 14, 40])))) for k in range(40)]
    bench += [(90, "Der Bauer Hans verkauft 12 Äpfel, 15 Birnen, 20 Pflaumen für 30 Euro an Frau Schmidt; die Nachbarin Anna kauft 5 Kilo Kartoffeln, 3 Bund Möhren und 2 Gläser Honig.")]
    docs = []
    for k in range(120):
        words = [word() for _ in range(r.randint(0, 30))] + r.choice(bench)[1].split(" ") + [word() for _ in range(r.randint(0, 30))]
        if k % 3:
            words = [r.choice(["5", "Eva", w]) if w[0].isupper() or w[0].isdigit() else w for w in words]
        docs.append((k, " ".join(words)))
    chinese = "如果小明有十二个苹果他给了小红五个那么他现在还剩下多少个苹果请写出计算过程并回答"
    bench += [(91, chinese), (92, "lone"), (93, "what now"), (94, "If Anna buys 12 apples at the old market near the river how much does each of them cost in the end")]
    docs += [(910, "前面的文字" + chinese + "后面的文字还有一些"), (911, chinese[:15]), (912, "a Lone word"), (913, "so what now then"), (914, bench[-1][1].upper()), (915, "plain words before " + bench[-1][1].upper() + " and after it"), (916, bench[-1][1].title())]
    bench.append(bench.pop(40))
    docs += [(900, "Vorher. " + bench[-1][1] + " Nachher."), (901, bench[-1][1].replace("Hans", "Karl")), (None, bench[0][1]), (902, None), (903, "")]
    expected = leaks_by_brute_force(docs, bench)
    assert {(900, 90), (910, 91), (912, 92), (913, 93), (914, 94), (915, 94), (916, 94)} <= expected and (911, 91) not in expected and len(expected) > 60
    for most in (500_000, 50):  # all windows at once, or block by block
        monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
        got = decontamination.contaminated_pairs(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
        assert {(x.doc_id, x.item_id) for x in got.collect()} == expected


def test_decontamination_wants_consistent_slots(spark):
    item = "give 5 red cups and 5 blue cups and 5 green cups and 5 small cups to the good old man"
    apart = item.replace("5", "7", 1).replace("5", "8", 1).replace("5", "9", 1)
    docs = spark.createDataFrame([(1, item.replace("5", "6")), (2, apart)], "doc_id long, text string")
    bench = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert [r.doc_id for r in decontamination.contaminated_pairs(docs, bench).collect()] == [1]


def test_quality_counts_equal_brute_force(docs, rows):
    expected = []
    for i, t in rows:
        t = t or ""
        w = WORD.findall(t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(inside), failed))
    got = quality_rules.quality_rules(docs).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted(expected)
    assert not any(r.kept for r in got if r.base_failed)


def test_compression_bands_reject_noise_and_repetition(spark):
    r = random.Random(2)
    noise = " ".join("".join(r.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/") for _ in range(40)) for _ in range(200))
    loop = " ".join(f"{k % 7} the very same {k // 7 % 9} words again" for k in range(3000))
    plain = " ".join("".join(r.choice(["an", "ther", "ion", "que", "der", "ou", "st", "in", "re"]) for _ in range(r.randint(1, 3))) for _ in range(1500))
    got = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame([(1, noise), (2, loop), (3, plain)], "doc_id long, text string")).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_compression_bands_see_one_bad_stretch_anywhere():
    import base64

    import pyarrow as pa

    r = random.Random(4)
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))
    words = [word() for _ in range(900)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))[:n]
    noise = lambda n: base64.b64encode(r.randbytes(n)).decode()[:n]
    loop = ("the very same words again and again " * 200)[:3800]
    texts = {
        "noise at the end": (prose(12288) + noise(4000), False),
        "loop at the end": (prose(4096) + loop, False),
        "one chunk of noise in sixteen": (prose(20480) + noise(4096) + prose(40960), False),
        "prose with a rest": (prose(12288 + 1000), True),
        "prose of whole chunks": (prose(12288), True),
        "prose below one chunk": (prose(4095), True),
    }
    got = quality_rules.band_verdicts(pa.array([t for t, _ in texts.values()]), quality_rules.Bands())
    assert dict(zip(texts, got["fine"].tolist(), strict=True)) == {k: fine for k, (_, fine) in texts.items()}
    assert [bool(x == x) for x in got["chunk_low"]] == [True] * 5 + [False]


def test_compression_bands_equal_brute_force(docs, rows):
    import zstandard

    bands = quality_rules.Bands()
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=False)

    def within(raw):
        least, most = [(a, b) for n, a, b in bands.whole if len(raw) >= n][-1]
        return least <= len(squeeze.compress(raw)) / len(raw) <= most

    expected = {}
    for i, t in rows:
        raw = (t or "").encode()
        pieces = [raw[k : k + 4096] for k in range(0, len(raw) - 4095, 4096)] + [raw[-4096:]] * (len(raw) > 4096 and len(raw) % 4096 > 0)
        expected[i] = not raw or (within(raw) and all(map(within, pieces)))
    for r in quality_rules.quality_rules(docs).collect():
        assert r.kept == (expected[r.doc_id] and not r.base_failed)


def test_chat_format_of_a_very_long_conversation(spark):
    long = "<|turn|>&amp; x " * 60_000
    rows = [(1, k, "assistant" if k % 2 else "user", long if k == 1 else f"t{k}") for k in range(40)]
    got = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    loss = "".join(t for _, k, role, t in rows if k % 2)
    assert [(r.n_turns, r.loss_chars, r.loss_sha256) for r in got] == [(40, len(loss), hashlib.sha256(loss.encode()).hexdigest())]


def test_prototypes_do_not_depend_on_the_partitioning(spark, docs, monkeypatch):
    names, protos = language_id.learn(docs)
    monkeypatch.setattr(language_id, "MOST_TRIGRAMS", 50)
    again, others = language_id.learn(docs.repartition(7))
    assert names == again and (protos == others).all()


OPERATORS = {
    "ngram_join": ngram_join.ngram_join, "suffix_dedup": suffix_dedup.suffix_dedup, "assignment": sharding.assignment, "pack": packing.pack, "identify": language_id.identify,
    "lm_scores": lm_scoring.lm_scores, "quality_rules": quality_rules.quality_rules,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).collect() == []


def test_other_empty_tables(spark, empty):
    turns, _ = chats(spark)
    assert chat_format.read_back(chat_format.format_chats(turns.where("false"))).collect() == []
    assert url_filters.judge_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated_pairs(empty, bench).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(spark, name):
    text = "one two three four five six seven " * 12
    df = spark.createDataFrame([(None, text), (None, text), (3, text), (4, None)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    assert sorted(str(r.doc_id) for r in OPERATORS[name](df).collect()) == ["3", "4", "None", "None"]
