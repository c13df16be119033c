from collections import Counter
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import values as V
from quire.operators import diff, library, search, similarity, versions
from quire.plans import fingerprints


def one(spark, value, *cols):
    return spark.createDataFrame([(value,)], "x string").select(*cols).first()


def test_search_tokens(spark):
    got = one(spark, "State of 图书馆 与 x_1", T.search_tokens("x").alias("t"))[0]
    assert got == ["state", "of", "x_1", "图书", "书馆", "与"]
    assert one(spark, None, T.search_tokens("x").alias("t"))[0] == []


def test_shingles_of_short_and_empty(spark):
    assert one(spark, "a b", T.shingles(T.similarity_tokens("x")).alias("t"))[0] == ["a b"]
    assert one(spark, "", T.shingles(T.similarity_tokens("x")).alias("t"))[0] == []
    assert one(spark, "a b c d `code`", T.shingles(T.similarity_tokens("x")).alias("t"))[0] == ["a b c", "b c d"]


@pytest.mark.parametrize(("raw", "key"), [("#Graph_Theory", "graph theory"), ("ｇｒａｐｈ　ｔｈｅｏｒｙ", "graph theory"), ("##", None), (" ", None), ("a" * 81, None)])
def test_tag_key(spark, raw, key):
    assert one(spark, raw, T.tag_key("x").alias("k"))[0] == key


def test_names_and_keys(spark):
    r = one(spark, "Week 2: a/b", T.slug("x").alias("s"), T.file_id("x").alias("f"), T.vault_name("x").alias("v"))
    assert tuple(r) == ("week-2-a-b", "Week-2-a-b", "Week_2_a_b")
    assert one(spark, "https://doi.example/10.1/AB).", T.doi_key("x").alias("k"))[0] == "10.1/ab"
    assert one(spark, "A & B: c", T.title_key("x").alias("k"))[0] == "a and b c"


def test_snippet(spark):
    body = "x" * 100 + " harbour " + "y" * 100
    got = one(spark, body, T.snippet("x", ["harbour"]).alias("s"))[0]
    assert got.startswith("…") and got.endswith("…") and "harbour" in got


def test_search_matches_brute_force(spark):
    docs = [("1", "graph theory of graphs", "Graph"), ("2", None, "graph"), ("3", "theory", None), ("4", "", "")]
    index = search.postings(spark.createDataFrame(docs, "key string, body string, title string"))
    assert {tuple(r) for r in search.match(index, "graph theory").collect()} == {("1", 4)}
    assert {tuple(r) for r in search.match(index, "graph theory", "any").collect()} == {("1", 4), ("2", 2), ("3", 1)}
    assert search.match(index, "").count() == 0


def test_jaccard_matches_brute_force(spark):
    docs = [(str(i), f"alpha beta gamma delta {' '.join(chr(97 + (i * j) % 7) for j in range(12))}") for i in range(14)] + [("e", ""), ("1", "repeat"), (None, "x")]
    df = spark.createDataFrame(docs, "k string, t string")
    got = {(r.a, r.b): r.score for r in similarity.jaccard_pairs(df.where("t <> 'repeat'"), "k", "t", 0.2).collect()}
    runs = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in docs if k and t and t != "repeat"}
    want = {}
    for a, b in combinations(sorted(runs), 2):
        s = len(runs[a] & runs[b]) / len(runs[a] | runs[b])
        if round(s, 6) >= 0.2:
            want[a, b] = pytest.approx(s, abs=1e-6)
    assert got == want


def test_similarity_reads_whole_texts(spark, tmp_path):
    from quire import queries

    head = [" ".join(f"w{k}x{i}" for i in range(1500)) for k in "ab"]
    tail = " ".join(f"same{i}" for i in range(1500))
    rows = [("a", f"{head[0]} {tail}"), ("b", f"{head[1]} {tail}")]
    spark.createDataFrame(rows, "document_id string, full_text string").write.parquet(f"{tmp_path}/papers.parquet")
    assert len(head[0]) > 8000
    got = [tuple(r) for r in queries.QUERIES["join_jaccard_pairs"](spark, str(tmp_path)).collect()]
    assert got == [("a", "b", round(1498 / (2 * 2998 - 1498), 6))]
    assert one(spark, rows[0][1], F.size(T.similarity_tokens("x", None)).alias("n"))[0] == 3000


def test_jaccard_over_blocks_moves_no_row_for_a_shared_shingle(spark):
    common = " ".join(f"c{i}" for i in range(50))
    docs = [(f"{i:02}", f"{common} {' '.join(f'w{i * j % 11}' for j in range(30))}") for i in range(60)]
    df = spark.createDataFrame([*docs, ("none", ""), ("null", None)], "k string, t string")

    def shuffled():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    got = {(r.a, r.b): r.score for r in similarity.jaccard_pairs(df, "k", "t", 0.5).collect()}
    assert shuffled() - before < 1000  # 60 documents share 48 shingles at least
    runs = {k: {tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for k, t in docs}
    score = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a, b in combinations(sorted(runs), 2)}
    want = {p: pytest.approx(s, abs=1e-6) for p, s in score.items() if round(s, 6) >= 0.5}
    assert got == want and len(want) > 500
    several = similarity.jaccard_pairs(df, "k", "t", 0.5, block_shingles=900).collect()
    assert len(several) == len(want) and {(r.a, r.b): r.score for r in several} == got
    assert similarity.jaccard_pairs(df.where("k > 'none'"), "k", "t").collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edits_of_mixed_scripts(spark, tmp_path):
    from quire import queries

    pairs = [("图论笔记", "图论"), ("ｏｐｔｉｃｓ", "optics"), ("café", "cafe"), ("𝒳y", "xy"), ("grpah", "graph"), ("", "graph")]
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate([*pairs, (None, "graph")])], "suggestion_id int, source string, target string").write.parquet(f"{tmp_path}/tag_merges.parquet")
    spark.createDataFrame([(b, b) for b in {b for _, b in pairs}], "tag string, tag_group string").write.parquet(f"{tmp_path}/tag_vocabulary.parquet")
    got = {(r.source_key, r.target_key): r.mean_edits for r in queries.QUERIES["math_tag_edits"](spark, str(tmp_path)).collect()}
    assert got == {(a.lower(), b): edits(a, b) for a, b in pairs}
    rates = {r.tag_group: (r.n, r.micro_rate) for r in queries.QUERIES["agg_edit_rates"](spark, str(tmp_path)).collect()}
    for t in {b for _, b in pairs}:
        d = [edits(a, b) for a, b in pairs if b == t]
        assert rates[t] == (len(d), round(sum(d) / (len(d) * len(t)), 4))


def test_references_resolve_by_title(spark, tmp_path):
    from quire import queries

    titles = {"a": "Learning ordered dataset from idle notebook", "b": "A study of soil, revisited with Qualin", "c": "A study of soil, revisited with Qualin, Part II", "d": "twice", "e": "Twice"}
    raws = [
        ("1. VULMONT D, “Learning Ordered Dataset From Idle Notebook,” Proc. Shelf Wksp., vol. 46, 2009", "a"), ("Dolbel et al. (2016). A study of soil, revisited with Qualin. North. Libr. Q., 32.", "b"),
        ("A study of soil, revisited with Qualin, Part II, J. Hultadar, 2004", "c"), ("[QUA03] Qualin, T.. Learning ordered dataset from idle notebook\n    Annals of Page Studies, 2003", "a"),
        ("M. Zillalin, D. Drether 2021 Learning ordered dataset from idle notebook DOI 10.99129/none.1", "a"), ("Comment on “Learning ordered dataset from idle notebook”. Arch., 2000.", None), ("A study of soil, revisited with Qualin, Part III, 2004", None), ("X (1999). Twice. Y.", None), (None, None),
    ]
    spark.createDataFrame([(i, "z", r) for i, (r, _) in enumerate(raws)], "ref_id long, citing_id string, raw string").write.parquet(f"{tmp_path}/resolved_refs.parquet")
    spark.createDataFrame([(k, t, None) for k, t in titles.items()], "document_id string, title string, doi string").write.parquet(f"{tmp_path}/library_entries.parquet")
    got = {r.ref_id: (r.doc, r.matched_by) for r in queries.QUERIES["join_resolved_references"](spark, str(tmp_path)).collect()}
    assert got == {i: (want, "title" if want else None) for i, (_, want) in enumerate(raws)}


def test_hash_range_takes_every_hundredth_key(spark, tmp_path):
    import random

    from quire import queries

    rnd = random.Random(5)
    bits = {k: [rnd.choice([-1.0, 1.0]) for _ in range(64)] for k in range(250)}
    spark.createDataFrame(list(bits.items()), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    want = {(q, k, n) for q in (0, 100, 200) for k in bits if k != q and (n := sum(a != b for a, b in zip(bits[q], bits[k]))) <= 28}
    got = {(r.query, r.key, r.distance) for r in queries.QUERIES["join_hash_range"](spark, str(tmp_path)).collect()}
    assert got == want and {q for q, _, _ in want} == {0, 100, 200}


def test_hamming_pairs_and_components(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(20)]
    hashes = base + [h ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for h in base]
    df = spark.createDataFrame([(i, h >> 32, h & 0xFFFFFFFF) for i, h in enumerate(hashes)], "key long, hi long, lo long")
    pairs = similarity.hamming_pairs(df, 3)
    want = {(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a, b in combinations(range(40), 2) if (hashes[a] ^ hashes[b]).bit_count() <= 3}
    assert {tuple(r) for r in pairs.collect()} == want
    got = {r.key: r.cluster for r in similarity.components(df, pairs).collect()}
    assert got == {i: i % 20 for i in range(40)}


def test_merge_chains_and_cycles(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "source string, target string")
    got = {r.source: r.target for r in library.resolve_chains(m).collect()}
    assert got["a"] == got["b"] == got["c"] == "d"
    assert got["x"] == "x" or got["x"] == got["y"]


def test_upsert_remove_and_three_way(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, n int")
    new = spark.createDataFrame([(1, "z", 2), (3, "c", 1)], "id int, v string, n int")
    up = versions.upsert(t, new, "id", "n")
    assert {tuple(r) for r in up.collect()} == {(1, "z", 2), (2, "b", 1), (3, "c", 1)}
    assert {tuple(r) for r in versions.upsert(up, new, "id", "n").collect()} == {tuple(r) for r in up.collect()}
    assert {r.id for r in versions.remove(up, new, "id").collect()} == {2}
    f = lambda rows: spark.createDataFrame(rows, "path string, hash string")
    got = {r.path: r.action for r in versions.three_way(f([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")]), f([("b", "1"), ("c", "1"), ("d", "9"), ("e", "1"), ("f", "9")]), f([("c", "1"), ("d", "1"), ("e", "1")])).collect()}
    assert got == {"a": "added", "b": "unchanged", "c": "updated", "d": "conflict", "e": "deleted", "f": "kept_user"}


def test_fingerprint_ignores_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",)], "p string")
    b = spark.createDataFrame([("z",), ("x",), ("y",)], "p string")
    f = lambda d: fingerprints.library_fingerprint(d, F.col("p")).first()[0]
    assert f(a) == f(b) != f(a.limit(2))


@given(st.lists(st.integers(0, 30), max_size=25))
@settings(max_examples=60, deadline=None)
def test_rising_is_longest(seq):
    best = 0
    lengths = []
    for i, v in enumerate(seq):
        lengths.append(1 + max([lengths[j] for j in range(i) if seq[j] < v], default=0))
        best = max(best, lengths[-1])
    places = sorted(diff.rising(seq))
    assert len(places) == best and all(seq[a] < seq[b] for a, b in zip(places, places[1:]))


@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
@settings(max_examples=60, deadline=None)
def test_edit_ops_sum_to_the_distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, d[j] + 1, d[j - 1] + (x != y)))
        d = new
    ins, dels, sub = diff.edit_ops(a, b)
    assert ins + dels + sub == d[-1] and len(b) + ins - dels == len(a)


def test_block_diff():
    a = diff.blocks("# T\n\nfirst block here\n\nsecond one\n\n- x\n- y")
    b = diff.blocks("# T\n\nsecond one\n\nfirst block there\n\nnew")
    ops = Counter(c[0] for c in diff.compare(a, b))
    assert ops == {"unchanged": 2, "modified": 1, "removed": 1, "added": 1}
    assert diff.compare([], []) == [] and diff.blocks(None) == []
    assert all(c[0] == "unchanged" for c in diff.compare(a, a))
    assert diff.overlap(a, diff.blocks("second one\n\n- x\n- y\n\nmore")) == 2
