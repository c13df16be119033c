import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import abuse, canonical, denoise, linkage, mixing, neardup, packing, split

# splitting ------------------------------------------------------------------------------------------


def check_pieces(text, limit, overlap):
    got = split.cuts(text, limit, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert b - c == overlap and d > b
    assert all(b - a <= limit for a, b, _ in got)
    return got


@given(st.text(alphabet="ab .\n,c。图", max_size=900), st.integers(20, 90), st.integers(0, 9))
@settings(max_examples=120, deadline=None)
def test_pieces_stay_within_the_limit_and_rebuild_the_text(text, limit, overlap):
    got = check_pieces(text, limit, overlap)
    assert text[: got[0][1]] + "".join(text[a + overlap : b] for a, b, _ in got[1:]) == text


def test_cuts_prefer_paragraphs():
    text = "\n\n".join("Sentence one of it. Sentence two of it." * 2 for _ in range(12))
    ends = [e for _, e, _ in check_pieces(text, 300, 20)[:-1]]
    assert all(text[e - 2 : e] == "\n\n" for e in ends)


def test_split_defined_cases(spark):
    items = spark.createDataFrame([("job", "a", "x" * 50), ("job", "b", None), ("job", "c", ""), ("other", "d", "y" * 99), ("job", "e", "z" * 5000)], "item_kind string, item_id string, text string")
    limits = spark.createDataFrame([("job", 40, 30)], "item_kind string, max_chars int, overlap_chars int")
    n = Counter(r.item_id for r in split.split(items, limits).collect())
    assert n["a"] == 2 and n["c"] == 1 and n["d"] == 1 and "b" not in n and n["e"] >= 249
    assert split.split(items.limit(0), limits).count() == 0


# canonical values -----------------------------------------------------------------------------------

VOCAB = [("graph theory", ["图论"]), ("differential equations", ["ODE"]), ("literature review", ["lit review"]), ("optics", None)]


@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7), st.text("abcd", max_size=7))
@settings(max_examples=150, deadline=None)
def test_distance_is_a_metric(a, b, c):
    d = canonical.distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b) and d(a, c) <= d(a, b) + d(b, c)


def test_tree_returns_every_entry_within_reach():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 8))) for _ in range(300)]
    tree = canonical.BKTree(words)
    for q in words[:40]:
        assert {w for _, w in tree.within(q, 2)} == {w for w in words if canonical.distance(q, w) <= 2}


@pytest.mark.parametrize(
    ("value", "tag"),
    [
        ("GRAPH  THEORY", "graph theory"), ("#theory,_graph", "graph theory"), ("grpah theory", "graph theory"), ("图论", "graph theory"), ("DIFF. EQUATIONS", "differential equations"),
        ("ode", "differential equations"), ("my literature review (draft)", "literature review"), ("ｏｐｔｉｃｓ", "optics"), ("graph paper", "(none)"), ("x", "(none)"), ("????", "(none)"), ("opticians", "(none)"),
    ],
)
def test_canonical(value, tag):
    index = canonical.Index([(t, t) for t, _ in VOCAB] + [(a, t) for t, al in VOCAB for a in al or []])
    assert index.find(value)[0] == tag


def test_shards_give_the_same_as_one_tree(spark):
    vocab = spark.createDataFrame(VOCAB, "tag string, aliases array<string>")
    values = spark.createDataFrame([(i, v) for i, v in enumerate(["grpah theory", "optic", "lit review", None, " ", "zzz", "zzz"])], "i int, value string")
    one = canonical.canonicalise(values, "value", canonical.reference_entries(vocab)).orderBy("i").collect()
    many = canonical.canonicalise(values, "value", canonical.reference_entries(vocab), shard_entries=2).orderBy("i").collect()
    assert [r.canonical for r in one] == [r.canonical for r in many] == ["graph theory", "optics", "literature review", None, None, "(none)", "(none)"]
    empty = canonical.canonicalise(values, "value", canonical.reference_entries(vocab.limit(0))).collect()
    assert {r.canonical for r in empty} == {None, "(none)"}


# near duplicates ------------------------------------------------------------------------------------


def brute(texts, size, num, den, min_chars):
    runs = {}
    for k, t in texts:
        w = neardup.TOKEN.findall((t or "").lower())
        if t is not None and len(t) >= min_chars and w:
            runs[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}
    return {(a, b) for a, b in combinations(sorted(runs), 2) if len(runs[a] & runs[b]) * den >= len(runs[a] | runs[b]) * num}


@pytest.mark.parametrize(("size", "threshold"), [(3, (1, 2)), (5, (4, 5))])
def test_no_link_is_lost(spark, size, threshold):
    rnd = random.Random(size)
    vocab = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(4, 90))]
        texts.append((f"{i:03d}a", " ".join(base)))
        for c in "bcd":
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 6))):
                p = rnd.randrange(len(copy))
                copy[p : p + rnd.randint(0, 2)] = [rnd.choice(vocab)] * rnd.randint(0, 2)
                copy = copy or ["w1"]
            texts.append((f"{i:03d}{c}", " ".join(copy)))
    texts += [("n", None), ("e", ""), ("p", "!!! ???"), ("q", "图论笔记本" * 30), ("r", "图论笔记本" * 29), ("s", "one"), ("t", "ONE")]
    df = spark.createDataFrame([*texts, texts[0]], "k string, t string")
    got = {(r.a, r.b) for r in neardup.found_pairs(df, "k", "t", size=size, threshold=threshold, min_chars=1).collect()}
    assert got == brute(texts, size, *threshold, 1)


def test_copies_form_a_class(spark):
    rows = [(str(i), "the same text over and over with some words in it") for i in range(40)] + [("x", "quite another text about nothing at all here")]
    got = {r.key: (r.class_size, r.n_links) for r in neardup.classes(spark.createDataFrame(rows, "k string, t string"), "k", "t", min_chars=1).collect()}
    assert got["0"] == (40, 0) and got["x"] == (1, 0)
    empty = spark.createDataFrame([], "k string, t string")
    assert neardup.found_pairs(empty, "k", "t").count() == 0


# packing and mixing ---------------------------------------------------------------------------------


def test_over_seeds_documents_come_out_their_expected_number_of_times(spark):
    n, rate, seeds = 40, 0.37, 400
    offsets = spark.range(seeds).select(mixing.offset(F.lit("notes"), 0).alias("same"), (F.pmod(F.xxhash64(F.col("id").cast("int"), F.lit("notes")), F.lit(1 << 30)) / float(1 << 30)).alias("o")).collect()
    assert len({r.same for r in offsets}) == 1
    times = Counter()
    for r in offsets:
        for i in range(1, n + 1):
            at = i * rate + r.o
            times[i] += math.floor(at) - math.floor(at - rate)
    assert abs(sum(times.values()) / (n * seeds * rate) - 1) < 0.01
    assert all(abs(times[i] / seeds - rate) < 0.09 for i in range(1, n + 1))


def test_another_seed_draws_other_documents_and_the_exact_total_meets_all_shares(spark):
    counts = spark.createDataFrame([(i, "ab"[i % 2], 50 + i % 7) for i in range(400)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 3)], "source string, target_share double, max_repeats int")
    one, two = ({r.doc_id for r in mixing.mix(counts, targets, 4000, seed=s)[0].collect()} for s in (1, 2))
    assert one != two
    shares = {r.source: r.actual_share for r in mixing.mix(counts, targets, "exact")[1].collect()}
    assert abs(shares["a"] - 0.9) < 0.01 and abs(shares["b"] - 0.1) < 0.01


def test_packing_keeps_capacity_and_conflicts(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), i % 400, rnd.randint(1, 900)) for i in range(1500)] + [(9001, None, 77777, 5000), (9002, "a", 88888, 4096)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, cluster long, tokens int")
    got = packing.pack(counts, 2048, shard_tokens=200_000).collect()
    size, kinds, total = Counter(), defaultdict(list), Counter()
    cluster = {r[0]: r[2] for r in rows}
    for r in got:
        size[r.container] += r.tokens
        kinds[r.container].append(cluster[r.doc_id])
        total[r.doc_id] += r.tokens
    assert max(size.values()) <= 2048
    assert all(len(set(c)) == len(c) for c in kinds.values())
    assert total == {r[0]: r[3] for r in rows}
    pieces = Counter(r.doc_id for r in got)
    assert pieces[9001] == 3 and pieces[9002] == 2 and all(n == 1 for k, n in pieces.items() if k < 9000)
    assert sum(size.values()) / (2048 * len(size)) > 0.97
    assert packing.pack(counts.limit(0)).count() == 0


def test_best_fit_takes_the_tightest():
    where, used = packing.best_fit([(7, 1, "a"), (6, 2, "a"), (4, 3, "a"), (3, 4, "a")], 10)
    assert where == [0, 1, 1, 0] and used == [10, 10]


def test_mixture_reaches_shares_and_caps(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["a", "A ", "b"]), 10 + rnd.randint(0, 40)) for i in range(4000)] + [(9000 + i, "small", 20) for i in range(5)] + [(9990, None, 5), (9991, "unknown", 5)]
    counts = spark.createDataFrame(rows, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.4, 3), ("small", 0.1, 4), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    drawn, report = mixing.mix(counts, targets)
    rep = {r.source: r for r in report.collect()}
    assert max(r.copies for r in drawn.collect()) <= 4
    assert rep["small"].most_copies == 4 and rep["none"].actual_share == 0
    a, b = rep["a"].actual_share, rep["b"].actual_share
    assert abs(a / b - 0.5 / 0.4) < 0.01 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    assert rep[None].target_share is None and rep["unknown"].n_drawn == 0


# linkage --------------------------------------------------------------------------------------------


def test_links(spark):
    entries = [
        ("e1", "Towards late stroke for the scalable catalogue", "10.99101/abc.2006.123456", ["Calnerak, P."], 2006, "Open Notebook Reports"),
        ("e2", "TOWARDS LATE STROKE FOR THE SCALABLE CATALOGUE", None, ["Pelgar Calnerak"], 2006, None),
        ("e3", "Comment on “Towards late stroke for the scalable catalogue”", None, ["Calnerak, P."], 2006, None),
        ("e4", "Towards late stroke for the scalable catalogue, Part II", None, ["Calnerak, P."], 2006, None),
        ("e5", "Towards late stroke for the scalable catalogue", None, ["Dolmire, F."], 1991, None),
        ("e6", None, "10.99102/zz9.777888999", ["Vezan, G."], 2011, None), ("e7", "", None, None, None, None),
    ]
    refs = [
        (1, "[1] Calnerak et al.. TOWARDS LATE STROKE FOR THE SCALBLE CATALOGUE. Open Notebook Rep., 2006."),
        (2, "Calnerak, P. (2006). Comment on “Towards late stroke for the scalable catalogue”. SSD, 1, 2-3."),
        (3, "Vezan 2011 doi:10.99102/zz9.777888999."), (4, None), (5, ""), (6, "Somebody else (1999). Another thing entirely."),
    ]
    e = spark.createDataFrame(entries, "document_id string, title string, doi string, authors array<string>, pub_year int, venue string")
    r = spark.createDataFrame([*refs, refs[0]], "ref_id long, raw string")
    got = {tuple(x) for x in linkage.found(r, e).collect()}
    assert got == {(1, "e1"), (1, "e2"), (2, "e3"), (3, "e6")}
    assert linkage.found(r, e.limit(0)).count() == 0 and linkage.found(r.limit(0), e).count() == 0


def test_frequent_title_words_still_link(spark):
    # every title word is on more than 60 entries; the references have neither DOI nor three words in a row
    names = ["Brendik", "Vostrane", "Kelmori", "Tasquin", "Orlenda", "Pravosk", "Zintare", "Hudrelm", "Ferkola", "Wistand"]
    filler = [(f"f{i}", t, None, [f"{names[i % 9]}, Q."], 1950 + i % 9, None) for i in range(70) for t in ["Thermal gradient"]]
    filler += [(f"g{i}", "Porous membrane", None, [f"{names[i % 9]}, Q."], 1950 + i % 9, None) for i in range(70)]
    entries = [("named", "Thermal porous gradient membrane", None, ["Wistandel, A."], 2004, None), ("nameless", "Gradient membrane thermal porous", None, None, 1987, None)]
    refs = [
        (1, "Filler words of every kind stand here before all else, Wistandel, A. Thermal porus gradient membrnae."),
        (2, "Wistanel, A. (2004). Thermal porus gradient membrnae."),
        (3, "(1987). Gradient membrnae thermal poruos."),
    ]
    e = spark.createDataFrame(filler + entries, "document_id string, title string, doi string, authors array<string>, pub_year int, venue string")
    r = spark.createDataFrame(refs, "ref_id long, raw string").withColumn("id", F.col("ref_id").cast("string"))
    want = {(i, d) for i, d in linkage.found(r.select("ref_id", "raw"), e).collect()}
    free = {(int(x.ref_id), x.document_id) for x in linkage.link(r.select("ref_id", "raw"), e, rare_word=10**9).collect()}
    assert want == free and {(2, "named"), (3, "nameless")} <= want


def shuffled(spark):
    """Records that all stages of the session have moved."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_keys_that_are_on_no_entry_are_not_moved(spark):
    names = [f"{a}{b}mstelan" for a in ("Bre", "Vos", "Kel", "Tas", "Orl") for b in ("di", "ru", "ko")]
    titles = ["thermal", "porous", "gradient", "membrane", "lattice", "solvent", "crystal", "plasma", "turbine", "isotope"]
    # all surnames have frequent words, but only with a year, so references with a year need none of the 150 keys of surname and word
    entries = [(f"e{i}", " ".join(titles[(i + k) % 10] for k in (0, 3, 7)), None, [f"{names[i % 15]}, A."], 1950 + i // 15, None) for i in range(450)]
    refs = [(i, f"{', '.join(names)} ({2000 + i % 20}). {' '.join(titles[(i + 2 * k) % 10] for k in range(5))} {' '.join(titles[(i + 2 * k + 1) % 10] for k in range(5))}.") for i in range(300)]
    e = spark.createDataFrame(entries, "document_id string, title string, doi string, authors array<string>, pub_year int, venue string")
    before = shuffled(spark)
    assert linkage.link(spark.createDataFrame(refs, "ref_id long, raw string"), e).count() == 0
    assert shuffled(spark) - before < 45_000


def test_near_is_the_edit_distance():
    def distance(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 < j and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    rnd = random.Random(3)
    for _ in range(5000):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(8))) for _ in "ab")
        assert [linkage.near(a, b, k) for k in range(4)] == [distance(a, b) <= k for k in range(4)]


def test_entries_are_read_once_and_not_for_every_pair(spark, monkeypatch):
    parts = linkage.parts_of_entry("Comment on thermal lattices, Part II", ["Wistandel, Anna", None], "doi:10.99101/ABC.2006.123456")
    monkeypatch.setattr(linkage, "fold", None)  # nothing is left to fold in an entry
    monkeypatch.setattr(linkage.Scorer, "parts", lambda s, raw: (["wistandel"], {"wistandel"}, [], [], frozenset(), {2006}, ["10.99101/abc.2006.123456"], False, {}, {}))
    assert linkage.Scorer(frozenset(), frozenset()).score("", parts, 2006)[0] > 0.5


def test_sieve_lets_all_keys_pass(spark):
    given = linkage.hashed([f"w:{i}" for i in range(5000)])
    bits = linkage.sieve(spark.createDataFrame(pd.DataFrame({"key": given})))
    other = linkage.sifted(bits, linkage.hashed([f"n:{i}" for i in range(5000)]))
    assert linkage.sifted(bits, given).all() and other.mean() < 0.15
    assert len(linkage.hashed([])) == 0 and not linkage.sifted(linkage.sieve(spark.createDataFrame([], "key long")), given).any()


# scans ----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    body = "the baseline and its frequent sample were checked in august and the well-known template covers all 12 pages of the harbour. "
    rows = [(body * 8,)] * 6 + [("阈值与样本之间的关系仍然稳定。" * 60,)]
    return denoise.fit(spark.createDataFrame(rows, "text string"))


@pytest.mark.parametrize(
    ("text", "inline", "want"),
    [
        ("The baseline and its fre-\nquent sample were checked", False, {"hyphen"}),
        ("the well-\nknown template covers", False, set()),
        ("the base1ine and its sample", False, {"glyph"}),
        ("the baseline and\nOpen points · Vol. 25\nits sample were", False, {"header"}),
        ("the baseline and\n- 97 -\nits sample were", False, {"pageno"}),
        ("the baseline and\n12   DRAFT 1990 — Jorsom\nits sample were", False, {"header", "pageno"}),
        ("Readings in order:\n93\n399\n10", False, set()),
        ("…the baseline and p. 81 its fre- quent sample", True, {"pageno", "hyphen"}),
        ("阈值与样木之间的关系", False, {"glyph"}),
        ("", False, set()),
    ],
)
def test_traces(model, text, inline, want):
    assert denoise.analyse(text, inline, model)[0] == want


def test_repair_gives_paragraphs(model):
    got = denoise.repaired("The baseline and its fre-\nquent sample\n\n- 97 -\n\nwere checked.\n\n- all\n- pages", False, model)
    assert got == "The baseline and its frequent sample were checked.\n\n- all\n- pages"


def test_repair_of_empty_table(spark, model):
    df = spark.createDataFrame([], "item_kind string, item_id string, text string")
    assert denoise.repair(df, model).count() == 0


def test_pairs_are_counted_over_all_batches():
    # every pair occurs once in each of two batches of 600 texts
    batch = pd.DataFrame({"text": [f"{a}{b}x {a}{b}y" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"][:600]})
    n = Counter()
    for part in denoise._count(iter([batch, batch])):
        n.update(dict(zip(part["entry"], part["n"])))
    assert n["abx aby"] == 2 and sum(" " in e for e in n) == 600


# abuse ----------------------------------------------------------------------------------------------

READER = abuse.Reader(abuse.ordinary_words())


@pytest.mark.parametrize(
    ("text", "bad"),
    [
        ("Whoever wrote this is a shitty imbecile.", True), ("you are a c.r.e.t.i.n, and we laugh", True), ("You f u c k i n g d u m b a s s , go", True), ("Go k​ill yourself", True), ("Shut up, 5t*p1d l0ser", True),
        ("你这个蠢货，垃圾摘要", True), ("贱·人，去死吧", True), ("Shut up, imbecille", True), ("Nude mice were kept in cages.", False), ("The script will kill the idle process.", False),
        ("The survey asks about sex and age of adults.", False), ("Hate speech datasets need one vector.", False), ("该进程应当杀死空闲的版面。", False), ("", False), (None, False),
    ],
)
def test_abuse(text, bad):
    score, kind = READER.score(text)
    assert (score >= abuse.THRESHOLD) is bad, (score, kind)


@pytest.mark.parametrize(("phrase", "weight"), [(p, w) for _, p, w in abuse.PHRASES])
def test_every_phrase_scores_alone(phrase, weight):
    text = f"Well, {phrase.replace('_', 'the lot')} then."
    assert READER.score(text)[0] >= weight - 1e-6


def test_disguised_phrases_score():
    assert READER.score("I know wh3re you live, friend.")[0] >= 0.8 and READER.score("Re-break your neck.")[0] >= 0.5


def test_copies_of_a_misspelling_are_found(spark):
    rows = [(i, "Whoever wrote this is an imbecille.", "hot") for i in range(30)] + [(100 + i, f"The lower batch holds nodes of plain text {i}.", "b") for i in range(60)]
    got = {r.doc_id for r in abuse.found(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == set(range(30))


def test_automaton_matches_brute_force():
    words = ["moron", "cretin", "bastard", "imbecile"]
    trie = abuse.Trie(words)
    for q in ["morron", "cretn", "bsatard", "imbecil", "moon", "cart"]:
        got = {w for _, w in trie.within(q, 1)}
        want = {w for w in words if linkage.near(q, w, 1)}
        assert got == want


def test_tokens_far_from_the_lexicon_walk_no_trie():
    trie = abuse.Trie(abuse.WORDS)
    trie.root = None  # a walk fails
    for q in ("measurement", "x86-64", "sha256", "retrieval's", "", "q" * 2 + "ab" * 500):
        assert [trie.within(q, k) for k in (0, 1, 2)] == [[], [], []]


def test_candidates_lose_no_word_that_the_automaton_finds():
    class Whole(abuse.Trie):
        def _candidates(self, token, k):
            return self.words

    rnd = random.Random(7)
    words = sorted(abuse.WORDS)
    trie, whole = abuse.Trie(words), Whole(words)
    tried = found = 0
    for w in words:
        for _ in range(6):
            q = list(w)
            for _ in range(rnd.randrange(4)):
                i = rnd.randrange(len(q))
                q[i : i + 2] = rnd.choice([q[i + 1 : i + 2] + [q[i]], [rnd.choice("il1!|40@s5$tk'*"), *q[i : i + 2]], q[i + 1 : i + 2], [rnd.choice("il1!|30@s$e7+*"), *q[i + 1 : i + 2]], [q[i]] * 3 + q[i + 1 : i + 2]]) or ["x"]
            for k in (0, 1, 2):
                want = sorted(whole.within("".join(q), k))
                assert sorted(trie.within("".join(q), k)) == want, (q, k)
                tried, found = tried + 1, found + bool(want)
    assert found > tried / 2


def test_tokens_are_those_of_the_patterns():
    rnd = random.Random(3)
    for _ in range(3000):
        s = "".join(rnd.choice("ab'’ 1@!*-_.\n\xa0é你é") for _ in range(rnd.randrange(25)))
        assert abuse._tokens(s) == set(abuse._TOKEN.findall(s)) and abuse._mixed(s) == abuse._MIXED.findall(s)
        assert abuse._SPACED_END.search(s) or not abuse._SPACED.search(s)


def test_a_worker_keeps_the_reader_of_its_lexicon():
    one, other = (abuse.ORDINARY, {}), (abuse.ORDINARY, {})
    assert abuse.reader_of(one) is abuse.reader_of(one) is not abuse.reader_of(other)


def test_rates_per_source(spark):
    rows = [(1, "You stupid moron", "a"), (2, "fine", "A "), (3, None, None), (4, "", "a")]
    got = {r.source: (r.n_documents, r.n_cases) for r in abuse.rates(abuse.score(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()}
    assert got == {"a": (3, 1), "(none)": (1, 0)}


def test_misspelled_lexicon_words_are_caught_by_the_automaton():
    rnd = random.Random(5)
    tried = caught = 0
    for w in sorted(w for w, (_, x) in abuse.WORDS.items() if len(w) > 4 and x >= 0.45):
        for _ in range(8):
            i = rnd.randrange(len(w) - 1)
            bad = rnd.choice([w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + rnd.choice("xzqk") + w[i:], w[:i] + w[i + 1 :], w[:i] + rnd.choice("xzqk") + w[i + 1 :]])
            if bad != w and bad not in READER.ordinary and bad not in abuse.WORDS:
                tried += 1
                caught += READER.meant(bad) in abuse.WORDS
    assert tried > 100 and caught >= 0.97 * tried
    for text in ("you fukc", "you are a rmoron", "you moorn, go away", "you m0r0n", "you a**hole", "you stuuuupid wh0re"):
        assert READER.score(text)[0] >= 0.4, text
    blind = abuse.Reader(abuse.ordinary_words())
    blind.trie = blind.long = type("None_", (), {"within": lambda self, token, k: []})()
    assert blind.score("you are a m0r0n")[0] < abuse.THRESHOLD <= READER.score("you are a m0r0n")[0]


def test_terms_are_learned_from_judgements_and_only_where_luck_is_ruled_out(spark):
    bad, good = "They say the lot of them are turnip heads from the swamp.", "The dataset covers turnip fields near the coast."
    docs = [(i, bad if i < 40 else good, "a") for i in range(400)] + [(900, bad, "b"), (901, good, "b"), (902, None, None)]
    labels = [(i, "x", int(i < 40)) for i in range(400)] + [(0, "x", 1), (1, "y", None), (5, "z", 0), (7777, "x", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    lab = spark.createDataFrame(labels, "doc_id long, annotator string, abusive int")
    got = {r.doc_id for r in abuse.found(d, lab).collect()}
    assert got == {*range(40), 900}
    assert abuse.found(d, lab.limit(0)).count() == 0 and abuse.found(d.limit(0), lab).count() == 0
    assert abuse.fit(d, lab.where("doc_id in (1, 2, 100, 101)")) == {}


def test_confusions_that_occur_more_often_become_more_probable(spark):
    words = "table morning letter common student house number".split()
    texts = [" ".join(words) + f" note {i}" for i in range(200)] + ["tab1e morning Ietter comrnon stuclent honse"] * 3 + ["comrnon"]
    df = spark.createDataFrame([("job", str(i), t) for i, t in enumerate(texts)], "item_kind string, item_id string, text string")
    m = denoise.fit(df)
    assert m.channel["rn", "m"] > denoise.MISREAD_LOG > m.channel["b", "h"]
    assert all(abs(v - denoise.MISREAD_LOG) <= denoise.MISREAD_SPREAD + 1e-9 for v in m.channel.values())
    assert denoise.fit(df.limit(0)).channel == denoise.fit(df.limit(0)).channel
    same = denoise.fit(df.repartition(7))
    assert same.words == m.words and same.pairs == m.pairs and all(abs(same.channel[k] - v) < 1e-9 for k, v in m.channel.items())
