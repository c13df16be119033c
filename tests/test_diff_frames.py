from quire.operators import diff, papers


def test_continuity_takes_the_larger_overlap(spark):
    rows = [("p", "one\n\ntwo\n\nthree", "two\n\nthree"), ("q", "one", "two"), ("r", None, ""), ("s", "x\n\ny", "w\n\nx")]
    df = spark.createDataFrame(rows, "pair_id string, text_a string, text_b string")
    got = {r.pair_id: (r.direction, r.overlap, r.merged_blocks) for r in diff.continuity(df).collect()}
    assert got == {"p": ("a-b", 2, 3), "s": ("b-a", 1, 3)}


def test_cross_validation(spark):
    same = "# T\n\nfirst block of text\n\nsecond block of text"
    rows = [("same", same, same), ("one", same, "# T\n\nfirst block of text"), ("flip", "alpha beta\n\ngamma delta", "gamma delta\n\nalpha beta"), ("near", "the quick brown fox jumps", "the quick brown cat jumps"), ("none", None, None)]
    got = {r.pair_id: (r.consistent, r.one_side, r.conflict, r.order_changed) for r in diff.cross_validate(spark.createDataFrame(rows, "pair_id string, text_a string, text_b string")).collect()}
    assert got == {"same": (3, 0, 0, False), "one": (2, 1, 0, False), "flip": (2, 0, 0, True), "near": (0, 0, 1, False), "none": (0, 0, 0, False)}


def test_repeated_blocks(spark):
    block = "a long enough block of words to count here"
    rows = [("d", f"{block}\n\nother words stand in this block instead\n\n{block} too"), ("e", None)]
    got = [tuple(r) for r in diff.repeated_blocks(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()]
    assert len(got) == 1 and got[0][:2] == ("d", 2) and 0.85 <= got[0][2] < 1


def test_reference_entries(spark):
    rows = [("n", "[1] A first. 1999.\n    wrapped li-\n    ne\n[2] B second. 2001."), ("y", "Abel 1990 title\n\ngoes on\n\nBaker 2000 more"), ("z", None), ("w", " ")]
    got = {(r.document_id, r.ref_index): r.raw for r in papers.split_references(spark.createDataFrame(rows, "document_id string, references_text string")).collect()}
    assert got == {("n", 1): "[1] A first. 1999. wrapped line", ("n", 2): "[2] B second. 2001.", ("y", 1): "Abel 1990 title goes on", ("y", 2): "Baker 2000 more"}
