import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import common, decontaminate, queries


def plain(item, text):
    """Least edit distance of item to any substring, by the usual table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(items, text, rate):
    text = decontaminate.normalise(text)
    out = []
    for item_id, item in items:
        item = decontaminate.normalise(item)
        if item and text and (d := plain(item, text)) <= int(len(item) * rate):
            out.append((item_id, d))
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=80), st.text("abc ", max_size=90))
def test_myers_distance(item, text):
    assert decontaminate.Pattern(item).distance(text) == plain(item, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.text("abé ", min_size=1, max_size=200), st.text("abé x", max_size=230)), min_size=1, max_size=12))
def test_distances_side_by_side(pairs):
    made = [(decontaminate.Pattern(item), text) for item, text in pairs]
    assert decontaminate.least_distances(made).tolist() == [p.distance(t) for p, t in made]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab c", min_size=20, max_size=45), max_size=3), st.text("ab c", max_size=60), st.integers(1, 60), st.sampled_from([0.05, 0.2]))
def test_long_spans_are_cut_without_a_loss(items, text, times, rate):
    items, text = list(enumerate(items)), text * times
    assert decontaminate.Matcher(items, rate).matches(text) == brute(items, text, rate)


def test_repetitive_text_against_many_items():
    rng = random.Random(7)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(322))
    items = []
    for k in range(20):
        item = list(passage)
        for _ in range(24):
            item[rng.randrange(len(item))] = rng.choice("xyz")
        items.append((k, "".join(item)))
    matcher = decontaminate.Matcher(items, 0.05)
    began = time.process_time()
    found = matcher.matches((passage + "q") * (480_000 // 323))
    assert time.process_time() - began < 6  # 2 s on a machine of usual speed
    assert found == brute(items, (passage + "q") * 3, 0.05)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab c", max_size=45), max_size=3), st.text("ab c", max_size=150), st.sampled_from([0.0, 0.05, 0.1, 0.3]))
def test_matcher_equals_brute_force(items, text, rate):
    items = list(enumerate(items))
    assert decontaminate.Matcher(items, rate).matches(text) == brute(items, text, rate)


def test_edited_passages_and_odd_rows(spark):
    rng = random.Random(2)
    letters = "abcdefgh éñ "
    items = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(30, 150)))) for k in range(8)]
    docs = []
    for i in range(60):
        text = list(items[i % 8][1])
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(letters + "XYZ")
        docs.append((i, "".join(rng.choice(letters) for _ in range(80)) + "".join(text).upper() + "\n\ttail"))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1] * 40), (102, items[1][1] * 40)]
    items += [(50, items[0][1]), (51, None), (52, " "), (None, "x"), (53, "tail")]
    df = spark.createDataFrame([(*r, 7, "k") for r in docs], "doc_id long, text string, item_id int, bm string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    real = [(a, b) for a, b in items if a is not None and b is not None]
    want = sorted(((d, brute(real, t, 0.05)) for d, t in docs), key=str)
    for block in (1 << 20, 300):
        got = decontaminate.decontaminate(df, marks, 0.05, block).collect()
        assert sorted(((r["doc_id"], list(zip(r["bm_items"], r["bm_distances"]))) for r in got), key=str) == want
        assert all(r["item_id"] == 7 and r["bm"] == "k" for r in got)
    assert decontaminate.decontaminate(df.limit(0), marks).count() == 0
    assert decontaminate.decontaminate(df, marks.limit(0)).where("size(bm_items) > 0").count() == 0


def test_query_finds_the_planted_passages(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in common.table(spark, sf, "benchmark").collect()]
    texts = {r["doc_id"]: decontaminate.normalise(r["text"]) for r in common.table(spark, sf, "documents").collect()}
    exact = {(d, i) for d, t in texts.items() for i, item in items if item and item in t}
    got = {(r["doc_id"], i) for r in queries.op8_decontaminate(spark, sf).collect() for i in r["items"]}
    assert exact and exact <= got


def test_clashing_columns_and_blocks(spark):
    docs = spark.createDataFrame([(1, "x the first item here y", 7, 8, 9), (2, "and the second item there", 7, 8, 9), (3, None, 7, 8, 9)], "doc_id long, text string, __text int, bm_items int, BM_Text int")
    items = spark.createDataFrame([(5, "the first item here"), (6, "the second item there")], "item_id long, text string")
    for block_bytes in (1 << 20, 15):
        rows = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, items, block_bytes=block_bytes).collect()}
        assert [rows[i]["bm_items"] for i in (1, 2, 3)] == [[5], [6], []] and all((r["__text"], r["BM_Text"]) == (7, 9) for r in rows.values())
