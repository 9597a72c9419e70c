import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rungwork.llm import leak as L
from rungwork.llm import overlap as O
from rungwork.llm import transcripts as T
from tests.conftest import rows

RNG = random.Random(6)
VOCABULARY = [f"word{i}" for i in range(400)]


def sentence(n=14):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n)) + "."


# overlap


def test_banded_distance_and_best_place():
    a = "a b c d e f".split()
    assert O.banded_distance(a, a, 0) == 0 and O.banded_distance(a, a[1:], 2) == 1 and O.banded_distance(a, list("uvwxyz"), 3) == 4
    assert O.best_place("c d x".split(), a, 2) == 1 and O.best_place("p q r".split(), a, 1) == 2
    for _ in range(60):  # against the plain table
        x, y = ([RNG.choice("abc") for _ in range(RNG.randrange(1, 9))] for _ in range(2))
        d = np.zeros((len(x) + 1, len(y) + 1), int)
        d[:, 0], d[0] = range(len(x) + 1), range(len(y) + 1)
        s = d.copy()
        s[0] = 0
        for m in (d, s):
            for i in range(1, len(x) + 1):
                for j in range(1, len(y) + 1):
                    m[i, j] = min(m[i - 1, j] + 1, m[i, j - 1] + 1, m[i - 1, j - 1] + (x[i - 1] != y[j - 1]))
        assert O.banded_distance(x, y, 9) == d[-1, -1]
        for k in (0, 1, 3, 9):
            assert O.best_place(x, y, k) == O._long_place(x, y, k) == min(s[-1].min(), k + 1)
            if abs(len(x) - len(y)) <= k:
                assert O.banded_distance(x, y, k) == O._long_distance(x, y, k) == min(d[-1, -1], k + 1)


SEG = "segment_id string, collection_id string, description string, text_id string, n int, bucket string"


def test_overlap_through_layout_order_and_edits(spark):
    stock = "This recording was made possible by the society."
    body = [sentence() for _ in range(5)]
    edited = [body[0].replace(body[0].split()[3], "changed"), *body[1:]]
    data = [("e1", " ".join(body) + " " + stock), ("t1", "<p>" + "</p> <p>".join(reversed(edited)).upper() + "</p>"), ("t2", " ".join(body[:2] + [sentence() for _ in range(4)])), ("e2", " ".join(body)), ("e3", "Too short. " + stock), ("t3", "Too short. " + stock), ("t4", None), ("t5", "")]
    data += [(f"f{i}", " ".join(sentence() for _ in range(4)) + " " + stock) for i in range(12)]
    seg = spark.createDataFrame([(i, "c", d, "x", 1, "y") for i, d in data] + [(None, "c", " ".join(body), "x", 1, "y"), ("e1", "c", data[0][1], "z", 2, "y")], SEG)
    split = spark.createDataFrame([("random", "segment", i, "Train " if i[0] == "t" else "dev") for i, _ in data] + [("random", "segment", None, "train")], "split_kind string, unit_type string, unit string, bucket string")
    classes = O.text_classes(seg, split).persist()
    links = O.all_links(classes, O.class_links(classes))
    ids = {r["text_id"]: r["segment_id"] for r in classes.filter("segment_id in ('e1', 't1', 't2')").collect()}
    assert {(ids.get(a), ids.get(b)) for a, b in rows(links)} == {("e1", "t1")}
    assert classes.filter("segment_id in ('e1', 'e2')").select("text_id").distinct().count() == 1
    none = O.text_classes(seg.filter("false"), split)
    assert O.all_links(none, O.class_links(none)).count() == 0


def spread_edits(words, share):
    """``words`` with so many evenly spread ones replaced, dropped or doubled."""
    k = int(share * len(words))
    at = {int((i + 0.5) * len(words) / k) for i in range(k)} if k else set()
    return [x for i, w in enumerate(words) for x in (([f"new{i}"], [], [w, "more"])[RNG.choice((0, 0, 0, 1, 2))] if i in at else [w])]


def test_overlap_finds_every_pair_of_brute_force(spark):
    few = VOCABULARY[:60]  # so most short stretches are common
    texts = {}
    for n in range(90):
        sents = [[RNG.choice(few) for _ in range(RNG.choice((1, 3, 9, 14)))] for _ in range(RNG.choice((3, 5, 12)))]
        texts[f"e{n}"] = sents
        share = (0.1, 0.17, 0.24)[n % 3]
        changed = [x for x in (spread_edits(s, share) for s in sents) if x] if n % 2 else [spread_edits([w for s in sents for w in s], share)]
        texts[f"t{n}"] = RNG.sample(changed, len(changed))
    texts = {k: [" ".join(s) for s in v] for k, v in texts.items()}
    texts = {k: v for k, v in texts.items() if len(" ".join(v).split(" ")) >= O.LEAST_WORDS}
    df = spark.createDataFrame([(k, v, "train" if k[0] == "t" else "val") for k, v in texts.items()], "text_id string, sents array<string>, bucket string")
    got = {tuple(r) for r in O.class_links(df).collect()}
    want = {(e, t) for e in texts if e[0] == "e" for t in texts if t[0] == "t" and O.near_same(texts[e], texts[t])}
    assert got == want and len({e for e, t in want if e[1:] == t[1:]}) >= 60
    assert {(k, f"t{k[1:]}") for k in texts if k[0] == "e" and int(k[1:]) % 3 == 0 and f"t{k[1:]}" in texts} <= got


def test_cuts_are_disjoint_within_sentences_and_one_more_than_edits():
    sizes = [[1] * 12, [2, 3, 1, 9], [70, 1, 2, 200], [5] * 40, [17], [1, 400]]
    h = [[RNG.randrange(1 << 40) for _ in range(sum(s))] for s in sizes]
    t = O._Texts(pd.DataFrame({"id": range(len(sizes)), "h": h, "sl": sizes}))
    at, length, _ = O.cut(t, np.ones(1 << O.FREQUENCY_BITS, dtype=np.float32))
    for d, s in enumerate(sizes):
        mine = t.doc[at] == d
        used = np.concatenate([np.arange(a, a + n) for a, n in zip(t.pos[at[mine]], length[mine], strict=True)])
        assert mine.sum() == O.most_edits(sum(s)) + 1 and len(set(used)) == len(used) and used.max() < sum(s)
        assert all(t.s_len[a] - t.s_pos[a] >= n for a, n in zip(at[mine], length[mine], strict=True))


# leaks


def test_leaks_with_noise_match_what_was_planted(spark):
    passage = [RNG.choice(VOCABULARY) for _ in range(60)]
    swapped = [w if i % 13 else "otherword" for i, w in enumerate(passage)]
    filler = lambda n: " ".join(f"x{RNG.randrange(999)}" for _ in range(n))
    docs = {
        1: f"{filler(30)} {' '.join(passage)} {filler(30)}",
        2: f"<p>{filler(5)}</p>" + "<b>" + "</b> ".join(w.upper() for w in passage[10:35]) + filler(9),
        3: f"{filler(40)} {' '.join(swapped)}",
        4: f"{filler(30)} {' '.join(passage[:18])} {filler(30)}",
        5: f"{filler(20)} " + "\n".join(" ".join(passage[i : i + 5]) for i in range(0, 30, 5)).replace("word", "wo-\nrd", 2),
        6: "",
        7: None,
        8: filler(5000) + " " + " ".join(passage[5:30]),
    }
    items = [(9, " ".join(passage[:30]) + ". " + " ".join(passage[30:]) + ". Where was that?", "s"), (9, None, "s"), (None, "x", "s"), (10, "short one.", "s"), *[(20 + i, "Read the passage and answer. " + sentence(30), "s") for i in range(4)]]
    d = spark.createDataFrame([(k, v, "c") for k, v in docs.items()] + [(1, docs[1], "again"), (None, docs[1], "c")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string, passage string")
    want = [(1, 9), (2, 9), (3, 9), (5, 9), (8, 9)]
    assert rows(L.leaks(d, i)) == want
    assert rows(L.leaks(d, i, block_words=40)) == want
    assert L.leaks(d.filter("false"), i).count() == 0 and L.leaks(d, i.filter("false")).count() == 0


def test_recall_of_windows_with_two_edits():
    hit = 0
    for t in range(60):
        p = [RNG.choice(VOCABULARY) for _ in range(20)]
        q = list(p)
        for k in RNG.sample(range(1, 19), 2):
            q[k] = "other"
        ix = L.build_index([(1, " ".join(p))])
        hit += bool(L.scan([" ".join(q)], ix))
    assert hit >= 54


# transcripts


PAGE = """<html><body><p>Title: X</p><p>Narrators: Ana Bé Lee and Bo Ray</p><p>Interviewer: Cy Fox (primary)</p><p>&lt;Begin Segment 1&gt;</p>
<p>[00:00:01] <b>CF:</b> um, Where -- where were you?</p><p>ABL: At home.</p><p>And (laughter) away.</p><p>CF: [pause]</p><p>Page 12</p><p>LEE: Still me.</p><p>Male voice: Hello.</p><p>Q: He said: no.</p><p>R.: eh</p></body></html>"""


def test_turns_of_a_page():
    who = T.header_of(T.lines_of(PAGE))[0]
    assert who == [("Ana Bé Lee", "NARRATOR"), ("Bo Ray", "NARRATOR"), ("Cy Fox", "INTERVIEWER")] and T.initials("Ána b. Lee-Fox Ito") == "ABL"
    got = T.parse_chunk(PAGE, True, who)
    assert [(s, w) for s, w, _ in got] == [("2", True), ("0", True), ("2", False), ("0", True), ("UNK", True), ("2", True), ("UNK", True)]
    assert got[0][2] == "Where were you?" and got[1][2] == "At home. And away."


def test_turns_over_chunks_late_repeated_and_null(spark):
    data = [("i1", 2, "went out.\nCF: Why?", 9), ("i1", 1, PAGE.replace("<p>R.: eh</p>", "<p>BR: I</p>"), 1), ("i1", 1, PAGE.replace("<p>R.: eh</p>", "<p>BR: I</p>"), 5), ("i2", 1, None, 1), (None, 1, "A: x", 1), ("i3", None, "Hello there", 1), ("i4", 1, "", 1)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "interview_id string, chunk_no int, html string, received_at int, pos string")
    got = rows(T.turns(df).select("interview_id", "turn_no", "speaker_tag", "clean"))
    assert [(i, n, s) for i, n, s, _ in got] == [("i1", 1, "CF"), ("i1", 2, "ABL"), ("i1", 3, "UNK"), ("i1", 4, "CF"), ("i1", 5, "BR"), ("i1", 6, "CF"), ("i3", 1, "UNK")]
    assert got[4][3] == "I went out." and T.turns(df.filter("false")).count() == 0


def test_chunk_order_resolves_conflicts():
    c = [("a", 2, 5, 900), ("b", 1, 9, 10), ("c", None, 6, None)]
    got = T.chunk_order(c)
    assert got["b"] < got["a"] < got["c"]
    assert T.chunk_order([("x", None, None, 50), ("y", None, None, 20)]) == {"y": 0, "x": 1}


def test_constraints_are_taken_by_weight():
    # a number outweighs mark and time together
    c = [("a", 2, 1, 10), ("b", 3, 2, 200), ("x", 1, 3, 400)]
    assert T.chunk_order(c) == {"x": 0, "a": 1, "b": 2}
    # without numbers a mark outweighs a time
    assert T.chunk_order([("a", None, 1, 90), ("b", None, 2, 10)]) == {"a": 0, "b": 1}
    # where number and time agree against the mark they win
    c = [("a", 1, 9, 10), ("b", 2, 1, 200)]
    assert T.chunk_order(c) == {"a": 0, "b": 1}
    # numbers missing: marks and times order what they know, long interviews without a path search per edge
    n = 5000
    got = T.chunk_order([(f"k{i:05d}", None, i // 2, i * 30) for i in RNG.sample(range(n), n)])
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == [f"k{i:05d}" for i in range(n)]


def test_order_has_no_circles_and_keeps_the_heaviest(spark):
    for _ in range(300):
        chunks = [(f"c{i}", *(RNG.choice([None, RNG.randrange(6)]) for _ in range(3))) for i in range(RNG.randrange(1, 8))]
        got = T.chunk_order(chunks)
        assert sorted(got.values()) == list(range(len(chunks)))
        numbered = [c for c in chunks if c[1] is not None]
        if len({c[1] for c in numbered}) == len(numbered) == len(chunks) and len({c[2] for c in chunks}) == 1:
            assert [c[0] for c in sorted(chunks, key=lambda c: c[1])] == sorted(got, key=got.get)


def test_clean_text_of_given_turns():
    import pathlib

    path = pathlib.Path("/root/testdata/sf0.01/turns.parquet")
    if not path.exists():
        pytest.skip("no tables here")
    t = pd.read_parquet(path, columns=["raw", "clean"]).dropna()
    # what is left are names of places typed in lower case, whose capitals nothing tells
    assert np.mean([T.clean_text(r) == c for r, c in zip(t["raw"], t["clean"], strict=True)]) > 0.985
    assert T.clean_text("It is um, x_1 (at) y [dot] test (laughs) [pause], no.") == "It is x_1 (at) y [dot] test, no."


@pytest.mark.parametrize("text", ["[laughs]", "uh, um", "00:01:02", "Page 7", "--", ""])
def test_noise_is_no_turn(text):
    assert not T.has_words(text)


def test_stock_sentences_share(spark):
    texts = spark.createDataFrame([([f"one two three four five six {i}", "this is the stock sentence here now"],) for i in range(30)], "sents array<string>")
    assert O.stock_sentences(texts).first()["stock"] == ["this is the stock sentence here now"]
    assert texts.select(F.size("sents")).count() == 30


def test_items_that_share_a_passage_keep_it(spark):
    told = "Read the passage and answer the question below."
    own = [" ".join(sentence() for _ in range(3)) for _ in range(4)]
    body = [sentence(), sentence(), "And what could we do then?", sentence()]
    reused = " ".join(body)
    data = [(i, f"{told} {p} What is it about?") for i, p in enumerate(own)]
    data += [(10 + i, f"{told} {reused} Which is number {i}?") for i in range(6)]
    changed = [f"{body[0]} {body[1]} {' '.join(body[2:])}".replace(body[1], sentence(18)) for _ in range(4)]
    data += [(20 + i, f"{told} {p}") for i, p in enumerate(changed)]
    items = spark.createDataFrame(data, "item_id long, text string")
    want = dict(enumerate(own)) | {10 + i: reused for i in range(6)} | {20 + i: p for i, p in enumerate(changed)}
    assert dict(rows(L.passages(items).select("item_id", "passage"))) == want
    docs = spark.createDataFrame([(1, reused)], "doc_id long, text string")
    assert {(1, 10 + i) for i in range(6)} <= set(rows(L.leaks(docs, items)))


@pytest.mark.parametrize("n_items", [1, 2, 3, 5])
def test_a_passage_of_several_items_leaks_for_each(spark, n_items):
    passage = " ".join(sentence(12) for _ in range(4))
    items = spark.createDataFrame([(i, f"{passage} What is question {i}?") for i in range(n_items)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{sentence(30)} {passage} {sentence(9)}")], "doc_id long, text string")
    assert rows(L.leaks(docs, items)) == [(1, i) for i in range(n_items)]


def test_a_question_inside_a_passage_is_part_of_it(spark):
    passage = f"{sentence(12)} {sentence(12)[:-1]}? {sentence(12)}"
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{sentence(30)} {passage} {sentence(9)}")], "doc_id long, text string")
    assert rows(L.leaks(docs, items)) == [(1, 1)]


def test_copies_do_not_hide_a_stock_sentence(spark):
    stock = "this is the stock sentence here now"
    copy = ["alpha beta gamma delta epsilon zeta", stock]
    data = [(copy,)] * 50 + [([f"one two three four five six {i}", stock],) for i in range(15)] + [([f"seven eight nine ten eleven twelve {i}"],) for i in range(85)]
    assert O.stock_sentences(spark.createDataFrame(data, "sents array<string>")).first()["stock"] == [stock]
