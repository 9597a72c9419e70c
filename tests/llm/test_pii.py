import random
from datetime import date

from rungwork.llm import pii as P
from tests.conftest import rows

CLASSES = dict.fromkeys("the my aunt and we went to school with worked at was out on barge reel call is said a of box had cards in it paid for summary not i you he she mother".split(), "o") | dict.fromkeys("tarn mills heron point gull street mission".split(), "f") | {"catalogued": "s"} | dict.fromkeys(["joris", "stisura", "ashina", "libova"], "n")
ENDS = frozenset(["mills", "point"])


def kinds(text):
    return [(k, text[a:b]) for k, a, b in P.find(text, CLASSES, ENDS)]


def test_kinds_of_information():
    assert kinds("My aunt Joris T. Stisura worked at Gull Street Mission.") == [("name", "Joris T. Stisura")]
    assert kinds("We said Mrs. Stisura and C. Libova and Libova, Ashina.") == [("name", "Stisura"), ("name", "C. Libova"), ("name", "Libova, Ashina")]
    assert kinds("Joris Stisura's box; ashina libova went.") == [("name", "Joris Stisura"), ("name", "ashina libova")]
    assert kinds("Joris went to school.") == []
    assert kinds("Write a.b+c@mail.x.test, or d_1 (at) y-z (dot) test, or k dot l at m dot test.") == [("email", "a.b+c@mail.x.test"), ("email", "d_1 (at) y-z (dot) test"), ("email", "k dot l at m dot test")]
    assert kinds("Call 415-555-0113 ext. 282 or (415) 555-0184 or +44 7700 900965 or 555-0199.") == [("phone", "415-555-0113 ext. 282"), ("phone", "(415) 555-0184"), ("phone", "+44 7700 900965"), ("phone", "555-0199")]
    assert kinds("It was 915-38-9389, RC-1931-90172-H, 16/122792/D, K 306 441 57, L6845756.") == [("id_number", x) for x in ("915-38-9389", "RC-1931-90172-H", "16/122792/D", "K 306 441 57", "L6845756")]
    assert kinds("We went to No. 70, Lantern Road, Apt 15, Tarn Mills 44066 and P.O. Box 37, Heron Point.") == [("address", "No. 70, Lantern Road, Apt 15, Tarn Mills 44066"), ("address", "P.O. Box 37, Heron Point")]
    assert kinds("1304c W. Ropewalk Rd.") == [("address", "1304c W. Ropewalk Rd")]


def test_other_numbers_are_no_cases():
    for text in ("It was on reel 5133-35, box 34, folder 1.", "We paid $1,212.22 in 1953-1958.", "See 1939-2514-K.", "I was on Barge 555.", "Catalogued TK/555/231 at 00:10:12.345.", "Box 22 had cards in it.", "", None):
        assert P.find(text, CLASSES, ENDS) == [], text


def test_offsets_and_replacement_keep_the_rest():
    text = "é – Call 415-555-0113 and Joris Stisura, then 415.555.0113."
    found = P.find(text, CLASSES, ENDS)
    assert [text[a:b] for _, a, b in found] == ["415-555-0113", "Joris Stisura", "415.555.0113"]
    out = P.replace(text, found, b"k")
    assert out.startswith("é – Call <PHONE:") and out.endswith(">.") and "Stisura" not in out
    a, b = (P.pseudonym("phone", x, b"k") for x in ("415-555-0113", "415.555.0113"))
    assert "".join(filter(str.isdigit, a)) == "".join(filter(str.isdigit, b)) and a != P.pseudonym("phone", "415-555-0113", b"other")


def test_feistel_round_trips_and_is_one_to_one():
    rng = random.Random(2)
    for n in (1, 2, 3, 7, 10, 15):
        for _ in range(40):
            d = "".join(rng.choice("0123456789") for _ in range(n))
            e = P.permute_digits(d, b"key")
            assert len(e) == n and P.restore_digits(e, b"key") == d
    assert len({P.permute_digits(f"{i:03d}", b"key") for i in range(1000)}) == 1000
    days = [date(1900, 1, 1 + i) for i in range(28)]
    assert len({P.permute_date(d, b"k") for d in days}) == 28 and P.permute_date(date(1700, 1, 1), b"k") == date(1700, 1, 1)


def test_tables_with_nulls_repeats_and_clashing_columns(spark):
    turns = spark.createDataFrame([(1, "My aunt Joris Stisura.", "x"), (1, "My aunt Joris Stisura.", "y"), (2, None, None), (None, "Joris Stisura", None)], "turn_id long, raw string, text string")
    segs = spark.createDataFrame([("s1", "Call 555-0199."), (None, "555-0199")], "segment_id string, description string")
    assert rows(P.records(turns, segs).distinct().select("record_kind", "record_id")) == [("segment", "s1"), ("turn", "1")]
    texts = spark.createDataFrame([("the aunt Zed said the aunt Zed and the dog",), ("",)], "text string")
    words = spark.createDataFrame([("tarn",)], "word string")
    assert P.word_classes(texts, words)["the"] == "o" and P.word_classes(texts.filter("false"), words) == {"tarn": "f"}


def test_very_long_text():
    text = "the box had cards. " * 20000 + "Call 415-555-0113."
    assert [k for k, _, _ in P.find(text, CLASSES, ENDS)] == ["phone"]


def test_common_and_copied_names_stay_names(spark):
    copied = [("We saw Joris Stisura on the barge, and Joris Stisura saw us.",)] * 60
    common = [(f"She met Ashina Libova again on day {i}, word{i} and other{i}.",) for i in range(40)]
    place = [(f"We worked at Gull Mission and at Tarn Hall in year {i}.",) for i in range(40)]
    got = P.word_classes(spark.createDataFrame(copied + common + place, "text string"), spark.createDataFrame([], "word string"))
    assert [got.get(w) for w in ("joris", "stisura", "ashina", "libova")] == ["n"] * 4
    assert [got.get(w) for w in ("gull", "mission", "tarn", "hall")] == ["f"] * 4


def test_no_class_of_place_vetoes_after_title_or_initials():
    assert kinds("We met Mrs. Heron and Captain Mission and J. T. Heron.") == [("name", "Heron"), ("name", "Mission"), ("name", "J. T. Heron")]
    assert kinds("We went to the doctor. The box was at Heron Point.") == []


def test_numbers_must_be_valid():
    good = ["AB1234567", "QQ 12 34 56 C".replace("QQ", "AB"), "4539 1488 0343 6467", "DE89 3704 0044 0532 0130 00", "915-38-9389"]
    bad = ["000-00-0000", "666-12-3456", "123-00-4567", "4539 1488 0343 6466", "DE88 3704 0044 0532 0130 00", "BG 12 34 56 C", "RC-9950-51279-A"]
    for x in good:
        assert kinds(f"It was {x} on it") == [("id_number", x)], x
    for x in bad:
        assert not [k for k, _ in kinds(f"It was {x} on it") if k == "id_number"], x
    for x in ("020 7946 0958", "+33 1 42 68 53 00", "+1 415 555 0113", "+353 1 679 9000", "01632 960608", "0491 570 379", "4155550178", "1-415-555-0113"):
        assert kinds(f"Call {x} said") == [("phone", x)], x
    for x in ("115-555-0113", "415-055-0113", "+281 415 555 011", "1234567890", "155-0113"):
        assert not [k for k, _ in kinds(f"Call {x} said") if k == "phone"], x
    assert kinds("We went to 12 Rue de Rivoli, Paris.") == [("address", "12 Rue de Rivoli, Paris")]


def national(value):
    out = P.pseudonym("phone", value, b"k")[len("<PHONE:") : -1]
    a, b, _ = P.phone_parts(value)
    assert P.phone_parts(out) == P.phone_parts(value) and len(out) == len(value)
    return "".join(c for c in P._EXTENSION.sub("", out) if c.isdigit())[a:b]


def test_spellings_of_one_number_stay_linked():
    assert len({national(x) for x in ("+1 415 555 0113", "(415) 555-0113", "415-555-0113 ext. 2", "4155550113", "1-415-555-0113", "415.555.0113")}) == 1
    assert national("+44 7700 900965") == national("07700 900965") != national("+44 7700 900966")
    assert len({national(f"415-555-{i:04d}") for i in range(3000)}) == 3000
    ids = [f"9{i:02d}-38-{j:04d}" for i in range(15, 45) for j in range(1, 60)]
    assert len({P.pseudonym("id_number", x, b"k") for x in ids}) == len(ids) and all(P.valid_id(P.pseudonym("id_number", x, b"k")[11:-1]) for x in ids[:200])
    assert P.valid_id(P.pseudonym("id_number", "4539 1488 0343 6467", b"k")[11:-1]) and P.valid_id(P.pseudonym("id_number", "DE89 3704 0044 0532 0130 00", b"k")[11:-1])


def test_dates_are_found_validated_and_permuted():
    def dates(text):
        return [text[a:b] for k, a, b in P.find(text, CLASSES, ENDS, dates=True) if k == "date"]

    for x in ("March 5, 1942", "5 March 1942", "5th of march 1942", "Mar. 05, 1942", "1942-03-05", "03/05/1942", "25/12/1940", "5.3.1942", "MAY 7 1950"):
        assert dates(f"It was {x} then") == [x], x
        out = P.pseudonym("date", x, b"k")[6:-1]
        assert P._DATE.fullmatch(out) and out != x, out
    for x in ("February 30, 1942", "1942-13-05", "33/12/1940", "in 1942", "00/00/1900"):
        assert dates(f"It was {x} then") == [], x
    same = {P.date_of(P._DATE.fullmatch(P.pseudonym("date", x, b"k")[6:-1]))[0] for x in ("March 5, 1942", "5 March 1942", "1942-03-05")}
    assert len(same) == 1
    assert P.find("It was March 5, 1942.", CLASSES, ENDS) == [] and P.find(None, CLASSES, ENDS, dates=True) == []


def test_marks_have_128_bits_and_the_key_is_the_callers(spark):
    assert len(P.pseudonym("name", "Ana Lee", b"k")) == len("<NAME:>") + 32 and P.pseudonym("name", "Ana  LEE", b"k") == P.pseudonym("name", "Ana Lee", b"k")
    own = P.pseudonym_key(spark)
    assert len(own) == 32 and own == P.pseudonym_key(spark)
    spark.conf.set(P.KEY_SETTING, "mine")
    assert P.pseudonym_key(spark) == b"mine"
    spark.conf.unset(P.KEY_SETTING)


def test_quick_look_lets_every_name_through():
    for text in ("We met Dr. Gull there.", "my aunt, j. stisura, went", "ashina libova went", "Libova, Ashina", "Joris T. Stisura", "prof Mills said", "Xavi Yorin's box"):
        assert P._may_hold_name(text, CLASSES) and any(k == "name" for k, _ in kinds(text)), text
    for text in ("Joris went to school.", "we went to school", "Unknown went out", ""):
        assert not P._may_hold_name(text, CLASSES) and not kinds(text)
