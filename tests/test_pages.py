import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.errors import InvalidImageError, InvalidThresholdError, RecognitionDataError
from corpuslens.operators import experiment as X
from corpuslens.operators import imaging as I
from corpuslens.operators import lines as L
from corpuslens.operators import reading_order as R
from corpuslens.operators import tokens as K

NAMES = ["text", "conf", "left", "top", "width", "height", "page_num", "block_num", "par_num", "line_num"]


def payload(spark, rows, names=NAMES):
    columns = [[None if v is None else str(v) for v in c] for c in zip(*rows, strict=True)] if rows else [[] for _ in names]
    return spark.createDataFrame([("p", dict(zip(names, columns, strict=True)))], "doc_id string, data struct<" + ",".join(f"{n}:array<string>" for n in names) + ">")


def page(spark, rows, height, threshold=60.0):
    tokens = K.require_valid(K.word_table_tokens(payload(spark, rows)))
    return L.recognise_pages(tokens, spark.createDataFrame([("p", height)], "doc_id string, image_height int"), threshold).first()


def test_two_lines_and_metadata(spark):
    r = page(spark, [("Rain", 88, 12, 300, 40, 18, 1, 1, 1, 1), ("fell.", 91, 60, 300, 44, 18, 1, 1, 1, 1), ("We", 70, 12, 340, 20, 18, 1, 1, 1, 2), ("ran.", 61, 40, 340, 30, 18, 1, 1, 1, 2)], 800)
    assert r["raw_text"] == r["body_text"] == "Rain fell.\nWe ran." and r["sentences"] == ["Rain fell.", "We ran."] and r["low_confidence_regions"] == []
    r = page(spark, [("Subject:", 80, 5, 30, 60, 12, 1, 1, 1, 1), ("weather", 81, 70, 30, 60, 12, 1, 1, 1, 1), ("It", 99, 5, 400, 12, 12, 1, 2, 1, 1), ("snows", 12.25, 20, 400, 44, 12, 1, 2, 1, 1), ("now.", 95, 70, 400, 30, 12, 1, 2, 1, 1)], 900)
    assert r["body_text"] == "It snows now." and r["excluded_metadata_lines"] == ["Subject: weather"] and [x["text"] for x in r["low_confidence_regions"]] == ["snows"]


def test_empty_page(spark):
    r = page(spark, [(" ", -1, 1, 1, 1, 1, 1, 1, 1, 1)], 100)
    assert r["raw_text"] == "" and r["sentences"] == [] and r["low_confidence_regions"] == []


def test_bad_payloads(spark):
    with pytest.raises(RecognitionDataError):
        K.word_table_tokens(payload(spark, [("a", 1)], ["text", "conf"]))
    for bad in ("nan", "x", "inf"):
        with pytest.raises(RecognitionDataError):
            K.require_valid(K.word_table_tokens(payload(spark, [("a", bad, 1, 1, 1, 1, 1, 1, 1, 1)])))
    uneven = spark.createDataFrame([("p", (["a", "b"], ["1"], ["1"], ["1"], ["1"], ["1"]))], "doc_id string, data struct<text:array<string>,conf:array<string>,left:array<string>,top:array<string>,width:array<string>,height:array<string>>")
    assert K.word_table_tokens(uneven).first()["error"] == "unequal_lengths"


@pytest.mark.parametrize("bad", [-0.1, 100.1, float("nan"), True, "60", None])
def test_thresholds(bad):
    with pytest.raises(InvalidThresholdError):
        K.validate_threshold(bad)


METADATA = [("Name: x", True), ("date:5", True), ("12/03/2024", True), ("2024-1-31", True), ("March 3rd, 2024", True), ("3 Mar 2024", True), ("My Holiday Story", True), ("MY STORY", True),
            ("My holiday story", False), ("My Story.", False), ("32/03/2024", False), ("Names: x", False), ("name:", False), ("O'Neil-Smith McDonald", False), ("One Two Three Four Five Six Seven Eight Nine", False)]


def test_metadata_rules(spark):
    rows = spark.createDataFrame(METADATA, "t string, wanted boolean")
    assert [tuple(r) for r in rows.filter(L.is_metadata(F.col("t"), F.lit(True)) != F.col("wanted")).collect()] == []


def test_line_results(spark):
    schema = "doc_id string, rec_texts array<string>, rec_scores array<double>, rec_boxes array<array<double>>, rec_polys array<array<array<double>>>, width int, height int, scale_x double, scale_y double"
    boxes = [[10, 5, 50, 25], [-10, -5, 20, 10], [80, 40, 120, 70], [110, 60, 130, 80], [-30, -20, -10, -5]]
    row = ("d", ["a", "b", "c", "d", "e"], [0.5] * 5, [[float(v) for v in b] for b in boxes], None, 200, 100, 0.5, 0.5)
    found = [tuple(r[b] for b in K.BOX) for r in K.line_result_tokens(spark.createDataFrame([row], schema)).orderBy("ord").collect()]
    assert found == [(20, 10, 80, 40), (0, 0, 40, 20), (160, 80, 40, 20), (200, 100, 0, 0), (0, 0, 0, 0)]
    polygon = ("d", [" ", "x"], [9.0, 0.25], None, [[[0.0, 0.0]] * 4, [[1.0, 2.0], [9.0, 2.0], [9.0, 8.0], [1.0, 8.0]]], 100, 100, 1.0, 1.0)
    r = K.line_result_tokens(spark.createDataFrame([polygon], schema)).collect()
    assert len(r) == 1 and r[0]["confidence"] == 25.0 and (r[0]["left"], r[0]["top"], r[0]["width"], r[0]["height"]) == (1, 2, 8, 6)
    bad = ("d", ["x"], [1.01], [[1.0, 1.0, 0.0, 2.0]], None, 10, 10, 1.0, 1.0)
    assert K.line_result_tokens(spark.createDataFrame([bad], schema)).first()["error"] == "bad_score"


def test_page_result_shapes(spark):
    rows = spark.createDataFrame([('{"res":{"a":1},"a":2}', '{"a":1}'), ('{"a":2}', '{"a":2}'), ("[1]", None), ("{", None)], "raw string, wanted string")
    assert rows.filter(~K.page_result(F.col("raw")).eqNullSafe(F.col("wanted"))).count() == 0


def test_resize(spark):
    r = spark.createDataFrame([(1000, 3000), (4000, 1000), (200, 100)], "w int, h int").select(*[c.alias(n) for n, c in K.resize_geometry(F.col("w"), F.col("h")).items()]).collect()
    assert [(x[0], x[1]) for x in r] == [(667, 2000), (2000, 500), (200, 100)] and r[0]["scale_x"] == 0.667
    for bad in (0, -1, True, 2000.0, "2000"):
        with pytest.raises(ValueError):
            K.resize_geometry(F.col("w"), F.col("h"), bad)


def order(spark, rows):
    columns = "doc_id string, ord int, text string, confidence double, left int, top int, width int, height int"
    found = R.reconstruct(spark.createDataFrame([("d", i, t, 1.0, l, p, 50, h) for i, (t, l, p, h) in enumerate(rows)], columns)).orderBy("ord").collect()
    return [(r["text"], r["line_num"]) for r in found]


def test_reading_order(spark):
    assert order(spark, [("Second", 50, 200, 30), ("world", 400, 100, 30), (" ", 1, 1, 1), ("Hello", 50, 100, 30)]) == [("Hello", 1), ("world", 1), ("Second", 2)]
    assert order(spark, [("left", 10, 100, 30), ("right", 80, 110, 30)]) == [("left", 1), ("right", 1)]
    assert order(spark, [("upper", 10, 100, 20), ("lower", 10, 119, 20)]) == [("upper", 1), ("lower", 2)]
    assert order(spark, [("Tall", 10, 90, 50), ("short", 80, 105, 20)]) == [("Tall", 1), ("short", 1)]


def test_reading_order_ignores_input_order():
    boxes = np.array([(100, 50, 60, 20), (105, 10, 30, 20), (300, 5, 30, 20)])
    for p in itertools.permutations(range(3)):
        b = boxes[list(p)]
        numbers, place = R.line_numbers(b[:, 0], b[:, 1], b[:, 2], b[:, 3], np.arange(3))
        assert [tuple(b[i]) for i in np.argsort(place)] == [tuple(boxes[i]) for i in (1, 0, 2)] and sorted(numbers) == [1, 1, 2]


def slow_line_numbers(boxes):
    """The rules word by word: every token is tested against every line."""
    lines = []
    for k in sorted(range(len(boxes)), key=lambda k: (boxes[k][0], boxes[k][1], boxes[k][0] + boxes[k][3], boxes[k][1] + boxes[k][2], k)):
        top, left, _, height = boxes[k]
        tall, best = max(1, height), None
        for n, members in enumerate(lines):
            t, b = min(boxes[m][0] for m in members), max(boxes[m][0] + boxes[m][3] for m in members)
            other = max(1, b - t)
            share = max(0, min(top + tall, b) - max(top, t)) / min(tall, other)
            apart = abs(top + tall / 2 - t - other / 2)
            if share >= 0.3 or apart <= 0.5 * max(tall, other):
                best = min(best or (9,), (-share, apart, t, min(boxes[m][1] for m in members), n))
        lines.append([k]) if best is None else lines[best[4]].append(k)
    lines.sort(key=lambda members: (min(boxes[m][0] for m in members), min(boxes[m][1] for m in members), min(members)))
    return {k: n + 1 for n, members in enumerate(lines) for k in members}


def test_reading_order_against_the_plain_rules():
    rng = np.random.default_rng(1)
    for size in (1, 2, 40, 150):
        for heights in (2, 30):
            boxes = [tuple(int(x) for x in rng.integers([0, 0, 0, 0], [200, 100, 40, heights])) for _ in range(size)]
            numbers, _ = R.line_numbers(*(np.array([b[i] for b in boxes], float) for i in range(4)), np.arange(size))
            assert dict(enumerate(numbers.tolist())) == slow_line_numbers(boxes)


def test_statistics(spark):
    tokens = K.require_valid(K.word_table_tokens(payload(spark, [("hello", 90, 1, 1, 1, 1, 1, 1, 1, 1), ("world", 30, 2, 1, 1, 1, 1, 1, 1, 1), (" ", -1, 0, 0, 1, 1, 1, 1, 1, 1), ("next", 60, 1, 9, 1, 1, 1, 1, 1, 2)])))
    r = L.confidence_statistics(tokens).first()
    assert (r["raw_text"], r["mean_confidence"], r["median_confidence"], r["low_confidence_token_ratio"], r["non_empty_token_count"]) == ("hello world\nnext", 60.0, 60.0, pytest.approx(1 / 3), 3)


def test_line_keys_of_statistics(spark):
    """A null line number is the line "None"; only an empty one falls back to the top, and without tops to the position."""
    rows = [("a", 1, 1, 10, 1, 1, 1, 1, 1, None), ("b", 1, 1, 90, 1, 1, 1, 1, 1, None), ("c", 1, 1, 10, 1, 1, 1, 1, 1, ""), ("d", 1, 1, 90, 1, 1, 1, 1, 1, ""), ("e", 1, 1, 10, 1, 1, 1, 1, 1, "")]
    tokens = K.require_valid(K.word_table_tokens(payload(spark, rows)))
    assert L.confidence_statistics(tokens).first()["raw_text"] == "a b\nc e\nd"
    assert L.confidence_statistics(tokens.drop("line_key")).first()["raw_text"] == "a b c d e"
    short = K.require_valid(K.word_table_tokens(payload(spark, [(*r[:6],) for r in rows], NAMES[:6])))
    assert [r["line_key"] for r in short.orderBy("ord").collect()] == [["", "", "", "", t] for t in ("10", "90", "10", "90", "10")]


def test_image_codes(spark):
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [("x", h, w, c, 0, bytes(n)) for h, w, c, n in ((3, 3, 3, 27), (3, 3, 1, 9), (1, 1, 3, 3), (1, 1, 1, 1), (3, 3, 4, 36), (3, 3, 3, 26), (0, 0, 3, 0), (-1, -1, -1, 0))]
    found = spark.createDataFrame([(r,) for r in rows], schema).select(K.image_errors(F.col("image")), K.image_errors(F.col("image"), **K.LINE_IMAGES)).collect()
    assert [r[0] for r in found] == [None, "wrong_channels", "too_small", "wrong_channels", "wrong_channels", "bad_size", "too_small", "undecodable"]
    assert [r[1] for r in found] == [None, None, None, None, "wrong_channels", "bad_size", "too_small", "undecodable"]


def test_experiment_ranks(spark):
    tokens = spark.createDataFrame([(p, "otsu", m, i, t, c, i, 1, 1, 1, 1, 1, 1, 1) for p in ("a", "b") for m, words, c in ((4, ["right", "text"], 10.0), (6, ["wrong", "words"], 99.0)) for i, t in enumerate(words)],
        "page string, profile string, psm int, ord int, text string, confidence double, left int, top int, width int, height int, page_num int, block_num int, paragraph_num int, line_num int")
    pages = spark.createDataFrame([("a", "a.png"), ("b", "b.png")], "page string, source_image string")
    truth = spark.createDataFrame([("a", "right text")], "page string, ground_truth string")
    found = X.run_experiment(pages, tokens, truth).collect()
    assert len(found) == 40 and found[0].__fields__ == X.RECORD
    by = {(r["page"], r["profile"], r["psm"]): r for r in found}
    assert by["a", "otsu", 4]["page_rank"] == by["a", "otsu", 4]["overall_rank"] == by["b", "otsu", 4]["overall_rank"] == 1
    assert by["b", "otsu", 4]["page_rank"] is None and by["b", "otsu", 4]["cer"] is None and by["b", "otsu", 4]["ground_truth_available"] is False
    assert by["a", "otsu", 6]["page_rank"] > 1


def drawn(angle=0.0):
    img = np.full((120, 240, 3), 255, np.uint8)
    for y in range(30, 100, 20):
        for x in range(30, 210):
            yy = int(round(y + np.tan(np.radians(angle)) * (x - 120)))
            img[yy : yy + 5, x] = 0
    return img


def test_profiles_and_preprocessing(spark):
    made = I.profiles(drawn())
    assert list(made) == X.PROFILES and all(v.shape == (120, 240) and v.dtype == np.uint8 for v in made.values())
    for name in X.PROFILES[1:]:
        assert set(np.unique(made[name])) <= {0, 255}
    assert (made["otsu"] == 0).sum() > 0 and (made["adaptive_line_removal"] == 0).sum() < (made["median_adaptive_no_clahe"] == 0).sum() / 4
    assert set(np.unique(I.preprocess(drawn()))) <= {0, 255}
    for bad in (np.zeros((2, 9, 3), np.uint8), np.zeros((9, 9), np.uint8), np.zeros((9, 9, 3))):
        with pytest.raises(InvalidImageError):
            I.validate_image(bad)
    schema = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = spark.createDataFrame([(("x", 120, 240, 3, 16, drawn().tobytes()),), (("y", -1, -1, -1, -1, b""),)], schema)
    found = I.preprocess_images(rows, all_profiles=True).collect()
    assert len(found) == 6 and [r["error"] for r in found if r["origin"] == "y"] == ["undecodable"]


@pytest.mark.parametrize("angle", [-4.0, 3.0])
def test_skew_is_recovered(angle):
    binary = np.where(I.greyscale(drawn(angle)) < 128, 0, 255).astype(np.uint8)
    assert I.skew_angle(binary) == pytest.approx(angle, abs=1.0)
    assert abs(I.skew_angle(I.deskew(binary))) < 1.0
    assert I.skew_angle(np.full((9, 9), 255, np.uint8)) is None


def test_area_resize():
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert I.resize_area(x, 2, 2).shape == (2, 2, 3) and I.resize_area(np.full((5, 7), 9, np.uint8), 3, 2).tolist() == [[9] * 3] * 2
