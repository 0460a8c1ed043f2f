import json

import pytest
from pyspark.sql import functions as F

from sparloom import vocabulary as V
from sparloom.functions import colors, imagery, parsing, similarity, tags, text


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("given, want", [("The red Hat and shoes", ["red", "headwear", "footwear"]), ("", []), ("黑色裙子", []), ("a of the", []), ("socks  socks", ["legwear"])])
def test_tokens(spark, given, want):
    assert one(spark, text.tokens(F.lit(given)))[0] == want


def test_set_and_char_similarity(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    r = one(spark, text.set_jaccard(a, b), text.char_similarity(F.lit("黑色短裙"), F.lit("短裙")), text.char_similarity(F.lit("abc"), F.lit("abc")), text.char_similarity(F.lit("abc"), F.lit("bcd"), strip_ascii=False), text.compact_text(F.lit("Red 黑，色（x）")))
    assert r[0] == pytest.approx(1 / 3) and r[1] == 1.0 and r[2] == 0.0 and r[3] == pytest.approx(2 / 3) and r[4] == "黑色"


def test_names_and_lists(spark):
    r = one(spark, text.composite_parts(F.lit("黑色短裙与 腰带")), text.compound_halves(F.lit("短裙与腰带")), text.compound_halves(F.lit("裙与带")), text.append_once(F.lit("a;b"), F.lit("b")), text.append_once(F.lit("a"), F.lit("b")), text.snake_case(F.lit(" Hair Color ")), text.slug(F.lit("A b/c")), text.with_safe_rating(F.lit("solo  x")), text.families(F.lit("黑色短裙与皮靴"), V.OBJECT_FAMILIES))
    assert r[0] == ["黑色短裙", "腰带"] and r[1] == ["短裙", "腰带"] and r[2] == [] and r[3] == "a;b" and r[4] == "a;b"
    assert r[5] == "hair_color" and r[6] == "a_b_c" and r[7] == "solo x rating:safe" and r[8] == ["skirt"]


@pytest.mark.parametrize("given, families, ok", [("深蓝黑", ["black"], False), ("红棕色 和 红色", ["red", "red_brown"], True), ("red shirt, brown pants", ["brown", "red"], False), ("black or dark gray", ["black", "dark_gray"], True), ("black and brown", ["black", "brown"], False), ("灰色与银色", ["gray", "silver"], True)])
def test_colors(spark, given, families, ok):
    d = spark.createDataFrame([(given,)], "t string").select(colors.color_families("t").alias("f"))
    assert d.select("f", colors.tolerated(F.col("f"))).first()[:] == (families, ok)


def test_confidences(spark):
    r = one(spark, parsing.event_confidence(F.lit("0.42")), parsing.event_confidence(F.lit("high")), parsing.review_confidence(F.lit("0.42")), parsing.review_confidence(F.lit("very_high")), parsing.review_confidence(F.lit("7")), parsing.review_confidence(F.lit("?")), parsing.confidence_label(F.lit("0.95")), parsing.confidence_label(F.lit("x")))
    assert tuple(r) == (1.0, 0.95, 0.42, 0.95, 1.0, 0.75, "high", "medium")


@pytest.mark.parametrize("given, want", [('{"a": 1}', 1), ('```json\n{"a": 2}\n```', 2), ('Sure: {"a": 3} done', 3), ("none", None), ("", None), ("}{", None)])
def test_lenient_json(spark, given, want):
    assert one(spark, F.try_variant_get(parsing.lenient_json(F.lit(given)), "$.a", "int"))[0] == want


def test_parsing(spark):
    r = one(spark, parsing.inferred_attribute(F.lit("fabric_type"), F.lit("extra")), parsing.inferred_attribute(F.lit("x"), F.lit("wrong color")), parsing.rule_location(F.lit("hair_color")), parsing.rule_location(F.lit("cape_color")), parsing.rule_location(F.lit("mood")), parsing.rejection_kind(F.lit("Content Policy")), parsing.rejection_kind(F.lit("timeout")), parsing.relative_path(F.lit("/a/b/c"), "/a"), parsing.element_category(F.lit("Skin-Body")), parsing.element_category(F.lit("skin")), parsing.repaired_status(F.lit("wrong")), parsing.as_float(F.lit("x")), parsing.as_float(F.lit(" 2.5 ")))
    assert tuple(r) == ("material", "color", "head", "body", None, "content_policy_or_provider_rejection", "runtime_error", "b/c", "skin_body", "other", "wrong shape", 0.0, 2.5)
    p = one(spark, parsing.parameter(F.lit('a=hi "x"')), parsing.parameter(F.lit("n=3")))
    assert (p[0].key, json.loads(p[0].value), json.loads(p[1].value)) == ("a", 'hi "x"', 3)
    assert [one(spark, parsing.column_number(F.lit(x)))[0] for x in ("A1", "Z1", "AA3", "AB1", "AZ9", "BA2")] == [0, 25, 26, 27, 51, 52]
    with pytest.raises(Exception, match="must be a number"):
        one(spark, parsing.bounded(F.lit(1.5), "quality"))


def test_similarities(spark):
    d = spark.createDataFrame([("tide", "diet"), ("diet", "tide")], "a string, b string").select(similarity.sequence_ratio("a", "b"))
    assert [r[0] for r in d.collect()] == [0.25, 0.5]
    r = one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), similarity.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), similarity.sign_bits(F.array(F.lit(1.0), F.lit(-1.0), F.lit(2.0))), similarity.differing_bits(F.lit(-1).cast("long"), F.lit(0).cast("long")))
    assert r[0] == pytest.approx(0.7071067811865475) and tuple(r)[1:] == (0.0, 5, 64)


def test_tags(spark):
    bag = lambda t: tags.tag_set(F.lit(t))
    r = one(spark, tags.single_subject(bag("1girl solo")), tags.single_subject(bag("1girl 2boys")), tags.single_subject(bag("solo")), tags.single_subject(bag("1boy duo")), tags.source_key(F.lit("see https://Pixiv.net/a/1?q=2 x")), tags.source_key(F.lit("https://a.b/c/")), tags.character_signature(bag("1girl zed_(x) blue_hair abe"), F.lit(""), F.lit(3)), tags.character_signature(bag("1girl blue_hair"), F.lit("https://a.b/"), F.lit(3)), tags.character_signature(bag("1girl"), F.lit(""), F.lit(3)))
    assert tuple(r) == (True, False, False, False, "https://pixiv.net/a/1", "https://a.b/c", "character_tags:abe|zed_(x)", "source:https://a.b", "post:3")
    rules = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(v).alias("value")) for i, v in (("hair_color", " red "), ("gender", "x"), ("expression", "smile"), ("eye_color", ""))])
    assert one(spark, tags.identity_signature(rules))[0] == "expression=smile|hair_color=red"


def test_pixels_and_headers(spark):
    grey = [(x * 7919) % 256 for x in range(72)]
    want = 0
    for row in range(8):
        for col in range(8):
            want = want << 1 | (grey[row * 9 + col] > grey[row * 9 + col + 1])
    got = one(spark, imagery.difference_hash(F.array(*map(F.lit, grey))))[0]
    assert got & (1 << 64) - 1 == want
    red = F.array(F.struct(F.lit(255).alias("r"), F.lit(0).alias("g"), F.lit(0).alias("b")))
    m = one(spark, imagery.color_metrics(red))[0]
    assert (m.sat_mean, m.colorfulness, m.likely_color) == (1.0, 255.0, True)
    files = [b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (7).to_bytes(4, "big") + (9).to_bytes(4, "big"), b"GIF89a" + (5).to_bytes(2, "little") + (6).to_bytes(2, "little"), b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + (3).to_bytes(2, "big") + (4).to_bytes(2, "big"), b"nothing"]
    d = spark.createDataFrame([(bytearray(f),) for f in files], "c binary").select(imagery.image_size("c").alias("s"))
    assert [(r.s.width, r.s.height) for r in d.collect()] == [(7, 9), (5, 6), (4, 3), (None, None)]
