import html
import re

import pytest
from pyspark.sql import functions as F

from reqloom.functions import text as T

# facts of the category rules
TITLES = {
    "Dell XPS 13 Review": "laptop", "MacBook Air M3 Review: Finally!": "laptop", "Alienware 15 R3 Review (GTX 1070)": "laptop",
    "Samsung Galaxy Book4 Pro 14: Why Does This Exist?": "laptop", "iPhone 15 Pro Max Review": "phone", "Nokia Lumia 1020 Review!": "phone",
    "Pixel 8 Review": "phone", "iPad Pro M4 Review": "tablet", "Sony WH-1000XM5 Review": "headphone", "AirPods Pro 2 Review": "headphone",
    "Apple Watch Ultra Review": "watch", "Samsung S95D OLED TV Review": "tv", "Steam Deck OLED Review": "console", "Mac Studio M2 Ultra Review": "desktop",
    "Apple Vision Pro Review": "vr", "Ray-Ban Meta Gen 2 Review": "vr", "RED Hydrogen One Review": "phone", "Motorola Droid Turbo Review": "phone",
    "Redmi Note 15 Pro Review": "phone", "Sony RX100 IV Review": "camera", "Canon 24mm f/1.4 L Review": "camera", "LG UltraFine 5K Review": "monitor",
    "Audio Technica ATH-M70X Review": "headphone", "Samsung Galaxy Gear Review": "watch", "Asus Transformer Pad Infinity Review": "tablet",
    "Lenovo LOQ Review": "laptop", "Alienware Aurora 2025 Review": "desktop", "LG Optimus G Pro Review": "phone", "Samsung Galaxy Round Review": "phone",
    "Asus M16 Review": "laptop", "Asus ProArt PX 13 Review": "laptop", "Google Stadia Review": "console", "Tesla Model 3 Review": "other",
    "Studio Display Review": "monitor", "My Personal Setup from 2019": "other",
}


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


def test_categories(spark):
    rows = spark.createDataFrame(list(TITLES.items()), "title string, expected string")
    wrong = rows.where(T.product_category(F.col("title")) != F.col("expected")).collect()
    assert wrong == []
    assert one(spark, T.product_category(F.col("t")), t=None) == "other"


@pytest.mark.parametrize("raw", ["aaaa  bbb c\n\nd", "x y &amp; z!!!!", "", "   ", "a\n\n\n\nb", "êêêê…\x1c…"])
def test_clean_text_is_what_python_says(spark, raw):
    expected = re.sub(r"\s+", " ", re.sub(r"(.)\1{2,}", r"\1\1", html.unescape(raw))).strip()
    assert one(spark, T.clean_text(F.col("t")), t=raw) == expected


def test_scalars(spark):
    assert one(spark, T.iso_date(F.col("t")), t="20240620") == "2024-06-20"
    assert one(spark, T.iso_date(F.col("t")), t="2024") is None
    assert one(spark, T.iso_year(F.col("t")), t="abcd-01-01") is None
    assert one(spark, T.title_has_review(F.col("t")), t="Hands on with it") is True
    assert one(spark, T.title_has_review(F.col("t")), t="Previewed") is False
    assert one(spark, T.word_count(F.col("t")), t="  two words ") == 2
    assert one(spark, T.word_count(F.col("t")), t="") == 0
    assert one(spark, T.portuguese_words(F.col("t")), t="Não é muito, você") == 3
    assert one(spark, T.tokens(F.col("t"), ("the",)), t="The éband's x2 cat_s cat") == ["cat"]
    assert one(spark, T.aspects(F.col("t")), t="tela, Preco ,x") == ["tela", "preco"]
    assert one(spark, T.sentences(F.col("t")), t="One. Two! Three? four") == ["One.", "Two!", "Three?", "four"]


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://www.youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"), ("https://youtu.be/abcdefghijk?si=1", "abcdefghijk"),
        ("http://m.youtube.com:443/shorts/zyx/", "zyx"), ("https://youtube.com/embed/zyx", "zyx"), ("https://www.youtube.com/live/A?x=1", "A"),
        ("https://example.com/watch?v=a", None), ("https://www.youtube.com/channel/x", None), ("not a url", None), (None, None),
    ],
)
def test_video_id(spark, url, expected):
    assert one(spark, T.video_id(F.col("t")), t=url) == expected


def test_language(spark):
    assert one(spark, T.detect_language(F.col("t")), t="the cat and the dog are in the house") == "en"
    assert one(spark, T.detect_language(F.col("t")), t="der Hund und die Katze sind nicht im Haus") == "de"
    assert one(spark, T.detect_language(F.col("t")), t="the cat and the") is None
    assert one(spark, T.detect_language(F.col("t")), t="xx yy zz ww vv uu") is None


def test_lexicon(spark):
    rows = spark.createDataFrame([("I wish it had another USB port.",), ("The fan is annoying and noisy.",), ("I absolutely love it.",), ("This issue is disappointing.",), (None,)], "s string")
    counts = T.lexicon_counts(F.col("s"))
    found = [tuple(r) for r in rows.select(T.lexicon_hint(counts), sum(counts.values(), F.lit(0))).collect()]
    assert found == [("pedido", 1), ("queixa", 1), ("outro", 0), ("queixa", 2), ("outro", 0)]
