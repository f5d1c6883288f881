"""Golden micro-rows for the text expressions (FIXTURES.md)."""

from pyspark.sql import functions as F

from textlens.functions import text as T


def one(spark, expr, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_mentions_and_emails(spark):
    assert one(spark, T.anonymize_mentions, "hi @bob_1 mail a@b.com") == "hi @user mail a@user.com"


def test_user_tag(spark):
    assert one(spark, T.unify_user, "<user> hi") == "@user hi"


def test_retweet_substring_quirk(spark):
    assert one(spark, T.drop_retweet, "the heart of a party") == "the hea of a pay"
    assert one(spark, lambda c: T.drop_retweet(c, "token"), "rt the heart") == " the heart"


def test_collapse_unicode_whitespace(spark):
    assert one(spark, T.collapse_spaces, "a\t b") == "a b"


def test_entities_leave_spaces(spark):
    assert one(spark, T.strip_entities, "x &amp; y &#39;z") == "x  y z"


def test_emoji_class_removes_cjk(spark):
    assert one(spark, T.strip_emoji, "ok\U0001F600中é") == "oké"


def test_punctuation(spark):
    assert one(spark, T.replace_punctuation, "a-b_c @x!") == "a b_c @x "


def test_stopwords(spark):
    assert one(spark, lambda c: T.remove_stopwords(c, ["this", "is", "a"]), "this is  a cat") == "cat"


def test_leading_mentions(spark):
    assert one(spark, T.strip_leading_mentions, " @user: @user hello @user ") == "hello @user"
    assert one(spark, T.strip_leading_mentions, "@user::x") == ":x"


def test_leading_mentions_idempotent(spark):
    s = " @user @user: a @user b "
    once = one(spark, T.strip_leading_mentions, s)
    assert one(spark, T.strip_leading_mentions, once) == once


def test_words_match_python_split(spark):
    s = "  a b\x1c c　\n d "
    got = one(spark, lambda c: F.array_join(T.words(c), "|"), s)
    assert got == "|".join(s.split())


def test_clean_text_chain(spark):
    got = one(spark, T.clean_text, "@bob RT this is the Heart of a party!! &amp; \U0001F600 http")
    assert got == "hea pay http"


def test_words_match_wildcards(spark):
    df = spark.createDataFrame([("He*l", "Hell"), ("abc", "ABC"), ("ab", "abc")], "a string, b string")
    got = [r[0] for r in df.select(T.words_match("a", "b")).collect()]
    assert got == [True, False, False]


def test_case_codes(spark):
    df = spark.createDataFrame([("ABC",), ("abc",), ("Abc",), ("123",), ("straße",)], "w string")
    got = [r[0] for r in df.select(T.case_code("w")).collect()]
    assert got == [1, -1, 0, 0, -1]


def test_template(spark):
    got = one(spark, lambda c: T.format_template("[{text}]", c), "x")
    assert got == "[x]"
