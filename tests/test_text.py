"""Text functions on small cases."""

from pyspark.sql import functions as F

from corpuscle.functions import text as T


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first().x


def test_normalise(spark):
    assert one(spark, T.normalise("t"), t="  Straße “A” – b\n c ") == 'strasse "a" - b c'
    assert one(spark, T.word_tokens(T.normalise("t")), t="réaux well-known don't") == ["re", "aux", "well-known", "don't"]
    assert one(spark, T.word_count(T.normalise("t")), t="नमस्ते") == 0


def test_tokens(spark):
    assert one(spark, T.blank_tokens(F.col("t")), t=" not. a  b ") == ["not.", "a", "b"]
    assert one(spark, T.gate_tokens(F.col("t")), t="well-known don't") == ["well", "known", "don't"]
    assert one(spark, T.plan_tokens(F.col("t"), ["the"]), t="The Cell-wall") == ["cell", "wall"]


def test_verbatim_and_overlap(spark):
    split = lambda c: F.split(c, " ")
    assert one(spark, T.contains_verbatim(split("s"), split("q")), s="a force acts", q="force acts")
    assert not one(spark, T.contains_verbatim(split("s"), split("q")), s="a force acts", q="orce acts")
    assert one(spark, T.lexical_overlap(split("c"), split("s")), c="a a b", s="a c") == 2 / 3
    assert one(spark, T.lexical_overlap(F.array().cast("array<string>"), split("s")), s="a") == 0
    assert one(spark, T.jaccard(split("a"), split("b")), a="x x y", b="y z") == 1 / 3


def test_distinct_ratio_depends_on_order(spark):
    lists = F.array(*[F.split(F.lit(s), " ") for s in ("a b c", "a b d", "a d e")])
    assert one(spark, T.distinct_ratio(lists, 0.5)) == 2 / 3
    assert one(spark, T.distinct_ratio(F.slice(lists, 1, 0), 0.5)) == 1


def test_sentences_and_syllables(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!\nThree; four") == ["One", "Two", "Three", "four"]
    assert one(spark, T.long_word_share(F.array(F.lit("banana"), F.lit("cat"), F.lit("xyz"), F.lit("b")))) == 0.25
    assert one(spark, T.estimate_tokens(F.col("t")), t="abc") == 1


def test_numbers(spark):
    assert one(spark, T.digits_only(F.col("t")), t="10-12 minutes") == 1012
    assert one(spark, T.digits_only(F.col("t")), t="soon") is None
    assert [one(spark, T.tolerant_int(F.col("t"), 7), t=t) for t in ("3.9", "one")] == [3, 7]


def risk(spark, claim, span):
    return one(spark, T.contradiction(T.gate_tokens(F.col("c")), T.gate_tokens(F.col("s"))), c=claim, s=span)


def test_contradiction(spark):
    assert risk(spark, "force does not act", "force acts") == "added_negation"
    assert risk(spark, "pressure increases with depth", "pressure decreases with depth") == "polarity"
    assert risk(spark, "it increases and decreases", "it decreases") is None
    assert risk(spark, "charge travels through rubber", "charge never travels through rubber") == "dropped_negation"
    assert risk(spark, "charge is conserved", "charge is conserved and not created from nothing at all") is None


def test_headings_and_equations(spark):
    level = lambda t, **k: one(spark, T.heading_level(F.col("t"), **k), t=t)
    assert level("3.2 Newton's Laws") == 2 and level("Chapter 4 Motion") == 1
    assert level("1791 further discredited the monarchy") is None and level("4 p e") is None
    assert level("Electric Charge", ratio=F.lit(1.9)) == 1 and level("Electric Charge", ratio=F.lit(1.2)) == 3
    assert level("Electric Charge", bold=F.lit(True)) == 2 and level("Electric Charge.", bold=F.lit(True)) is None
    eq = lambda t: one(spark, T.is_equation(F.col("t")), t=t)
    assert eq("F = ma") and eq("$x$") and eq("α ≤ β") and not eq("the sum of a and b = c is that") and not eq("plain words")


def test_lines_and_sentences_keep_their_digits(spark):
    """Only blanks are cut at the ends, whatever a line's number."""
    from corpuscle.functions import text as T
    from corpuscle.operators import structure

    df = spark.createDataFrame([("0 zero 0\n  1 one 1 \n\n \n3 three 3. 4 four 4!  5 five 5",)], "t string")
    r = df.select(structure.lines_of(df.t).alias("l"), T.sentences(df.t).alias("s")).first()
    assert r.l == ["0 zero 0", "1 one 1", "3 three 3. 4 four 4!  5 five 5"]
    assert r.s == ["0 zero 0", "1 one 1", "3 three 3", "4 four 4", "5 five 5"]
