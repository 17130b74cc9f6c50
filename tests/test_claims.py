"""What texts claim."""

import pytest
from pyspark.sql import functions as F

from cairn.functions import claims


def strings(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


def test_offers_and_numbers(spark):
    assert strings(spark, ["I have another written offer", "There is no other offer", "An offer from X", "nothing", None], claims.claims_other_offer) == [True, False, True, False, False]
    assert strings(spark, ["pay $95,000 now", "95000", "95 000", None], lambda c: claims.mentions_number(c, F.lit(95000))) == [True, True, False, False]


def test_clarity_adds_up(spark):
    score = lambda rank, *cards: (lambda c: claims.donor_clarity(c, F.lit(rank).cast("int"), F.array(*map(F.lit, cards)).cast("array<string>")))
    assert strings(spark, [""], score(3)) == [float("-inf")]
    assert strings(spark, ["I don't have any 3s."], score(3))[0] == pytest.approx(0.4 + 1.25 + 1.5 + 0.75 + 0.35)
    assert strings(spark, ["I play two threes."], score(3, "3H", "3S"))[0] == pytest.approx(0.4 + 0.3 + 1.0)
    assert strings(spark, ["x" * 200], score(None, "KH"))[0] == pytest.approx(-0.0025 * 120 + 0.15)


def test_prompts_and_generations(spark):
    assert strings(spark, ["<|start|>system<|message|>s<|end|><|start|>developer<|message|># Instructions\nDo<|end|><|start|>user<|message|>Go<|end|><|start|>assistant x", "<｜User｜>hi<｜Assistant｜>"], claims.clean_situation) == ["Do\n\nGo", "hi"]
    assert strings(spark, ["So I think", '{"action": 1}', "see action: x", "123", None], claims.usable_reasoning) == [True, False, False, False, False]
    own = lambda c: claims.own_generation(c, F.lit("P "), F.lit("ctx"))
    assert strings(spark, ["P ctx and more", "lead ctx tail assistantfinal x", "plain\nuser y", None], own) == ["and more", "tail", "plain", ""]
