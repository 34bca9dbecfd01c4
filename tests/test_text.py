"""Scalar functions on hand-made values."""

import math

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import tools as U
from quarry.functions import vectors as V


def value(spark, column, **row):
    names = list(row) or ["x"]
    df = spark.createDataFrame([tuple(row.values()) or (1,)], ", ".join(
        f"{n} string" if row else f"{n} int" for n in names))
    return df.select(column.alias("v")).first()["v"]


def test_tokenize_mixes_words_and_han_pairs(spark):
    assert value(spark, T.tokenize("t"), t="退款政策 ABC-12 中 x") == [
        "退款", "款政", "政策", "abc", "12", "中", "x"]
    assert value(spark, T.tokenize("t"), t=" Hello, wörld ") == ["hello", "w", "rld"]
    assert value(spark, T.tokenize("t"), t=None) == []


def test_token_estimate(spark):
    cases = {"": 0, None: 0, " ": 1, "abcd": 1, "abcde": 2, "退款政策": 3, "退款 abc": 3,
             "　 ": 1, "😀😀😀": 2}
    for text, tokens in cases.items():
        assert value(spark, T.token_estimate("t"), t=text) == tokens, text


def test_sentences_keep_their_marks(spark):
    text = "第一句。第二句！ok?no.\n\n last one "
    assert value(spark, T.sentences("t"), t=text) == [
        "第一句。", "第二句！", "ok?", "no.", "last one"]


def test_order_id(spark):
    cases = {"where is ORD9 now": "ORD9", "see a_b1 please": "a_b1", "call 12345 now": "12345",
             "no id here": None, "退款 ORD202605220001 谢谢": "ORD202605220001", None: None}
    for text, found in cases.items():
        assert value(spark, T.order_id("t"), t=text) == found, text


def test_keyword_terms(spark):
    assert value(spark, T.keyword_terms("t"), t="Über uns: a 年假 x1") == ["über", "uns", "年", "假", "x1"]


def test_clean_json_and_intent(spark):
    assert value(spark, T.clean_json("t"), t=' ```json\n{"a":1}\n``` ') == '{"a":1}'
    checked = U.validate_intent("t")
    assert value(spark, checked, t='{"intent":"chat","confidence":0.4}')["error_code"] is None
    codes = {'{"intent":"x","confidence":0.4}': "INTENT_UNKNOWN", "oops": "INVALID_JSON",
             '{"intent":"chat"}': "CONFIDENCE_MISSING", '{"confidence":1}': "INTENT_BLANK",
             '{"intent":"chat","confidence":2}': "CONFIDENCE_RANGE"}
    for raw, code in codes.items():
        assert value(spark, checked, t=raw)["error_code"] == code


def test_tool_args(spark):
    code = U.validate_tool_args("tool", "args")
    cases = [("query_order", '{"orderId":"A-1"}', None),
             ("query_order", '{"orderId":""}', "VALIDATION_ERROR"),
             ("query_order", '{"orderId":"a","topK":1}', "PERMISSION_DENIED"),
             ("query_order", "[1]", "VALIDATION_ERROR"),
             ("query_order", '{"orderId":"a","x":1}', "VALIDATION_ERROR"),
             ("search_knowledge_base", '{"query":"q","topK":3}', None),
             ("search_knowledge_base", '{"query":"q","topK":11}', "VALIDATION_ERROR"),
             ("search_knowledge_base", '{"query":"q","scoreThreshold":1}', "PERMISSION_DENIED")]
    for tool, args, expected in cases:
        assert value(spark, code, tool=tool, args=args) == expected, args


def test_vectors(spark):
    assert value(spark, V.parse_vector("t"), t="[1,2.5]") == [1.0, 2.5]
    assert value(spark, V.parse_vector("t"), t=" ") == []
    pair = F.array(F.lit(3.0), F.lit(4.0))
    assert math.isclose(value(spark, V.cosine(pair, F.array(F.lit(4.0), F.lit(3.0)))), 0.96)
    assert value(spark, V.cosine(pair, F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert value(spark, V.cosine_or_zero(pair, F.array(F.lit(1.0)))) == 0.0


def test_reply_and_leak(spark):
    assert value(spark, U.reply_intent("t"), t="不要，确认") == "CANCEL"
    assert value(spark, U.reply_intent("t"), t="YES please") == "CONFIRM"
    assert value(spark, U.prompt_leak("t"), t="my system prompt is").startswith("抱歉")


def test_sentences_are_those_of_the_pattern(spark):
    import random
    import re

    draw = random.Random(5)
    texts = [None, "", "\n", "!", " ! ", "a", "a\n", "。。a", "\x00 x\r\n\ty? \x1f", "x\u2028 y \u0085", "\U0001F600!\U0001F600"]
    texts += ["".join(draw.choice("ab é。！？!?\n\t\r \u3000\u2028.\U0001F600") for _ in range(draw.randrange(60))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.sentences("t").alias("s")).collect()
    blanks = "".join(map(chr, range(0x21)))
    for r in rows:
        found = re.findall("[^。！？!?\n]*[。！？!?]|[^。！？!?\n]+", texts[r.i] or "")
        assert r.s == [x.strip(blanks) for x in found if x.strip(blanks)]


def test_a_text_is_split_once_and_without_a_pattern(spark, capsys):
    from quarry.operators.chunking import split_sentences

    docs = spark.createDataFrame([(1, "a! b")], "document_id int, content string")
    split_sentences(docs).explain(True)
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    assert plan.count("split(") == 1 and "regexp" not in plan
