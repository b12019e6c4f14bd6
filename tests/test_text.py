import json

import pytest

from fleetwatch.functions.requests import request_body, response_text
from fleetwatch.functions.text import all_tags, fill, first_tag, is_flagged, strip, two_decimals
from pyspark.sql import functions as F

ANSWERS = [
    ("<result>\n 无异常 \n</result>", "无异常", [], False),
    ("<result><pod1> a </pod1><pod2>\nb\n</pod2></result>", "<pod1> a </pod1><pod2>\nb\n</pod2>", ["a", "b"], True),
    ("没有", "", [], True),
    ("<pod1>a</pod1>", "", ["a"], True),
    ("<result>无异常</result><pod1>a</pod1>", "无异常", ["a"], False),
    ("<pod1>a</pod2>", "", ["a"], True),
    ("<pod1>a", "", [], True),
    (None, "", [], True),
    ("<result>x</result><result>无异常</result>", "x", [], True),
    ("<pod1></pod1>", "", [""], True),
    ("<POD1>a</POD1><pod>b</pod><pod12>c</pod12>", "", ["c"], True),
]


@pytest.mark.parametrize("answer,result,pods,flagged", ANSWERS)
def test_answers(spark, answer, result, pods, flagged):
    df = spark.createDataFrame([(answer,)], "a string")
    assert tuple(df.select(first_tag("a"), all_tags("a"), is_flagged("a")).first()) == (result, pods, flagged)


def test_strip_is_what_python_strips(spark):
    texts = ["", " ", "a", "　a b \n", "\x1ca\x1f", "\t\n a b \r\n", "​a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [t.strip() for t in texts]


def test_fill_fills_once(spark):
    df = spark.createDataFrame([("{data} 100%", "{stats}")], "s string, d string")
    filled = df.select(fill("<{stats}|{data}> {other} 5%", {"stats": F.col("s"), "data": F.col("d")})).first()[0]
    assert filled == "<{data} 100%|{stats}> {other} 5%"


@pytest.mark.parametrize("value,text", [
    (74.8, "74.80"), (13.616534, "13.62"), (2.675, "2.68"), (0.125, "0.13"), (0.0, "0.00"), (-1.005, "-1.01"),
    (None, "nan"), (123456789.0, "123456789.00"), (0.1 + 0.2, "0.30"),
])
def test_two_decimals(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(two_decimals("v")).first()[0] == text


@pytest.mark.parametrize("value,text", [(float("inf"), "inf"), (float("-inf"), "-inf"), (float("nan"), "nan"), (None, "nan"), (1e33, "1" + "0" * 33 + ".00")])
def test_two_decimals_of_extremes(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").select(two_decimals("v")).first()[0] == text


def test_text_request(spark):
    prompt = 'Zeile "1"\n{x} \\ 无'
    df = spark.createDataFrame([(prompt,)], "p string")
    body = json.loads(df.select(request_body(F.col("p"), version_field="v", version="2", max_tokens=9)).first()[0])
    assert body == {"v": "2", "max_tokens": 9, "messages": [{"role": "user", "content": [{"type": "text", "text": prompt}]}]}


def test_image_request(spark):
    df = spark.createDataFrame([("p", "QUJD")], "p string, i string")
    content = json.loads(df.select(request_body(F.col("p"), F.col("i"))).first()[0])["messages"][0]["content"]
    assert content == [
        {"type": "text", "text": "p"},
        {"type": "image", "source": {"type": "base64", "media_type": "image/jpeg", "data": "QUJD"}},
    ]


def test_response_text(spark):
    bodies = [json.dumps({"content": [{"text": "a\n无"}, {"text": "b"}]}), '{"content": []}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    assert [r[0] for r in df.select(response_text("b")).collect()] == ["a\n无", None]
