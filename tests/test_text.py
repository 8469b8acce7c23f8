import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T


def values(spark, expr, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expr(F.col("t")).alias("v")).orderBy("i").collect()]


def test_bm25_tokens_bridge_and_mix(spark):
    got = values(spark, T.bm25_tokens, ["不能用tag 好", "Foo_bar v1.2", "", None])
    assert got[0] == ["不", "能", "用", "tag", "好", "不能", "能用", "用好", "用tag", "tag好"]
    assert got[1] == ["foo_bar", "v1.2"]
    assert got[2] == [] and not got[3]


def test_query_terms(spark):
    got = values(spark, T.query_terms, ["成本中心 API_key"])[0]
    assert set(got) == {"成本中心", "成", "本", "中", "心", "成本", "本中", "中心", "api_key"}


def test_exact_terms_keep_order_and_drop_plain_words(spark):
    got = values(spark, T.exact_terms, ["plain words only", "use lark_md in v.two at 74.5% 3000 px 凭证生成", "lark_md LARK_MD"])
    assert got[0] == []
    assert got[1] == ["lark_md", "v.two", "74.5%", "3000", "凭证生成"]
    assert got[2] == ["lark_md"]


def test_keyword_query(spark):
    got = values(spark, T.keyword_query, ["What is the cost of retry_flag", "如何配置成本中心的", "the of"])
    assert got == ["cost retry_flag", "配置成本中心", ""]


def test_clean_markdown(spark):
    text = "# Title\n\n**bold** and `code` [a](u) ![i](u)\n\n> quote\n| a | b |\n|---|---|\n<b>x</b>   y\n---\n"
    got = values(spark, T.clean_markdown, [text, "", None])
    assert "Title" in got[0] and "**" not in got[0] and "`" not in got[0] and "<b>" not in got[0]
    assert "bold and code a !i" in got[0] and "quote" in got[0] and "---" not in got[0]
    assert got[1] == "" and got[2] is None


def test_identifiers(spark):
    assert values(spark, T.identifiers, ["`Foo` and retry_flag, tblAb1 and RETRY_FLAG"])[0] == ["Foo", "retry_flag", "tblAb1"]


def test_title(spark):
    assert values(spark, T.title_of, ["\n# ab\n## The title\nrest", "", "x" * 100]) == ["The title", "Untitled", "x" * 80]


def test_snippets(spark):
    df = spark.createDataFrame([("a" * 100 + " needle " + "b" * 300,)], "t string")
    s = df.select(T.bm25_snippet(F.col("t"), F.array(F.lit("needle"))).alias("s"), T.exact_snippet(F.col("t"), F.lit("NEEDLE")).alias("e")).first()
    assert s.s.startswith("…") and s.s.endswith("…") and "needle" in s.s and len(s.s) == 202
    assert "needle" in s.e and len(s.e) == 2 + 80 + 6 + 120


def test_incidental_facts(spark):
    got = values(spark, T.incidental_facts, ["By the way, my sister moved to Lisbon. I just adopted a small grey cat.", "nothing", None])
    assert got[0] == ["By the way, my sister moved to Lisbon", "I just adopted a small grey cat"]
    assert got[1] == [] and not got[2]


@pytest.mark.parametrize("text, want", [("we enable and increase it", "positive"), ("rejected and disable", "negative"), ("plain", "neutral"), ("不支持", "neutral"), ("升级", "positive")])
def test_polarity(spark, text, want):
    assert values(spark, T.polarity, [text])[0] == want


def test_foresight_days(spark):
    got = values(spark, T.foresight_days, ["we will do it next week", "plan to do it next month", "todo", "done"])
    assert got == [7, 30, 14, None]


def test_jaccard_and_confidence(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"], [1.0, 1.0]), ([], ["a"], [])], "x array<string>, y array<string>, w array<double>")
    r = df.select(T.jaccard(F.col("x"), F.col("y")).alias("j"), T.confidence(F.col("w")).alias("c")).collect()
    assert round(r[0].j, 6) == round(1 / 3, 6) and r[1].j == 0.0
    assert round(r[0].c, 3) == 0.667 and r[1].c == 0.0


def test_tokens_match_a_sequential_version(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab_. 中文字x-1") for _ in range(rng.randint(0, 40))) for _ in range(200)]

    def brute(text):
        raw = re.findall(r"[一-鿿]|[a-zA-Z0-9_.-]+", text.lower())
        cjk = [c for c in raw if "一" <= c <= "鿿"]
        is_cjk = [len(c) == 1 and "一" <= c <= "鿿" for c in raw]
        return raw + [a + b for a, b in zip(cjk, cjk[1:])] + [raw[i] + raw[i + 1] for i in range(len(raw) - 1) if is_cjk[i] != is_cjk[i + 1]]

    assert values(spark, T.bm25_tokens, texts) == [brute(t) for t in texts]


def test_name_stop_words_are_built_and_extended():
    words = L.name_stop_cn(("凭证",))
    assert {"我们", "这个", "最多", "上面", "凭证"} <= words and "成本" not in words
