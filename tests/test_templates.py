"""G14 template details, U2 Arrow tokenizer, G5 case jitter."""

from pyspark.sql import functions as F

from tokenlake.operators import chat, invoices as inv

MSG = "conv_id long, turn long, role string, content string, tool_calls array<struct<name:string,arguments:string>>"


def test_template_tools_and_tool_calls(spark):
    d = spark.createDataFrame([
        (1, 0, "system", "Be brief.", None),
        (1, 1, "user", "Weather in Oslo?", None),
        (1, 2, "assistant", "", [("get_weather", '{"city": "Oslo"}')]),
        (1, 3, "tool", '{"temp": 3}', None),
    ], MSG)
    tool = '{"name": "get_weather", "parameters": {}}'
    r = chat.render_template(d, tools=[tool]).first().rendered
    assert r.startswith("<|im_start|>system\nBe brief.\n\n# Tools\n")
    assert '\n<tools>\n{"type": "function", "function": ' + tool + "}\n</tools>" in r
    assert ('<|im_start|>assistant\n<tool_call>\n{"name": "get_weather", "arguments": {"city": "Oslo"}}\n'
            '</tool_call><|im_end|>\n') in r
    # final tool turn: rendered as a user tool_response, then the generation prompt
    assert r.endswith("<|im_start|>user\n<tool_response>\n{\"temp\": 3}\n</tool_response><|im_end|>\n"
                      "<|im_start|>assistant\n")


def test_template_final_assistant_has_no_end_tag(spark):
    d = spark.createDataFrame([(7, 0, "user", "Hi", None), (7, 1, "assistant", "Hello", None)], MSG)
    r = chat.render_template(d).first().rendered
    assert r == (f"<|im_start|>system\n{chat.DEFAULT_SYSTEM}<|im_end|>\n"
                 "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHello")


def test_prompt_response_form(spark):
    df = spark.createDataFrame([("S", "P", "R"), (None, "P", None)], "s string, p string, r string")
    out = [x.t for x in df.select(chat.render_prompt_response(F.col("s"), F.col("p"), F.col("r")).alias("t")).collect()]
    assert out[0] == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\nR<|im_end|>"
    assert out[1] == "<|im_start|>user\nP<|im_end|>\n<|im_start|>assistant\n"


def test_arrow_tokenizer_udf_matches_native(spark, sf):
    d = chat.dialogs(spark, sf)
    udf = chat.token_count_udf(lambda t: t.split())
    got = d.select(udf("content").alias("a"), chat.n_tokens(F.col("content")).alias("b"))
    assert got.filter(F.col("a") != F.col("b")).count() == 0
    ids = chat.token_ids_udf(lambda t: [len(w) for w in t.split()])
    assert d.select(F.size(ids("content")).alias("n")).agg(F.sum("n")).first()[0] == \
        d.select(chat.n_tokens(F.col("content")).alias("n")).agg(F.sum("n")).first()[0]


def test_case_jitter_invariants(spark, sf):
    for r in inv.label_case_jitter(spark, sf).collect():
        assert r.jittered.lower() == r.label.lower()
        assert 1 <= sum(a != b for a, b in zip(r.label, r.jittered)) <= sum(c.isalpha() for c in r.label)
