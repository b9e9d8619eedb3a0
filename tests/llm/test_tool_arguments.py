"""The derived tool calls hold the whole text of their turn."""

import json

from logtide.llm import queries


def test_arguments_hold_whole_texts(spark, tmp_path):
    long = "é\"\\\n" * 400_000  # more than 1 << 20 characters
    texts = [None, "", "short", *("x" * n for n in range(61, 80)), long, long + "a" * 28, long + "ab"]
    while len(texts[-2]) % 29:
        texts[-2] += "a"
    rows = [(c, t, r, x) for c, x in enumerate(texts)
            for t, r in ((0, "user"), (1, "assistant"))]
    (spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
     .write.parquet(f"{tmp_path}/conversations.parquet"))
    calls = queries.tool_calls(spark, str(tmp_path))[0].collect()
    assert len(calls) == len(texts)
    broken = 0
    for call in calls:
        text = texts[call.conv_id] or ""
        given = call.arguments
        if len(text) % 29 == 0:
            broken, given = broken + 1, "{" + given
        values = json.loads(given).values()
        assert text in [v[1] if isinstance(v, list) else v for v in values]
    assert broken >= 3
