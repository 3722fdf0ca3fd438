"""Asked identifiers by the scanner's rule."""

from changelens.operators import service

RECORD = "id string, vendor string, kind string, signatures array<string>, exclude array<string>, summary string"
RECORDS = [
    ("gpt", "OpenAI", "model", ["gpt-4", "gpt-4-turbo"], ["gpt-4-vision"], "The -mini variant goes too."),
    ("claude", "Anthropic", "model", ["claude-3-opus"], None, None),
    ("sdk", "V", "sdk", ["Client.old", "mcp"], ["Client.old(new=True)"], None),
    ("none", "V", "rest", None, None, None),
]


def test_what_an_asked_text_names(spark):
    asked = {
        "gpt-4": {"gpt"}, "GPT-4": {"gpt"}, "openai/gpt-4": {"gpt"}, "gpt-4-0613": {"gpt"}, "gpt-4-mini": {"gpt"}, "gpt-4-turbo": {"gpt"}, "gpt-4-vision": set(), "gpt-4-other": set(), "gpt-4.1": set(), "xgpt-4": set(), "gpt-40": set(),
        "gpt-4-vision or gpt-4": {"gpt"}, "claude-3-opus": {"claude"}, "claude-3-opus-20240229": {"claude"}, "claude-3-opus-20240229-v1:0": set(), "claude-3-opus@20240229": set(), "claude-3-opus-v1:0 claude-3-opus": {"claude"},
        "Client.old": {"sdk"}, "client.old": set(), "Client.old(new = True)": set(), "Client.old(new=False)": {"sdk"}, "mcp": {"sdk"}, "": set(), "x" * 100_000 + " gpt-4": {"gpt"},
    }
    records = spark.createDataFrame(RECORDS, RECORD)
    rows = service.naming(records, spark.createDataFrame([(a,) for a in [*asked, None, "gpt-4"]], "asked string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.asked, []).append(r.id)
    assert all(len(x) == len(set(x)) for x in got.values())
    assert {a: set(got.get(a, ())) for a in asked} == asked and None not in got


def test_records_without_optional_columns_and_empty_tables(spark):
    records = spark.createDataFrame(RECORDS, RECORD).select("id", "kind", "signatures")
    asked = spark.createDataFrame([("gpt-4-turbo",), ("nothing",)], "asked string")
    assert [(r.asked, r.id) for r in service.naming(records, asked).collect()] == [("gpt-4-turbo", "gpt")]
    assert service.naming(records.limit(0), asked).count() == 0 and service.naming(records, asked.limit(0)).count() == 0
