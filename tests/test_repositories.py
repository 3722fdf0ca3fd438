import json

import pytest

from changelens.operators import extract, tokens
from changelens.sources import code, deps


@pytest.mark.parametrize("text, want", [
    (json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", "b"]}, 7, {"cell_type": "raw", "source": "x"}, {"source": "", "cell_type": "code"}, {"cell_type": "code", "source": ["%m\n", "c d", ""]}]}, indent=1),
     [(1, "a", "cell 1, line 1", 6), (2, "b", "cell 1, line 2", 7), (3, "", "cell 3, line 1", 16), (4, "", "cell 4, line 1", 22), (5, "c", "cell 4, line 2", 23), (6, "d", "cell 4, line 3", 23), (7, "", "cell 4, line 4", 24)]),
    ('{"metadata": {"cells": [{"cell_type": "code", "source": "no"}]}, "cells": [{"cell_type": "code", "metadata": {"source": "no"}, "source": "y\\\\\\"{["}]}', [(1, 'y\\"{[', "cell 1, line 1", 1)]),
    ("{}", []), ("", []), ("[1]", []), ('{"cells": {"a": 1}}', []), ('{"cells": null}', []), ("{", []), ('{"cells": []}', []), ('{"cells": [{}, {"cell_type": "code"}, {"cell_type": "code", "source": null}]}', []),
])
def test_places_of_notebook_lines(text, want):
    assert [(r["line_no"], r["line"], r["cell"], r["raw_line"]) for r in code._cells(text)] == want


def test_sites_of_notebooks_in_code(spark):
    files = spark.createDataFrame([("a.ipynb", ".ipynb", '{"cells": [\n{"cell_type": "code", "source": "x\\ny"},\n{"cell_type": "code", "source": ["z"]}]}'), ("b.py", ".py", "p\nq"), ("c.ipynb", ".ipynb", None)], "path string, suffix string, text string")
    lines = code.code_lines(files)
    sites = spark.createDataFrame([("a.ipynb", 2), ("a.ipynb", 3), ("b.py", 2), ("b.py", 9)], "file string, line int")
    assert sorted(tuple(r) for r in code.at_code_lines(sites, lines).collect() if r.line_no) == [("a.ipynb", 2, 1), ("a.ipynb", 3, 3), ("b.py", 2, 2)]


def test_contexts_of_repositories(spark):
    trees = [
        ("r", "web/package.json", '{"dependencies": {"stripe16": "npm:stripe@^16.0.0", "lib": "^1.2"}}'), ("r", "api/requirements.txt", "Lib_B==3.1\n"), ("r", "api/main.py", "x"), ("r", "pom.xml", "<artifactId>own-thing"), ("r", "dist/package.json", '{"dependencies": {"no": "1.0"}}'),
        ("s", "web/package.json", '{"dependencies": {"lib": "^1.2"}}'), ("s", "web/yarn.lock", 'lib@^1.2:\n  version "1.9.3"\n'), ("s", "api/package.json", "not json"), ("s", "a.py", None), (None, "a.py", "Lonely"),
    ]
    files = spark.createDataFrame(trees, "repo string, path string, text string")
    wanted = ["dep:npm:stripe@16.", "dep:npm:stripe16@", "dep:lib@1.2", "dep:lib@1.9", "dep:pypi:lib-b@3.1", "OWN-thing", "dep:no@", "lonely"]
    found = {r.repo: sorted(r.words) for r in tokens.repo_words(code.context_texts(files), wanted).collect()}
    assert found == {"r": ["OWN-thing", "dep:lib@1.2", "dep:npm:stripe@16.", "dep:pypi:lib-b@3.1"], "s": ["dep:lib@1.9"], None: ["lonely"]}


def test_gates(spark):
    records = spark.createDataFrame([("a", [["x", "y", "x"], ["z"]]), ("b", None), ("c", []), ("d", [["no"]]), ("e", [[]])], "id string, repo_context array<array<string>>")
    repos = spark.createDataFrame([("p", ["x", "y"]), ("q", ["x"]), ("r", ["z", "z"]), ("s", [])], "repo string, words array<string>")
    pairs = {tuple(r) for r in tokens.repo_context(records, repos).collect()}
    assert pairs == {("a", "p"), ("a", "r"), *((i, r) for i in "bce" for r in "pqrs")}
    hits = spark.createDataFrame([(i, r, n) for i in "abcde" for r in "pqrs" for n in (1, 1)], "record_id string, repo string, n int")
    kept = [tuple(r) for r in tokens.gated(hits, records, repos).select("record_id", "repo").collect()]
    assert set(kept) == pairs and len(kept) == 2 * len(pairs)


def test_aliases_of_packages():
    wanted = {"a": "npm:stripe@16.0.0", "b": "npm:@scope/x@^2.1", "c": "npm:@scope/y", "d": "npm:plain", "e": "~3.4"}
    assert deps.pins("package.json", json.dumps({"dependencies": wanted})) == [("@scope/x", "2.1"), ("@scope/y", ""), ("e", "3.4"), ("plain", ""), ("stripe", "16.0.0")]
    lock = {"packages": {"": {}, "node_modules/a": {"name": "stripe", "version": "16.0.0"}, "node_modules/e": {"version": "3.4.1"}}}
    assert deps.pins("package-lock.json", json.dumps(lock)) == [("e", "3.4.1"), ("stripe", "16.0.0")]


def test_related_by_the_token_rule(spark):
    entries = spark.createDataFrame([("k1", "Acme", "t", "uses gpt-4-turbo", "https://x/1#a"), ("k2", "Acme AI", "gpt-4-t here", "and old", "https://x/2"), ("k3", "Other", "gpt-4-t", "", "https://x/1"), ("k4", "Acme", None, None, None), ("k5", "Acme", "gpt-4-t", "gpt-4-t-mini old", "")], "key string, vendor string, title string, text string, url string")
    records = spark.createDataFrame([("r1", "Acme", ["gpt-4-t"], None, None), ("r2", "Acme", ["gpt-4-t"], [["OLD"]], ["gpt-4-t-mini"]), ("r3", "Acme", ["tiny"], None, None), ("r4", "Acme", None, None, None)], "id string, vendor string, signatures array<string>, context array<array<string>>, exclude array<string>")
    urls = spark.createDataFrame([("r4", "https://x/1")], "id string, url string")
    assert {tuple(r) for r in extract.related(entries, records, urls).collect()} == {("k1", "r4"), ("k2", "r1"), ("k2", "r2"), ("k5", "r1")}
    assert {tuple(r) for r in extract.related(entries, records.drop("context", "exclude"), urls).collect()} == {("k1", "r4"), ("k2", "r1"), ("k2", "r2"), ("k5", "r1"), ("k5", "r2")}
