"""YAML reports against their JSON twins."""

import json

import pytest

from redraft.sources import blocks, readers

YAML = """---
# a report
- name: set one
  description: "not read: here"
  violations:
    rule-1:
      description: d
      labels:
        - family=Card
        - 'it''s'
      incidents:
        - uri: file:///a/b.tsx
          message: |-
            First line: with a colon

              indented
            - no item
          codeSnip: " 1  \\"x\\"\\n 2  y"
          lineNumber: 12
          variables:
            propName: isOpen
            count: 3
            text: "3"
            none: null
            propObjectValues:
              - a
              - 5
        -   uri: file:///c
            message: plain text that
              goes on here
            line_number: 7
            variables: {}
    'rule: two':
      labels: []
      incidents:
      - fileUri: file:///d
        message: |
          kept
        lineNumber: 1
  errors:
    r: broken
- name: 'set two'
  violations:
    rule-1:
      incidents:
        - uri: "file:///e"
          message: >-
            folded
            text
          lineNumber: 3
- name: empty
"""
TWIN = [
    {"name": "set one", "violations": {
        "rule-1": {"labels": ["family=Card", "it's"], "incidents": [
            {"uri": "file:///a/b.tsx", "message": "First line: with a colon\n\n  indented\n- no item", "codeSnip": ' 1  "x"\n 2  y', "lineNumber": 12, "variables": {"propName": "isOpen", "count": 3, "text": "3", "none": None, "propObjectValues": ["a", 5]}},
            {"uri": "file:///c", "message": "plain text that goes on here", "line_number": 7, "variables": {}}]},
        "rule: two": {"labels": [], "incidents": [{"fileUri": "file:///d", "message": "kept\n", "lineNumber": 1}]}}, "errors": {"r": "broken"}},
    {"name": "set two", "violations": {"rule-1": {"incidents": [{"uri": "file:///e", "message": "folded text", "lineNumber": 3}]}}},
    {"name": "empty"},
]


def told(df):
    columns = [f"{c}" for c in df.columns if c != "variables"]
    rows = df.selectExpr(*columns, "transform(array_sort(map_keys(variables)), k -> concat(k, '=', coalesce(to_json(variables[k]), 'null'))) AS variables").collect()
    return sorted(repr(tuple(r[c] for c in [*sorted(columns), "variables"])) for r in rows)


def test_yaml_gives_the_rows_of_its_json_twin(spark):
    two = [("a.yaml", YAML), ("b.yaml", YAML.replace("\n", "\r\n")), ("none.yaml", ""), ("null.yaml", None)]
    twin = [("a.yaml", json.dumps(TWIN)), ("b.yaml", json.dumps(TWIN))]
    got = blocks.findings(spark.createDataFrame(two, "file string, text string"))
    want = readers.findings(spark.createDataFrame(twin, "file string, text string"))
    assert set(got.columns) == set(want.columns) and told(got) == told(want) and want.count() == 8


@pytest.mark.parametrize("step", [1, 2, 4])
def test_any_indent(spark, step):
    text = "- name: s\n" + "  violations:\n" + "  " + " " * step + "r:\n" + "  " + " " * 2 * step + "incidents:\n" + "  " + " " * 3 * step + "- uri: u\n" + "  " + " " * 3 * step + "  lineNumber: 4\n"
    got = blocks.findings(spark.createDataFrame([("f", text)], "file string, text string")).collect()
    assert [(r["ruleset"], r["rule_id"], r["file_uri"], r["line"], r["incident_ix"], r["variables"]) for r in got] == [("s", "r", "u", 4, 0, None)]
