"""The sample shapes prove the extraction rules: without a rule, some shape loses or gains a field."""

from __future__ import annotations

import json
import re
import sys
import types
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from catalogue.events_sql import FIELDS, expected  # noqa: E402
from seekledger.functions import bodies, grammar  # noqa: E402
from seekledger.samples.request_log import RARE_SHAPES, SLOTS, shape_of_each_slot  # noqa: E402

SOURCE = Path(grammar.__file__).read_text()
SEARCHES = [s for s in shape_of_each_slot() if s.path.endswith(("_search", "_count")) and s.body and s.event_type != "error"]


def filled(body: str) -> str:
    for marker, value in {"k": "7", "hours": "1", "days": "7", "day": "2024.01.01", "q": "'", "nl": "\n", "long": "x"}.items():
        body = body.replace(f"<<{marker}>>", value)
    return body


NODES = {(s.event_type, s.slot): bodies.observe(filled(s.body), "search")[0] for s in SEARCHES}


def extracted(module) -> dict:
    """Field sets of every search shape, by the module's patterns under Python's regular expressions."""
    found = {}
    for key, nodes in NODES.items():
        for category in FIELDS[:-1]:
            names = re.findall(module._SEARCH + module._FIELD_PATHS[category] + module._FIELD, nodes)
            if category in ("queried", "filtered"):
                tree = module._QUERIED_TREE if category == "queried" else module._FILTERED_TREE
                names += re.findall(module._SEARCH + tree + module._MULTI_MATCH + module._BOOSTED_FIELD, nodes)
            if category in module._SCRIPT_PATHS:
                sources = re.findall(module._SEARCH + module._SCRIPT_PATHS[category] + module._RS + r"([^\x1d]*)", nodes)
                for pattern in module.SCRIPT_REFERENCES:
                    names += [n for s in sources for n in re.findall(pattern.replace("(?U)", ""), s) if not n.startswith("_")]
            found[key, category] = " ".join(sorted(set(names)))
    return found


def variant(old: str, new: str):
    assert old in SOURCE
    module = types.ModuleType("grammar_without_a_rule")
    exec(compile(SOURCE.replace(old, new), "grammar", "exec"), module.__dict__)
    return module


def test_every_shape_gives_what_is_written_down():
    found = extracted(grammar)
    for s in SEARCHES:
        want = dict(zip(FIELDS, expected(s)[3:9]))
        for category in FIELDS[:-1]:
            assert found[(s.event_type, s.slot), category] == want[category], (s, category)


def test_slots_are_complete():
    slots = {(s.event_type, s.slot) for s in shape_of_each_slot()}
    assert len(slots) == 5 * SLOTS == len(shape_of_each_slot()) and all((s.event_type, s.slot) in slots for s in RARE_SHAPES)
    for s in RARE_SHAPES:
        if "<<deep>>" not in s.body:
            json.loads(filled(s.body))


NAMES = [("leaf", n) for n in grammar.LEAF_QUERIES] + [("metric", n) for n in grammar.METRIC_AGGREGATIONS]
NAMES += [("bucket", n) for n in grammar.BUCKET_AGGREGATIONS if n not in ("filters", "composite")]
NAMES += [("script", n) for n in grammar.SCRIPTED_METRIC_PARTS]


@pytest.mark.parametrize("kind, name", NAMES)
def test_a_missing_name_shows(kind, name):
    start = {"leaf": "LEAF_QUERIES = (", "metric": "METRIC_AGGREGATIONS = (", "bucket": "BUCKET_AGGREGATIONS = (", "script": "SCRIPTED_METRIC_PARTS = ("}[kind]
    head = SOURCE.index(start)
    end = SOURCE.index(")", head)
    block = SOURCE[head:end]
    assert extracted(variant(block, block.replace(f'"{name}"', f'"no_{name}"', 1))) != extracted(grammar)


RULES = {
    "nested queries": ('_path("nested", "query")', '_path("no_nested", "query")'),
    "function_score query": ('_path("function_score", "query")', '_path("no_function", "query")'),
    "exists": ('_path("exists")', '_path("no_exists")'),
    "multi_match": ('_path("multi_match")', '_path("no_multi_match")'),
    "field_value_factor": ('_path("field_value_factor")', '_path("no_factor")'),
    "gauss": ('"gauss", ', ""),
    "linear": ('"linear", "exp"', '"exp"'),
    "exp": ('"linear", "exp"', '"linear"'),
    "script_score": ('_path("script_score")', '_path("no_script_score")'),
    "highlight": ('_path("highlight", "fields")', '_path("no_highlight", "fields")'),
    "completion suggester": ('"completion", ', ""),
    "term suggester": ('"term", "phrase"', '"phrase"'),
    "phrase suggester": ('"term", "phrase"', '"term"'),
    "collapse": ('_path("collapse")', '_path("no_collapse")'),
    "filter aggregation": ('_path("filter"), _path("filters"', '_path("no_filter"), _path("filters"'),
    "filters aggregation": ('_path("filters", "filters")', '_path("no_filters", "filters")'),
    "post_filter": ('_path("post_filter")', '_path("no_post_filter")'),
    "composite": ('_path("composite", "sources", _AT)', '_path("no_composite", "sources", _AT)'),
    "sub-aggregations": ('_any("aggs", "aggregations")', '_any("aggs", "no_aggregations")'),
    "source lists": ("_any('includes', 'excludes')", "_any('no_includes', 'excludes')"),
    "docvalue_fields": ('_path("docvalue_fields")', '_path("no_docvalue_fields")'),
    "stored_fields": ('_path("stored_fields")', '_path("no_stored_fields")'),
    "scripted_metric": ('_path("scripted_metric")', '_path("no_scripted_metric")'),
    "bucket_script": ('"bucket_script", ', ""),
    "bucket_selector": ('"bucket_script", "bucket_selector"', '"bucket_script"'),
    "sort scripts": ('_path("sort", _AT, "_script")', '_path("sort", _AT, "_no_script")'),
    "script fields": ('"script_fields", ', ""),
    "runtime mappings": ('"script_fields", "runtime_mappings"', '"script_fields"'),
    "double quotes": ('''r'doc\\["''', '''r'no\\["'''),
    "source references": (r"ctx\._source", r"no\._source"),
    "boosts": (r"(?:\^[\d.]+)?", ""),
}


@pytest.mark.parametrize("rule", RULES)
def test_a_missing_rule_shows(rule):
    assert extracted(variant(*RULES[rule])) != extracted(grammar)
