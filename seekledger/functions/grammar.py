"""Which field references a request body holds: regular expressions over its node text.

The rules recognise paths of fixed shape, so each category of reference is one alternation of path
prefixes followed by a field name. Every expression here is a built-in function on one row: no
shuffle, no explode, and a rollup that needs two categories evaluates two expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekledger.functions.bodies import ESC, ESCAPES
from seekledger.schemas import FIELD_CATEGORIES

# --- Fixed values of the query language -----------------------------------------------------

LEAF_QUERIES = (
    "match",
    "match_phrase",
    "match_phrase_prefix",
    "term",
    "terms",
    "range",
    "wildcard",
    "prefix",
    "fuzzy",
    "regexp",
)
METRIC_AGGREGATIONS = (
    "avg",
    "sum",
    "min",
    "max",
    "cardinality",
    "value_count",
    "stats",
    "extended_stats",
    "percentiles",
    "percentile_ranks",
    "median_absolute_deviation",
    "top_hits",
)
BUCKET_AGGREGATIONS = (
    "terms",
    "date_histogram",
    "histogram",
    "range",
    "date_range",
    "filter",
    "filters",
    "significant_terms",
    "composite",
    "auto_date_histogram",
)
SCRIPTED_METRIC_PARTS = ("init_script", "map_script", "combine_script", "reduce_script")
SECONDS_PER_UNIT = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
# Field references inside a script: doc['f'], doc["f"], ctx._source.f
SCRIPT_REFERENCES = (
    r"doc\['\s*([^']+?)\s*'\]",
    r'doc\["\s*([^"]+?)\s*"\]',
    r"(?U)ctx\._source\.(\w+)",
)

# --- Path vocabulary ------------------------------------------------------------------------

_US, _RS = r"\x1f", r"\x1e"
_NAME = r"[^\x1c-\x1f]*"
_KEY = _NAME + _US
_AT = r"\x1c\d+"
_FIELD = r"((?!_)[^\x1c-\x1f]*)(?=[\x1d-\x1f])"
_NONEMPTY = r"(?!\x1d)"
_SEARCH, _WRITE = r"\x1d\d+s\x1f", r"\x1d\d+w\x1f"


def _any(*alternatives: str) -> str:
    return "(?:" + "|".join(alternatives) + ")"


def _path(*tokens: str) -> str:
    """Tokens joined by the separator; the last token is followed by one too."""
    return "".join(token + _US for token in tokens)


def _descend(*clauses: str) -> str:
    """Any depth of compound queries using the given bool clauses."""
    into_bool = _path("bool", _any(*clauses)) + f"(?:{_AT}{_US})?"
    return _any(into_bool, _path("nested", "query"), _path("function_score", "query")) + "*+"


_SCORING = ("must", "should", "must_not")
_KEEP_CONTEXT = _descend(*_SCORING)
_ANY_CONTEXT = _descend(*_SCORING, "filter")
_INTO_FILTER = _path("bool", "filter") + f"(?:{_AT}{_US})?"

_AGG = _any(_any("aggs", "aggregations") + _US + _KEY) + "++"
_AGG_FILTER = _AGG + _any(_path("filter"), _path("filters", "filters") + _KEY)

# Where a query tree starts and everything below it counts as queried or as filtered.
_QUERIED_TREE = _path("query") + _KEEP_CONTEXT
_FILTERED_TREE = _any(
    _path("query") + _KEEP_CONTEXT + _INTO_FILTER,
    _path("post_filter"),
    _AGG_FILTER,
) + _ANY_CONTEXT

_FUNCTION = _path("function_score", "functions", _AT)
_QUERY_FIELD = _any(
    _path(_any(*LEAF_QUERIES)),
    _path("exists") + "field" + _RS + _NONEMPTY,
    _FUNCTION + _path("field_value_factor") + "field" + _RS + _NONEMPTY,
    _FUNCTION + _path(_any("gauss", "linear", "exp")),
)
_MULTI_MATCH = _path("multi_match") + "fields" + f"(?:{_US}{_AT})?" + _RS
_BOOSTED_FIELD = r"((?!_)[^\x1c-\x1f]*?)(?:\^[\d.]+)?(?=[\x1d-\x1f])"
_SCORE_SCRIPT = _FUNCTION + _path("script_score") + "script"

_FIELD_PATHS = {
    "queried": _any(
        _QUERIED_TREE + _QUERY_FIELD,
        _path("highlight", "fields"),
        _path("suggest") + _KEY + _path(_any("completion", "term", "phrase")) + "field" + _RS + _NONEMPTY,
    ),
    "filtered": _any(
        _FILTERED_TREE + _QUERY_FIELD,
        _path("collapse") + "field" + _RS + _NONEMPTY,
    ),
    "aggregated": _AGG
    + _any(
        _path(_any(*METRIC_AGGREGATIONS, *BUCKET_AGGREGATIONS)),
        _path("composite", "sources", _AT) + _KEY + _KEY,
    )
    + "field"
    + _RS
    + _NONEMPTY,
    "sorted": "sort" + _any(_US, _US + _AT + _RS, _US + _AT + _US),
    "sourced": _any(
        _path("_source") + f"(?:{_any('includes', 'excludes')}{_US})?" + _AT + _RS,
        _path("docvalue_fields") + _AT + _any(_RS, _US + "field" + _RS + _NONEMPTY),
        _path("stored_fields") + _AT + _RS,
    ),
}

# A body without any of these strings has no field of the category: a byte search that spares most
# rows the regular expression.
_NEEDED = {
    "queried": ("\x1fquery\x1f", "\x1fhighlight\x1f", "\x1fsuggest\x1f"),
    "filtered": ("filter", "\x1fcollapse\x1f"),
    "aggregated": ("\x1faggs\x1f", "\x1faggregations\x1f"),
    "sorted": ("\x1fsort\x1f",),
    "sourced": ("\x1f_source\x1f", "_fields\x1f"),
    "written": ("w\x1f",),
}

_SCRIPT_PATHS = {
    "queried": _QUERIED_TREE + _SCORE_SCRIPT,
    "filtered": _FILTERED_TREE + _SCORE_SCRIPT,
    "aggregated": _AGG
    + _any(
        _path("scripted_metric") + _any(*SCRIPTED_METRIC_PARTS),
        _path(_any("bucket_script", "bucket_selector")) + "script",
    ),
    "sorted": _path("sort", _AT, "_script") + "script",
    "sourced": _path(_any("script_fields", "runtime_mappings")) + _KEY + "script",
}

_LOOKBACK = (
    f"({_SEARCH}{_any('query', 'post_filter')}{_US}{_ANY_CONTEXT}{_path('range')})({_NAME}){_US}"
    + _any("gte", "gt", "lte", "lt")
    + _RS
    + r"\s*now-(\d+)([smhdw])\s*(?=\x1d|$)"
)

_TOP = _SEARCH
_QUERY_TYPES = {
    "knn": _TOP + r"(?:query\x1f(?:[^\x1d]*\x1f)?)?knn[\x1c-\x1f]",
    "geo": _TOP + r"(?:query|post_filter)\x1f[^\x1d]*?\bgeo_(?:distance|bounding_box|polygon|shape)\x1f",
    "agg": _TOP + r"(?:aggs|aggregations)\x1f",
    "text": _TOP
    + r"query\x1f(?:[^\x1d]*?\x1f)?(?:match|match_phrase|match_phrase_prefix|multi_match|query_string|simple_query_string)\x1f",
}

# --- Expressions ----------------------------------------------------------------------------


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _unescape(text: Column) -> Column:
    # The escape character itself is restored last.
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[1]), F.lit(pair[0])), ESCAPES.items(), text)


def _names(found: Column, nodes: Column) -> Column:
    restored = F.transform(found, _unescape)
    return F.when(F.contains(nodes, F.lit(ESC)), restored).otherwise(found)


def _empty() -> Column:
    return F.array().cast("array<string>")


def _script_names(nodes: Column, category: str) -> Column:
    sources = F.array_join(_all(nodes, _SEARCH + _SCRIPT_PATHS[category] + _RS + r"([^\x1d]*)"), "\x1d")
    text = _unescape(sources)
    found = F.concat(*[_all(text, pattern) for pattern in SCRIPT_REFERENCES])
    kept = F.filter(found, lambda name: ~F.startswith(name, F.lit("_")))
    scripted = F.contains(nodes, F.lit("doc[")) | F.contains(nodes, F.lit("ctx._source."))
    return F.when(scripted, kept).otherwise(_empty())


def script_names(nodes: Column) -> Column:
    """Fields named in scripts, per category. Kept as a column of its own, since both the field
    sets and the language tag read it."""
    return F.struct(*[_script_names(nodes, c).alias(c) for c in _SCRIPT_PATHS])


def field_set(nodes: Column, scripts: Column, category: str) -> Column:
    """Sorted distinct field names of one category."""
    possible = reduce(lambda a, b: a | b, [F.contains(nodes, F.lit(text)) for text in _NEEDED[category]])
    if category == "written":
        found = _names(_all(nodes, _WRITE + _FIELD), nodes)
    else:
        found = _names(_all(nodes, _SEARCH + _FIELD_PATHS[category] + _FIELD), nodes)
        if category in ("queried", "filtered"):
            tree = _QUERIED_TREE if category == "queried" else _FILTERED_TREE
            boosted = _names(_all(nodes, _SEARCH + tree + _MULTI_MATCH + _BOOSTED_FIELD), nodes)
            multi = F.contains(nodes, F.lit("multi_match"))
            found = F.concat(found, F.when(multi, boosted).otherwise(_empty()))
    found = F.when(possible, found).otherwise(_empty())
    if category in _SCRIPT_PATHS:
        found = F.concat(found, scripts[category])
    return F.when(F.size(found) > 1, F.sort_array(F.array_distinct(found))).otherwise(found)


def field_sets(nodes: Column, scripts: Column) -> Column:
    return F.struct(*[field_set(nodes, scripts, c).alias(c) for c in FIELD_CATEGORIES])


def has_script_references(scripts: Column) -> Column:
    """True if any script in the body names a user field."""
    return reduce(lambda a, b: a | b, [F.size(scripts[c]) > 0 for c in _SCRIPT_PATHS])


def all_fields(fields: Column) -> Column:
    return F.sort_array(
        F.array_distinct(F.concat(*[F.coalesce(fields[c], _empty()) for c in FIELD_CATEGORIES]))
    )


def lookback(nodes: Column) -> Column:
    """Widest relative time window as struct(seconds, order, field, label, body), or null.

    Per range body the first relative bound in the order gte, gt, lte, lt counts; ties between
    bodies go to the one visited first, which is the order of the records.
    """
    units = F.create_map(*[F.lit(x) for pair in SECONDS_PER_UNIT.items() for x in pair])

    def candidate(record: Column, position: Column) -> Column:
        def part(group: int) -> Column:
            return F.regexp_extract(record, _LOOKBACK, group)

        return F.struct(
            (part(3).cast("double") * F.element_at(units, part(4))).alias("seconds"),
            (-position).alias("order"),
            part(2).alias("field"),
            F.concat(part(3), part(4)).alias("label"),
            F.concat(part(1), part(2)).alias("body"),
        )

    def first_of_body(candidates: Column) -> Column:
        return F.filter(
            candidates,
            lambda c, i: (i == 0) | (c["body"] != F.get(candidates, i - F.lit(1))["body"]),
        )

    # The candidates are bound to a name first: inside the filter the expression itself would be
    # computed again for every one of them.
    found = F.array(F.transform(_all(nodes, _LOOKBACK, 0), candidate))
    widest = F.element_at(F.transform(found, lambda candidates: F.array_max(first_of_body(candidates))), 1)
    return F.when(F.contains(nodes, F.lit("now-")), widest)


def query_type(nodes: Column) -> Column:
    """Kind of search: knn, geo, agg or text, in that order of precedence, else filter."""
    chain = None
    for name, pattern in _QUERY_TYPES.items():
        hit = F.regexp_like(nodes, F.lit(pattern))
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain.otherwise("filter")
