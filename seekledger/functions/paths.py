"""Request paths: index names, operation, and how the body is to be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Operations whose body is a search, and operations that are not observed.
SEARCH_OPERATIONS = ("search", "count", "async_search", "update_by_query", "delete_by_query")
SKIPPED_OPERATIONS = ("cluster", "cat", "nodes", "tasks", "gateway")
# The segment that names the operation, without leading underscores: the first of a system path, the
# second where the first holds an index name.
_OPERATION = r"^/*+(?:_++|(?![, ]*+(?:/|\z))[^/]*+/_*+)([^/]*+)"
# Operation, and POST where it matters, to the grammar of the body.
_MODES = {
    **{op: "search" for op in SEARCH_OPERATIONS},
    "doc_write": "write",
    "update/POST": "update",
    "msearch": "msearch",
    "bulk": "bulk",
}


def _bare(path: Column) -> Column:
    return F.ltrim(path, F.lit("/"))


def _first(path: Column) -> Column:
    """First segment. Routes are part of filters, which compute them anew in each place: byte searches, no arrays."""
    return F.substring_index(_bare(path), "/", 1)


def _is_system(path: Column) -> Column:
    return F.startswith(_first(path), F.lit("_"))


def _has_names(path: Column) -> Column:
    return ~_is_system(path) & (F.translate(_first(path), ", ", "") != "")


def index_names(path: Column) -> Column:
    """Index names of a path, or null where it addresses none."""
    names = F.transform(F.split(_first(path), ",", -1), lambda name: F.trim(name))
    return F.when(_has_names(path), F.filter(names, lambda name: name != ""))


def path_operation(path: Column) -> Column:
    """First segment of a system path, else the second one, without leading underscores. Filters and columns
    repeat this expression, so it holds its path once."""
    bare = F.regexp_extract(path, _OPERATION, 1)
    return F.coalesce(F.regexp_replace(bare, r"^\z", "other"), F.lit("other"))


def _writes(method: Column) -> Column:
    return F.upper(method).isin("PUT", "POST")


def operation(path: Column, method: Column) -> Column:
    named = path_operation(path)
    document = F.when(_writes(method), "doc_write").otherwise("doc_get")
    return F.when(named == "doc", document).otherwise(named)


def body_mode(op: Column, method: Column) -> Column:
    """Which body grammar applies: search, msearch, write, update, bulk or none."""
    modes = F.create_map(*[F.lit(x) for pair in _MODES.items() for x in pair])
    updates = F.when(op == "update", F.upper(method))
    return F.coalesce(F.try_element_at(modes, F.concat_ws("/", op, updates)), F.lit("none"))


def is_skipped(op: Column, path: Column) -> Column:
    """System operations and requests that touch any dot-prefixed index leave no event."""
    names = F.replace(_first(path), F.lit(" "), F.lit(""))
    hidden = ~_is_system(path) & (F.startswith(names, F.lit(".")) | F.contains(names, F.lit(",.")))
    return op.isin(*SKIPPED_OPERATIONS) | hidden
