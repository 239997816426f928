"""Column functions; every one is a built-in Spark expression."""

from tablerecon.functions.collections import (
    as_list,
    dedupe_keep_order,
    merge_map,
    nested_remove,
    nested_upsert,
    tag_add,
    tag_value,
    targets_of,
)
from tablerecon.functions.compare import differs
from tablerecon.functions.documents import (
    build_params,
    canonical_json,
    extract_attrs,
    path_get,
)
from tablerecon.functions.hashing import row_hash
from tablerecon.functions.templates import substitute, substitute_columns
from tablerecon.functions.text import (
    address,
    bounded_key,
    clean_names,
    event_day,
    full_name,
    full_ref,
    sanitize_key,
    slugify,
    strip_space,
)

__all__ = [
    "address",
    "as_list",
    "bounded_key",
    "build_params",
    "canonical_json",
    "clean_names",
    "dedupe_keep_order",
    "differs",
    "event_day",
    "extract_attrs",
    "full_name",
    "full_ref",
    "merge_map",
    "nested_remove",
    "nested_upsert",
    "path_get",
    "row_hash",
    "sanitize_key",
    "slugify",
    "strip_space",
    "substitute",
    "substitute_columns",
    "tag_add",
    "tag_value",
    "targets_of",
]
