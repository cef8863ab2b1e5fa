"""A registry of named queries, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from lorekeep.functions.text import STOP_WORDS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str) -> str:
    """The SQL of ``functions.text.tokens``."""
    return (
        rf"list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}]+'), "
        rf"lambda w: (length(w) > 2 OR regexp_matches(w, '[a-zа-я][0-9]|[0-9][a-zа-я]')) AND w NOT IN ({_STOP}))"
    )


def sql_set(tokens: str) -> str:
    """Distinct entries of a list (their order is not kept)."""
    return f"list_distinct({tokens})"
