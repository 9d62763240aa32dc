"""Oracle SQL fragments shared by several queries: the same rules, written for DuckDB."""

from __future__ import annotations

from plinth.functions.text import GENERIC_NAME_WORDS, LEGAL_FORMS, latin_fold_table


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(items: list[str]) -> str:
    return ", ".join(quoted(i) for i in items)


def contains_any(expr: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({expr}), {quoted(w)})" for w in words) + ")"


def count_words(expr: str, words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains(lower({expr}), {quoted(w)}) as int)" for w in words) + ")"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def normalize(expr: str) -> str:
    source, target = latin_fold_table()
    out = f"regexp_replace(lower(trim({expr})), '[&+]', ' and ', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g')"
    forms = "|".join(LEGAL_FORMS)
    for _ in range(3):
        out = f"trim(regexp_replace({out}, '(^|[^\\p{{L}}\\p{{N}}_])({forms})\\s*$', '\\1'))"
    out = f"translate({out}, {quoted(source)}, {quoted(target)})"
    for letter, plain in [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ŋ", "ng"), ("ĳ", "ij")]:
        out = f"replace({out}, '{letter}', '{plain}')"
    return collapse(out)


def slug(normalized: str) -> str:
    return f"trim(regexp_replace(regexp_replace({normalized}, '\\s+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')"


def aliases(normalized: str) -> str:
    """List of alias forms of an already normalised name."""
    words = f"list_filter(string_split({normalized}, ' '), lambda w: length(w) > 0)"
    acronym = f"array_to_string(list_transform({words}, lambda w: substr(w, 1, 1)), '')"
    short = f"array_to_string(list_filter({words}, lambda w: not list_contains([{values(GENERIC_NAME_WORDS)}], w)), ' ')"
    forms = f"[{normalized}, case when length({acronym}) >= 2 then {acronym} end, {short}]"
    return f"list_filter({forms}, lambda a: a is not null and length(a) > 0)"


def trigrams(expr: str) -> str:
    return (
        f"list_distinct(flatten(list_transform(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def jaccard(left: str, right: str) -> str:
    shared = f"len(list_intersect({left}, {right}))"
    return f"coalesce({shared}::double / nullif(len({left}) + len({right}) - {shared}, 0), 0.0)"


def has(column: str) -> str:
    return f"coalesce(length(cast({column} as varchar)) > 0, false)"


def points(*parts: tuple[str, int]) -> str:
    return "(" + " + ".join(f"case when {cond} then {weight} else 0 end" for cond, weight in parts) + ")"
