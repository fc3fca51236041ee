"""Pieces of the DuckDB SQL that queries are compared with."""

from __future__ import annotations

BLANKS = r"\s\v\x1c-\x1f\x{85}\p{Z}"
LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def words(c: str) -> str:
    return f"len(regexp_extract_all({c}, '[^{BLANKS}]+'))"


def tokens(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} is not null then greatest(1, cast(floor({words(c)} * 1.3::double) as int)) end"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{BLANKS}]+|[{BLANKS}]+$', '', 'g')"


def collapse(c: str) -> str:
    return f"regexp_replace({strip(c)}, '[{BLANKS}]+', ' ', 'g')"


def clean_lines(c: str) -> str:
    return f"list_filter(list_transform(string_split_regex({c}, '{LINES}'), lambda x: {strip('x')}), lambda x: x <> '')"


def key(c: str) -> str:
    return f"nullif(lower({strip(c)}), '')"


def table_row(x: str) -> str:
    return f"(len({x}) - len(replace({x}, '|', '')) >= 2 or contains({x}, '!!'))"


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)
