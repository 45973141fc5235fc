"""Shared pieces of the DuckDB oracles."""

STRIP = r"'^\s+|\s+$', '', 'g'"

LINES = """lines as (
  select doc_id, lang, source, i::int as block_index, (i // 10)::int as page,
         regexp_replace(l[i + 1], '^\\s+|\\s+$', '', 'g') as text, l[i + 1] as raw
  from (select *, unnest(range(len(l))) as i
        from (select *, string_split(text, chr(10)) as l from documents)))"""

BLOCKS = LINES + """,
blocks as (select doc_id, lang, source, block_index, page, text from lines where length(text) >= 1)"""


def tokens_sql(col: str) -> str:
    """Word tokens of two or more characters."""
    return f"regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}')"


def words_sql(col: str) -> str:
    """Non-empty pieces between white space."""
    return f"list_filter(regexp_split_to_array({col}, '\\s+'), lambda x: x <> '')"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(col: str, words) -> str:
    return "(" + " or ".join(f"contains({col}, {quote(w)})" for w in words) + ")"
