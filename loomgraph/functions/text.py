"""Text, id and parsing expressions; JVM-side except for HTML entities (ids F1-F28)."""

from __future__ import annotations

import base64
import html
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

#: Delimiters of extraction output and of stored multi-values.
FIELD = " | "
RECORD = "\n"
COMPLETE = "<|COMPLETE|>"
SEP = "<SEP>"
EDGE_SEP = "|#|"
LIST_SEP = "|*|"
UNKNOWN = "UNKNOWN"
SOURCES_MARK = "-----Sources-----"
CHUNK_JOIN = "--New Chunk--\n"

BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
TOKEN_SPLIT = r"[ \t\n\r\f]+"


def quote(marker: str) -> str:
    """A literal as a Java regular expression."""
    return "\\Q" + marker + "\\E"


def strip(x: Column) -> Column:
    """Strips Unicode white space at both ends."""
    # possessive, and tried once a run: linear on long blank runs
    return F.regexp_replace(x, f"^{BLANK}++|(?<!{BLANK}){BLANK}++$", "")


@F.pandas_udf(StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def clean(x: Column, entities: bool = True) -> Column:
    """Strip, unescape HTML entities, drop control characters.  Texts without ``&``
    go to the Python worker as nulls."""
    s = strip(x)
    if entities:
        s = F.coalesce(_unescape(F.when(F.instr(s, "&") > 0, s)), s)
    return F.regexp_replace(s, r"[\x00-\x1f\x7f-\x9f]", "")


def split_markers(x: Column, markers: list[str]) -> Column:
    """Split at any literal marker; parts are stripped and empty ones dropped."""
    parts = F.split(x, "|".join(map(quote, markers)))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def content_id(x: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.md5(x))


def canonical(members: Column) -> Column:
    """A hyperedge's members: sorted, distinct."""
    return F.array_sort(F.array_distinct(members))


def edge_key(members: Column) -> Column:
    return F.array_join(canonical(members), EDGE_SEP)


def tokens(x: Column) -> Column:
    """The default tokenizer: runs between white space."""
    return F.array_remove(F.split(x, TOKEN_SPLIT), "")


def token_count(x: Column) -> Column:
    return F.coalesce(F.size(tokens(x)), F.lit(0))


def weight(x: Column, default: float = 0.75) -> Column:
    """A decimal without exponent, or the default (fixed values: the pattern, 0.75)."""
    return F.when(x.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), x.cast("double")).otherwise(F.lit(default))


def record_body(x: Column) -> Column:
    """Text inside the outermost parentheses of one line; null without them."""
    return F.when(x.rlike(r"(?d)\((.*)\)"), F.regexp_extract(x, r"(?d)\((.*)\)", 1))


def json_body(x: Column) -> Column:
    """From the first ``{`` to the last ``}``; null without them."""
    return F.nullif(F.regexp_extract(x, r"(?s)(\{.*\})", 1), F.lit(""))


def keyword_list(body: Column, key: str) -> Column:
    """A keyword field of a JSON text as ``", "``-joined text; lists and strings both work."""
    raw = F.get_json_object(body, f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull(), "").when(raw.startswith("["), F.coalesce(F.array_join(listed, ", "), F.lit(""))).otherwise(raw)


def keywords(answer: Column) -> Column:
    """struct(high, low) of a keyword answer; falls back to the first flat object."""
    whole = json_body(answer)
    flat = F.nullif(F.regexp_extract(answer, r"(?s)(\{[^}]*\})", 1), F.lit(""))
    body = F.when(F.try_parse_json(whole).isNotNull(), whole).otherwise(flat)
    return F.when(
        F.try_parse_json(body).isNotNull(),
        F.struct(keyword_list(body, "high_level_keywords").alias("high"), keyword_list(body, "low_level_keywords").alias("low")),
    )


def scores(answer: Column) -> Column:
    """The first five metric scores of a judge's answer."""
    return F.slice(F.regexp_extract_all(answer, F.lit(r'"Score":\s*(?:"?(\d+)"?)'), F.lit(1)), 1, 5).cast("array<int>")


def winners(answer: Column) -> Column:
    """The winners of a judge's pairwise answer, lower-cased."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r'"Winner":\s*"?(Answer [12])"?'), F.lit(1)), F.lower)


def question_of(answer: Column) -> Column:
    """The Question field of a generated question's JSON, by parse or by pattern."""
    body = json_body(answer)
    return F.coalesce(F.get_json_object(body, "$.Question"), F.nullif(F.regexp_extract(answer, r'"Question":\s*"([^"]*)"', 1), F.lit("")))


def database_name(file_name: Column) -> Column:
    """At most five word characters of a file name without its extension."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^./]*$", "")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(stem, r"(?U)[^\w]", ""), 1, 5), F.lit("")), F.lit("default"))


def csv_row(*cols: Column) -> Column:
    """One CSV record as common writers quote it (minimal quoting)."""
    opts = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    return F.to_csv(F.struct(*cols), opts)


def csv_section(header: list[str], rows: Column) -> Column:
    """Header and collected rows, CRLF between records."""
    return F.concat(F.lit(",".join(header)), F.lit("\r\n"), F.array_join(rows, "\r\n"))


def before_sources(x: Column) -> Column:
    return F.substring_index(x, SOURCES_MARK, 1)


def pack_messages(texts: Column) -> Column:
    """Texts to messages; roles alternate, the user first."""
    return F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))


def clean_answer(answer: Column, prompt: Column, drop: list[str], when: Callable[[Column, Column], Column] | None = None) -> Column:
    """Removes the echoed prompt and listed fragments from an answer longer than its prompt."""
    out = F.replace(answer, prompt, F.lit(""))
    for d in drop:
        out = F.replace(out, F.lit(d), F.lit(""))
    longer = when(answer, prompt) if when else F.length(answer) > F.length(prompt)
    return F.when(longer, strip(out)).otherwise(answer)


def edge_members(x: Column, sep: str = LIST_SEP) -> Column:
    """The members of a joined edge id, stripped; inverse of joining them."""
    return F.filter(F.transform(F.split(x, quote(sep)), strip), lambda m: m != "")


def url_name(x: Column) -> Column:
    """A name as a path segment carries it: only escaped blanks are undone."""
    return F.replace(x, F.lit("%20"), F.lit(" "))


def csv_fields(x: Column, n: int) -> Column:
    """The n fields of one CSV record as an array."""
    names = [f"f{i}" for i in range(n)]
    row = F.from_csv(x, ", ".join(f"{c} string" for c in names), {"escape": '"'})
    return F.array(*[F.coalesce(row[c], F.lit("")) for c in names])


def section(x: Column, name: str) -> Column:
    """The body of a ``-----name-----`` section of a context; null without it."""
    found = F.regexp_extract(x, rf"(?s)(?:^|\n)-----{quote(name)}-----\n(.*?)(?=\n-----|\z)", 1)
    return F.when(x.contains(f"-----{name}-----"), found)


def embeddable(x: Column, most: int = 512) -> Column:
    """The characters that an embedder with a limit is given (fixed value: 512)."""
    return F.substring(x, 1, most)


@F.pandas_udf(ArrayType(FloatType()))
def packed_vector(x: pd.Series) -> pd.Series:
    """A base64 text of little-endian 32-bit floats to a vector."""
    return x.map(lambda t: np.frombuffer(base64.b64decode(t), "<f4"), na_action="ignore")


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent; 0 of nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))
