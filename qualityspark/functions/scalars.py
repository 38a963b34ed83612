"""Scalar Column functions. Whitespace is ASCII whitespace throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEVELS = ["INFO", "METADATA", "OPTIONAL", "REQUIRED"]
STATUSES = ["SUCCESS", "FAILURE", "SKIP", "ERROR"]
PLOT_LEVELS = ["INFO", "OPTIONAL", "REQUIRED"]
PLOT_TYPES = ["metadata", "data", "congruence"]
TRUE_WORDS = ["true", "on", "yes"]
FALSE_WORDS = ["false", "off", "no"]
ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"

_WS = r"[ \t\n\r\f\x0B]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` written and evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def month_end(ts: Column) -> Column:
    return F.last_day(ts)


def in_month(ts: Column, target: Column) -> Column:
    """True in the calendar month of ``target``. A range on ``ts``, so it reaches the scan."""
    first = F.date_trunc("month", target)
    return (ts >= first) & (ts < F.add_months(first, 1).cast("timestamp"))


def percent(score: Column) -> Column:
    return score * F.lit(100.0)


def iso_millis(ts: Column) -> Column:
    """ISO-8601 text with milliseconds; the session time zone is UTC."""
    return F.date_format(ts, ISO_MILLIS)


def parse_iso(text: Column) -> Column:
    return F.try_to_timestamp(text)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{_WS}+", ""), f"{_WS}+$", "")


def normalize_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{_WS}+", " "))


def strip_node_prefix(node_id: Column) -> Column:
    return F.regexp_replace(node_id, "urn:node:", "")


def award_key(award: Column) -> Column:
    """Award text to lookup key.

    A value that is a plain number is padded to seven digits; text such as
    ``NSF Award 123`` is lower-cased and loses its prefix but is not padded.
    """
    key = strip(F.replace(F.lower(award), F.lit("nsf award"), F.lit("")))
    return F.when(award.rlike("^[1-9][0-9]{0,5}$"), F.lpad(award, 7, "0")).otherwise(key)


def word_count(text: Column) -> Column:
    """Words of a text split on whitespace; a blank text counts one, as a split does."""
    return count_words(strip(text))


def count_words(stripped: Column) -> Column:
    return F.size(F.split(stripped, f"{_WS}+"))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def all_blank(items: Column) -> Column:
    return F.forall(items, is_blank)


def longer_than(text: Column, n: int) -> Column:
    return F.length(text) > n


def has_duplicates(items: Column) -> Column:
    return F.size(items) > F.size(F.array_distinct(items))


def url_key(url: Column) -> Column:
    return F.md5(url)


def checksum(text: Column) -> Column:
    return F.sha1(text)


def byte_size(text: Column) -> Column:
    return F.octet_length(text)


def run_key(pid: Column, suite_id: Column, ts: Column) -> Column:
    """Deterministic run id, so a retried task gives the same one."""
    return F.sha2(F.concat_ws(",", pid.cast("string"), suite_id.cast("string"), ts.cast("string")), 256)


def relative_path(storage_type: Column, alt_filename: Column, file_id: Column, extension: Column) -> Column:
    """``storage/name[.ext]``; the extension is left out if the name already holds it.

    The extension is matched as a pattern anywhere in the name, so its leading
    dot stands for any character.
    """
    name = F.when(F.coalesce(F.length(alt_filename), F.lit(0)) > 0, alt_filename).otherwise(file_id)
    dotted = F.when(F.instr(extension, ".") > 0, extension).otherwise(F.concat(F.lit("."), extension))
    bare = F.concat_ws("/", storage_type, name)
    return (
        F.when(F.coalesce(F.length(extension), F.lit(0)) == 0, bare)
        .when(F.regexp_like(name, dotted), bare)
        .otherwise(F.concat(bare, F.lit("."), extension))
    )


def result_colour(level: Column, status: Column) -> Column:
    return (
        F.when(level == "INFO", "BLUE")
        .when(status == "SKIP", "BLUE")
        .when(status == "SUCCESS", "GREEN")
        .when(status == "FAILURE", F.when(level == "OPTIONAL", "ORANGE").otherwise("RED"))
        .when(status == "ERROR", F.when(level == "REQUIRED", "RED").otherwise("ORANGE"))
    )


def rank_in(value: Column, order: list[str]) -> Column:
    """Position of a value in a fixed order, from 1; 0 when it is not listed."""
    return F.array_position(F.array(*[F.lit(v) for v in order]), value)


def percent_label(label: Column, mean: Column) -> Column:
    """``Name (62%)``, halves to the even number."""
    return F.concat(label, F.lit(" ("), F.bround(mean, 0).cast("bigint").cast("string"), F.lit("%)"))


def xml_unescape(text: Column) -> Column:
    # &amp; goes last, so that &amp;lt; ends as &lt;.
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def url_encode(text: Column) -> Column:
    return F.url_encode(text)


def is_scoped_identifier(text: Column) -> Column:
    """``scope.identifier.revision``"""
    return text.rlike(r"^[^.]+\.[0-9]+\.[0-9]+$")


def two_decimals(score: Column) -> Column:
    """A score as the index stores it: two decimals, halves to even, as FLOAT."""
    return F.call_function("format_number", score, F.lit(".##")).cast("float")


# Fixed value: texts that are numbers.
_NUMBER = r"^-?(0[xX][0-9a-fA-F]+|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[fFdD]?|[0-9]+[lL])$"


def retype_sql(text: str) -> str:
    """SQL of a text's tagged value: number, boolean or string, else null.

    Digits with a leading zero stay strings. ``text`` is a column name or any
    other SQL; it is bound once. Written as SQL because a suite holds one per
    selector, and as Column calls each would cost hundreds of driver round trips.
    """
    words = ", ".join(f"'{w}'" for w in TRUE_WORDS + FALSE_WORDS)
    yes = ", ".join(f"'{w}'" for w in TRUE_WORDS)
    kind = f"""CASE WHEN t IS NULL THEN NULL
        WHEN t RLIKE r'{_NUMBER}' AND NOT t RLIKE '^0[0-9]*$' THEN 'number'
        WHEN length(t) <= 5 AND lower(t) IN ({words}) THEN 'boolean' ELSE 'string' END"""
    number = """CASE WHEN s.t RLIKE '^-?0[xX]' THEN if(startswith(s.t, '-'), -1.0D, 1.0D)
            * CAST(conv(regexp_replace(s.t, '^-?0[xX]', ''), 16, 10) AS DOUBLE)
        ELSE try_cast(regexp_replace(s.t, '[fFdDlL]$', '') AS DOUBLE) END"""
    # Two steps, as no inner lambda may use an outer one's variable: Spark does
    # not take such an expression as the argument of a Python function.
    return f"""transform(transform(array({text}), t -> named_struct('t', t, 'k', {kind})), s -> named_struct('kind', s.k,
        'num', CASE WHEN s.k = 'number' THEN {number} END,
        'bool', CASE WHEN s.k = 'boolean' THEN lower(s.t) IN ({yes}) END,
        'str', CASE WHEN s.k = 'string' THEN s.t END))[0]"""
