"""Text functions as column expressions."""

from __future__ import annotations

import html
import re
import string
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The entities that the expression form replaces; "&amp;" comes last.
NAMED_ENTITIES = (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&#39;", "'"), ("&amp;", "&"))

#: Shown for a rate without a denominator.
NO_RATE = "—"


def trim_u(x: Column) -> Column:
    """Trim all Unicode white space; SQL's trim takes blanks only."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(trim_u(x), F.lit(""))


def length_between(x: Column, low: int, high: int) -> Column:
    """Whether the trimmed text has so many characters; false for null."""
    return F.coalesce(F.length(trim_u(x)).between(low, high), F.lit(False))


def unescape_named(x: Column) -> Column:
    """Unescape ``NAMED_ENTITIES`` once."""
    for entity, char in NAMED_ENTITIES:
        x = F.replace(x, F.lit(entity), F.lit(char))
    return x


@F.pandas_udf(T.StringType())
def unescape_all(x: pd.Series) -> pd.Series:
    """Unescape every HTML entity, twice; for text whose entities are not known beforehand."""
    return x.map(lambda t: t if t is None or "&" not in t else html.unescape(html.unescape(t)))


#: The byte that a character stands for where text was read as Windows-1252 or Latin-1: the 27 special
#: characters of Windows-1252 for bytes from 0x80 on, else the character's own number.
_BYTE_OF = {bytes([k]).decode("cp1252", "replace"): k for k in range(0x80, 0xA0)} | {chr(k): k for k in range(0x80, 0x100)}
_BYTE_OF.pop("\ufffd", None)
_MANGLED = re.compile("[" + re.escape("".join(_BYTE_OF)) + "]{2,}")
#: UTF-8 of one character beyond ASCII.
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _unmangled_run(found: re.Match) -> str:
    """A run of characters, with those that are the bytes of one character put together."""
    run = found.group()
    raw, out, at = bytes(_BYTE_OF[c] for c in run), [], 0
    for m in _SEQUENCE.finditer(raw):
        out += [run[at : m.start()], m.group().decode()]
        at = m.end()
    return "".join(out) + run[at:]


def unmangled(text: str) -> str:
    """Text without UTF-8 that was read as Windows-1252 or Latin-1, however often.

    Each round puts sequences together that are UTF-8 of one character; both code
    pages may be mixed in one text and one sequence. Every round that changes
    something leaves fewer characters, so rounds end.
    """
    while (better := _MANGLED.sub(_unmangled_run, text)) != text:
        text = better
    return text


@F.pandas_udf(T.StringType())
def repair_mojibake(x: pd.Series) -> pd.Series:
    """``unmangled`` of each text, in Arrow batches."""
    return x.map(lambda t: t if t is None or t.isascii() else unmangled(t))


_PUNCTUATION = str.maketrans("", "", string.punctuation)


def canonical_str(text: str) -> str:
    """The canonical form of one text, for use inside tasks: every entity is unescaped, twice, after mangled characters are mended."""
    plain = html.unescape(html.unescape(unmangled(text))).strip().replace("_", " ")
    return " ".join(plain.translate(_PUNCTUATION).lower().split())


@F.pandas_udf(T.StringType())
def canonical_all(x: pd.Series) -> pd.Series:
    """``canonical_str`` of each text, in Arrow batches."""
    return x.map(lambda t: t if t is None else canonical_str(t))


def canonical_text(x: Column, every_entity: bool = False) -> Column:
    """Unescape twice, trim, underscores to blanks, drop ASCII punctuation, lower, one blank between words.

    ``NAMED_ENTITIES`` are unescaped in the plan; ``every_entity`` takes all of
    HTML's and mends mangled characters first, in Arrow batches.
    """
    if every_entity:
        return canonical_all(x)
    x = trim_u(unescape_named(unescape_named(x)))
    x = F.regexp_replace(F.replace(x, F.lit("_"), F.lit(" ")), r"\p{Punct}", "")
    return trim_u(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def humanize(code: Column) -> Column:
    """``sports_jersey`` -> ``Sports jersey``; only the first letter is raised."""
    spaced = trim_u(F.replace(code, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def class_label(attribute: Column, code: Column, labels: Mapping[str, str], patterns: Mapping[str, str], exempt: Mapping[str, set[str]]) -> Column:
    """Label of a class: its own or the humanized code, put into the attribute's pattern unless exempt.

    A pattern holds ``{label}``; a patterned label is lower-cased but for its first letter.
    """
    own = F.lit(None).cast("string")
    for c, label in labels.items():
        own = F.when(code == c, F.lit(label)).otherwise(own)
    plain = F.coalesce(own, humanize(code))
    lowered = F.concat(F.lower(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2)))
    out = plain
    for a, pattern in patterns.items():
        before, _, after = pattern.partition("{label}")
        text = F.lower(F.concat(F.lit(before), lowered, F.lit(after)))
        raised = F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
        free = code.isin(*exempt[a]) if exempt.get(a) else F.lit(False)
        out = F.when((attribute == a) & ~free, raised).otherwise(out)
    return out


def percent_text(part: Column, whole: Column) -> Column:
    """``12.3%``, half to even; a dash without a denominator."""
    rate = F.try_divide(part.cast("double") * 100, whole)
    return F.when(whole == 0, NO_RATE).otherwise(F.concat(F.format_number(rate, 1), F.lit("%")))


def fraction_text(part: Column, whole: Column) -> Column:
    return F.concat(part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(" ("), percent_text(part, whole), F.lit(")"))


def number_text(x: Column, digits: int = 2) -> Column:
    return F.coalesce(F.format_number(x, digits), F.lit("N/A"))


def tri_state(x: Column) -> Column:
    return F.when(x, "true").when(~x, "false").otherwise("null")


def shown_verdict(x: Column, present: Column | None = None) -> Column:
    """``tri_state``, and '' where the value is absent."""
    return tri_state(x) if present is None else F.when(present, tri_state(x)).otherwise("")


#: What a check says without a mention, with a right one, a wrong one, and one that was not judged.
MENTION_TEXTS = ("Không nhắc (không tính lỗi)", "Có nhắc và khớp nhãn", "Có nhắc nhưng không khớp nhãn", "Dữ liệu cũ không hợp lệ; cần chấm lại")


def mention_text(mentioned: Column, correct: Column, texts: Sequence[str] = MENTION_TEXTS) -> Column:
    """What a check of one attribute says."""
    absent, right, wrong, bad = texts
    return F.when(~F.coalesce(mentioned, F.lit(False)), absent).when(correct, right).when(~correct, wrong).otherwise(bad)


def json_string(x: Column) -> Column:
    """A text as JSON, letters beyond ASCII as they are; null as ``null``. Control characters have upper-case digits."""
    wrapped = F.to_json(F.struct(x.alias("v")))
    return F.coalesce(F.when(x.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)), F.lit("null"))


def json_list(x: Column) -> Column:
    """Texts as a JSON list with a blank after each comma; null as ``null``."""
    return F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(x, json_string), ", "), F.lit("]")), F.lit("null"))


def sorted_json(entries: Column) -> Column:
    """A map of JSON texts as a JSON object, its keys in the order of their code points, with blanks after commas and colons."""
    pairs = F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(json_string(e["key"]), F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def error_code(message: Column) -> Column:
    """The part before the first colon, lower-case, blanks to underscores."""
    return F.replace(F.lower(F.split(message, ":").getItem(0)), F.lit(" "), F.lit("_"))


def error_code_of_class(name: Column) -> Column:
    """A class name without ``Error``, lower-case."""
    return F.lower(F.replace(name, F.lit("Error"), F.lit("")))


def service_url(x: Column) -> Column:
    """An address that ends with ``/v1`` once and no slash."""
    bare = F.regexp_replace(x, "/+$", "")
    return F.when(bare.endswith("/v1"), bare).otherwise(F.concat(bare, F.lit("/v1")))


def parse_boolean(x: Column) -> Column:
    """true for 1/true/yes/on, false for 0/false/no/off, else null."""
    low = F.lower(trim_u(x))
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)


def dotenv_pair(line: Column) -> Column:
    """``struct(key, value)`` of a settings line; null for comments and lines without ``=``."""
    text = trim_u(line)
    key = trim_u(F.regexp_extract(text, r"^([^=]*)=", 1))
    value = trim_u(F.regexp_extract(text, r"^[^=]*=(.*)$", 1))
    bare = F.regexp_replace(value, "^[\"']+|[\"']+$", "")
    good = ~text.startswith("#") & text.contains("=") & (key != "")
    return F.when(good, F.struct(key.alias("key"), bare.alias("value")))


def mime_type(path: Column) -> Column:
    """By extension; JPEG if unknown."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.lit("image/jpeg")
    for kind, exts in (("image/png", ("png",)), ("image/webp", ("webp",)), ("image/gif", ("gif",)), ("image/bmp", ("bmp",))):
        out = F.when(ext.isin(*exts), kind).otherwise(out)
    return out


def key_of(method: Column, sample_id: Column) -> Column:
    return F.concat_ws(":", method, sample_id)


def column_letters(n: int) -> str:
    """1 -> A, 27 -> AA."""
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def url_path(x: Column) -> Column:
    """Percent-encode each segment of a path."""
    return F.array_join(F.transform(F.split(x, "/"), lambda s: F.replace(F.url_encode(s), F.lit("+"), F.lit("%20"))), "/")
