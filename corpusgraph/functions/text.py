"""Text functions as column expressions: they stay in the JVM and inside whole-stage code where Spark allows."""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the index: what a token consists of, and how long snippets and lines may be.
TOKEN = r"[0-9A-Za-zА-Яа-яЁё_:.\-/]{2,}"
PART = r"[a-zа-яё]+|[0-9]+"
SNIPPET_CHARS, LINE_CHARS = 1200, 1200
UUID = r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"
#: Fixed values of redaction: names whose values are hidden, and the marks left in their place.
SECRET_NAMES = "authorization|client[_-]?secret|access[_-]?token|refresh[_-]?token|password|passwd|cookie"
SENSITIVE_KEY = "(?i)(password|passwd|secret|token|authorization|cookie|session|credential|private.?key|connection.?string)"
HIDDEN, EMAIL = "[HIDDEN]", "[EMAIL]"
#: Fixed values of the web's standards: credentials after a scheme (token68), the atoms of a mail address, labels of a host name.
SCHEMES, TOKEN68 = "bearer|basic", r"[a-z0-9._~+/\-]+=*"
ATOM, LABEL = r"[a-z0-9!#$%&'*+?^_`{|}~\-]+", r"[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?"
#: Fixed value of the logs: how a user's id is written.
USER_KEY = r"(?i)\buserid\s*[:=]\s*"


@functools.cache
def _compatible() -> tuple[str, str]:
    """Characters that compatibility normalisation turns into one letter, digit or sign of a token, and what they become."""
    plain = re.compile(TOKEN.removesuffix("{2,}"))
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x1FBFA) if not 0xD800 <= c < 0xE000]
    pairs = [(c, to) for c, to in pairs if c != to and plain.fullmatch(to)]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


@functools.cache
def _unaccented() -> tuple[str, str]:
    """Latin letters with marks above or below, in lower case, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, to[0]) for c, to in pairs if len(to) > 1 and to[0].isascii() and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(to for _, to in pairs)


def _translated(x: Column, pairs: tuple[str, str]) -> Column:
    """Translates the few texts that have characters of the table's ranges; the others cost one search."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, pairs[0])):
        if ranges and c - ranges[-1][1] < 64:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    any_of = "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]"
    # a lambda's variable is computed once, however often its body names it
    return F.transform(F.array(x), lambda v: F.when(v.rlike(any_of), F.translate(v, *pairs)).otherwise(v))[0]


def compatible(text: Column | str) -> Column:
    """Full-width, circled, mathematical and other forms of letters and digits become the usual ones, and letters written with a
    separate mark one letter. Forms that stand for several letters stay."""
    x = _translated(col(text), _compatible())
    return F.replace(F.replace(x, F.lit("и\u0306"), F.lit("й")), F.lit("е\u0308"), F.lit("ё"))


def unaccented(text: Column | str) -> Column:
    """Lower case without the marks of Latin letters."""
    return _translated(F.lower(col(text)), _unaccented())


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_characters(text: Column | str) -> Column:
    """Character rules of the Markdown normaliser: line ends, no-break spaces, invisible and control characters, blanks at line ends."""
    x = F.regexp_replace(col(text), r"\r\n?|[\x{85}\x{2028}\x{2029}]", "\n")
    x = F.regexp_replace(x, r"\x{A0}", " ")
    x = F.regexp_replace(x, r"[\x{200B}\x{FEFF}\x{AD}\x00-\x08\x0B-\x1F]", "")
    return F.regexp_replace(x, r"(?m)[ \t]+$", "")


def tokens(text: Column | str) -> Column:
    """Lower-cased index tokens. Accented Latin letters separate."""
    return F.regexp_extract_all(F.lower(compatible(text)), F.lit(TOKEN), F.lit(0))


def token_parts(token: Column | str) -> Column:
    """Runs of letters or of digits in a lower-cased token, longer than one character."""
    return F.filter(F.regexp_extract_all(col(token), F.lit(PART), F.lit(0)), lambda p: F.length(p) > 1)


def words(text: Column | str) -> Column:
    """Full-text words: runs of letters and numbers without accents; every other character separates."""
    return F.regexp_extract_all(unaccented(compatible(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str, most: int = 32) -> list[str]:
    """The terms of a query, at most ``most`` (a feature of the search); an error if there are none."""
    found = re.findall(TOKEN, unicodedata.normalize("NFKC", query))[:most]
    if not found:
        raise ValueError("the query has no words that can be searched")
    return [t.lower() for t in found]


def slug(text: Column | str) -> Column:
    """Lower case with dashes for everything but letters, digits, dots, underscores and slashes."""
    x = F.regexp_replace(F.lower(F.trim(compatible(text))), r"[^0-9a-zа-яё._/-]+", "-")
    x = F.regexp_replace(F.regexp_replace(x, "-+", "-"), "^-+|-+$", "")
    return F.when(x == "", F.lit("document")).otherwise(x)


def route(path: Column | str) -> Column:
    """Path of a page without its file ending; the root page is ``index``."""
    x = F.regexp_replace(F.regexp_replace(col(path), r"(^|/)index\.html$|\.html$", ""), "^/+|/+$", "")
    return F.when(x == "", F.lit("index")).otherwise(x)


def squeeze(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(text), r"\s+", " "))


def snippet(text: Column | str, most: int = SNIPPET_CHARS) -> Column:
    """White space squeezed, cut at the last space in the second half of the limit, with an ellipsis."""
    x = squeeze(text)
    head = F.substring(x, 1, most)
    back = F.instr(F.reverse(head), " ")
    at = F.lit(most) - back
    cut = F.when((back > 0) & (at >= most // 2), F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.rtrim(cut), F.lit("…")))


def compact_line(line: Column | str, most: int = LINE_CHARS) -> Column:
    x = col(line)
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most - 1), F.lit("…"))).otherwise(x)


def links(text: Column | str) -> Column:
    """Targets of Markdown links without their fragments, in order."""
    return F.transform(F.regexp_extract_all(col(text), F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), lambda h: F.substring_index(h, "#", 1))


def imports(text: Column | str) -> Column:
    """What import statements name."""
    return F.regexp_extract_all(col(text), F.lit(r"(?m)^[ \t]*(?:import|импорт)[ \t]+([^\n;]+)"), F.lit(1))


def join_route(root: Column | str, template: Column | str) -> Column:
    return F.regexp_replace(F.concat(F.rtrim(col(root), F.lit("/")), F.lit("/"), col(template)), "/{2,}", "/")


def last_name(name: Column | str) -> Column:
    """The last part of a qualified name without type marks."""
    return F.regexp_replace(F.element_at(F.split(col(name), r"::|\."), -1), r"[?\[\]<>]+$", "")


def uuids(text: Column | str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(UUID), F.lit(0))


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """``prefix:`` and 20 hex digits over the parts, joined by NUL; a null part counts as empty."""
    joined = F.concat_ws("\0", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(joined, 256), 1, 20))


def version_key(version: Column | str) -> Column:
    """The numbers of a version, for ordering."""
    return F.transform(F.regexp_extract_all(col(version), F.lit(r"\d+"), F.lit(0)), lambda n: n.cast("int"))


def instant(text: Column | str) -> Column:
    """ISO-8601 with a zone, as a timestamp; null without one."""
    return F.when(col(text).rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(col(text)))


def pseudonym(value: Column | str) -> Column:
    return F.concat(F.lit("[USER:"), F.substring(F.sha2(col(value).cast("string"), 256), 1, 10), F.lit("]"))


def redact(text: Column | str, limit: int | None = None) -> Column:
    """Hides credentials, assigned secrets and e-mail addresses, gives user ids a pseudonym, and only then cuts.

    Every user id gets its own pseudonym: the text is divided at the ids' keys, and the head of each part but the first is an id.
    """
    x = F.regexp_replace(col(text), rf"(?i)\b({SCHEMES})\s+{TOKEN68}", f"$1 {HIDDEN}")
    x = F.regexp_replace(x, rf"(?i)({SECRET_NAMES})(\s*[:=]\s*)([^\s,;]+)", f"$1$2{HIDDEN}")
    x = F.regexp_replace(x, rf"(?i)(?<![a-z0-9]){ATOM}(?:\.{ATOM})*@(?:{LABEL}\.)+[a-z]{{2,}}(?![a-z0-9\-])", EMAIL)
    keys, parts = F.regexp_extract_all(x, F.lit(USER_KEY), F.lit(0)), F.split(x, USER_KEY)
    value = r"^[^\s,;\]}]+"

    def renamed(part: Column, key: Column) -> Column:
        found = F.regexp_extract(part, value, 0)
        return F.concat(key, F.when(found == "", part).otherwise(F.concat(pseudonym(found), F.regexp_replace(part, value, ""))))

    tail = F.zip_with(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), keys, renamed)
    x = F.when(F.size(keys) > 0, F.concat(parts[0], F.array_join(tail, ""))).otherwise(x)
    return F.substring(x, 1, limit) if limit else x


def redact_external(text: Column | str, limit: int = 2000) -> Column:
    """Three kinds of secrets in text from outside: authorisation headers, assignments and signed tokens."""
    x = F.regexp_replace(col(text), r"(?i)(authorization\s*[:=]\s*)\S+(\s+\S+)?", f"$1{HIDDEN}")
    x = F.regexp_replace(x, rf"(?i)({SECRET_NAMES}|token|secret)(\s*[:=]\s*)([^\s,;]+)", f"$1$2{HIDDEN}")
    x = F.regexp_replace(x, r"\beyJ[\w-]+\.[\w-]+\.[\w-]+", HIDDEN)
    return F.substring(x, 1, limit)


def utf16_offset(line: Column | str, column: Column) -> Column:
    """Offset in UTF-16 units of a 1-based column."""
    head = F.substring(col(line), F.lit(1), column - 1)
    return (F.octet_length(F.encode(head, "UTF-16LE")) / 2).cast("int")
