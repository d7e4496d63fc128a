"""Scalar column functions: masking, identity, randomness, checksums, decoding.

Everything here is a composition of built-in functions and stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesieve.catalog.rules import COMMON_BIGRAMS, LANGUAGE_SHARE, PLACEHOLDER_CONTEXT, VENDOR_EXAMPLES

CONTROL_CHARS = r"[\x00-\x1f\x7f]"
INVISIBLE_CHARS = r"[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{E0000}-\x{E007F}]"
FINGERPRINT_PATTERN = r"\A(?:rf1-[0-9a-f]{32})\z"
LINE_END = r"\r\n|\n|\r"
# Looks ahead for the second letter, so that pairs may overlap.
_COMMON_PAIR = "|".join(f"{a}(?=[{''.join(b[1] for b in COMMON_BIGRAMS if b[0] == a)}])" for a in sorted({b[0] for b in COMMON_BIGRAMS}))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def without_line_end(text: Column) -> Column:
    """Text without its final line end."""
    single = text.endswith("\n") | text.endswith("\r")
    return (F.when(text.endswith("\r\n"), F.left(text, F.length(text) - 2))
            .when(single, F.left(text, F.length(text) - 1)).otherwise(text))


def split_lines(text: Column) -> Column:
    """Array of what stands between line ends; without a carriage return no regular expression walks the text."""
    return bind(text, lambda t: F.when(F.contains(t, F.lit("\r")), F.split(t, LINE_END, -1)).otherwise(F.split(t, "\n", -1)))


def strip_control_chars(text: Column) -> Column:
    """Remove C0 control characters and DEL, so a preview cannot drive a terminal."""
    return F.regexp_replace(text, CONTROL_CHARS, "")


def redact(value: Column) -> Column:
    """Masked preview: first and last four characters, or only stars when short."""
    def masked(clean: Column) -> Column:
        size = F.length(clean)
        return (F.when(size <= 10, F.repeat(F.lit("*"), size))
                .otherwise(F.concat(F.substring(clean, 1, 4), F.lit("…"), F.right(clean, F.lit(4)),
                                    F.lit("  ("), size.cast("string"), F.lit(" chars)"))))

    return bind(strip_control_chars(value), masked)


def basename(path: Column) -> Column:
    """The last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def fingerprint(rule_id: Column, preview: Column, rel_file: Column) -> Column:
    """Stable identity of a finding, made of redacted material only.

    The line number is left out on purpose: appending to a file must not change
    the identity of what was found in it before.
    """
    parts = [F.coalesce(c, F.lit("")) for c in (rule_id, preview, rel_file)]
    return F.concat(F.lit("rf1-"), F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(32)))


def is_vendor_example(value: Column) -> Column:
    """Is the whole value a credential that a vendor prints in its documentation?"""
    return value.isin(*VENDOR_EXAMPLES)


def has_constant_tail(value: Column) -> Column:
    """Do the last twelve characters repeat one character?"""
    return (F.length(value) >= 12) & (F.right(value, F.lit(12)) == F.repeat(F.right(value, F.lit(1)), F.lit(12)))


def has_constant_head(value: Column) -> Column:
    """Do the first twelve characters repeat one character?"""
    return (F.length(value) >= 12) & (F.left(value, F.lit(12)) == F.repeat(F.left(value, F.lit(1)), F.lit(12)))


def is_placeholder_context(before: Column) -> Column:
    """Does the text in front of a match announce an example?"""
    return before.rlike("(?i)" + PLACEHOLDER_CONTEXT)


def bigram_fraction(value: Column) -> Column:
    """Share of adjacent a-z pairs that are frequent in English; 0 without pairs."""
    low = F.lower(value)
    pairs = F.coalesce(F.regexp_count(low, F.lit(r"[a-z](?=[a-z])")), F.lit(0))
    common = F.regexp_count(low, F.lit(_COMMON_PAIR))
    return F.when(pairs == 0, F.lit(0.0)).otherwise(common / pairs)


def is_random(value: Column) -> Column:
    """Does the value read as machine-made rather than as language?"""
    return bigram_fraction(value) < LANGUAGE_SHARE


def luhn_valid(value: Column) -> Column:
    """Card number check: 13-19 digits after removing separators, Luhn sum 0 mod 10."""
    digits = F.regexp_replace(value, "[ -]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_valid(value: Column) -> Column:
    """ISO 7064 MOD 97-10 over the rearranged account number."""
    moved = F.concat(F.substring(value, 5, 100), F.left(value, F.lit(4)))
    # 'A'..'Z' stand for 10..35, so a letter shifts the remainder by two digits.
    remainder = F.aggregate(
        F.split(moved, ""),
        F.lit(0),
        lambda acc, ch: F.when(
            ch.rlike("[A-Z]"), (acc * 100 + F.ascii(ch) - 55) % 97).otherwise(
            F.when(ch == "", acc).otherwise((acc * 10 + F.ascii(ch) - 48) % 97)))
    return F.length(value).between(15, 34) & value.rlike(r"\A[A-Z0-9]+\z") & (remainder == 1)


def base64_bytes(encoded: Column) -> Column:
    """Strict decode of base64 or base64url with optional padding, else NULL.

    Strict means that encoding the bytes again gives the same text, which also
    rejects trailing bits that a canonical encoder would not produce.
    """
    def decode(standard: Column) -> Column:
        # A remainder of one character cannot come from whole bytes.
        decodable = (F.length(standard) > 0) & (F.length(standard) % 4 != 1) & standard.rlike(r"\A[A-Za-z0-9+/]+\z")
        padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), "=")
        raw = F.when(decodable, F.try_to_binary(padded, F.lit("base64")))
        return bind(raw, lambda r: F.when(F.rtrim(F.replace(F.base64(r), F.lit("\r\n"), F.lit("")), F.lit("=")) == standard, r))

    plain = F.replace(F.replace(encoded, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    return bind(F.rtrim(plain, F.lit("=")), decode)


def jwt_expires_at_ms(token: Column) -> Column:
    """The ``exp`` claim of a JWT in epoch milliseconds, NULL if it has none."""
    parts = F.split(token, r"\.")
    body = F.regexp_replace(F.translate(F.get(parts, 1), "-_", "+/"), r"=+\z", "")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")
    payload = F.try_to_binary(padded, F.lit("base64")).cast("string")
    exp = F.try_variant_get(F.try_parse_json(payload), "$.exp", "variant")
    is_number = F.schema_of_variant(exp).rlike("BIGINT|DECIMAL|DOUBLE|FLOAT")
    # The claim is in seconds and may carry a fraction.
    millis = F.round(F.try_variant_get(F.try_parse_json(payload), "$.exp", "double") * 1000).cast("bigint")
    return F.when((F.size(parts) == 3) & F.is_valid_utf8(payload) & is_number, millis)


def version_triple(version: Column) -> Column:
    """Leading ``major.minor.patch`` as an array of numbers, else NULL.

    Arrays compare element by element, so the result can be used with ``<``.
    """
    found = F.regexp_extract_all(F.trim(version), F.lit(r"\Av?([0-9]+)\.([0-9]+)\.([0-9]+)"), F.lit(0))
    digits = F.split(F.regexp_replace(F.get(found, 0), "v", ""), r"\.")
    return F.when(F.size(found) > 0, F.transform(digits, lambda d: d.try_cast("bigint")))


def escape_invisibles(text: Column) -> Column:
    """Show zero-width characters as ``\\u{HEX}``."""
    def spelled(t: Column) -> Column:
        pieces = F.regexp_extract_all(t, F.lit(rf"[\s\S](?<!{INVISIBLE_CHARS})|{INVISIBLE_CHARS}"), F.lit(0))
        shown = F.transform(pieces, lambda ch: F.when(
            ch.rlike(INVISIBLE_CHARS), F.concat(F.lit(r"\u{"), F.hex(F.ascii(ch)), F.lit("}"))).otherwise(ch))
        return F.when(t.rlike(INVISIBLE_CHARS), F.array_join(shown, "")).otherwise(t)

    return bind(text, spelled)


def truncate(text: Column, limit: int) -> Column:
    """Cut long display text and mark the cut."""
    return bind(text, lambda t: F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit)), F.lit("…"))).otherwise(t))
