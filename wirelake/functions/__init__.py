"""Scalar functions: text to values and back, and the byte-exact regular expression test."""

from wirelake.ftypes import decode, from_text, interval_text, ipv6_decimal, ipv6_decimals, literal, occurrences
from wirelake.regexes import for_jvm, validate, wants_bytes

__all__ = ["decode", "for_jvm", "from_text", "interval_text", "ipv6_decimal", "ipv6_decimals", "literal", "occurrences", "validate", "wants_bytes"]
