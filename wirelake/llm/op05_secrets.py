"""Secret scan: Aho-Corasick keyword prefilter, anchored regular expressions near hits, checksums."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelake.llm.common import extra_aside, give_back, only

_BECH = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_B58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_B62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc32_base62(secret: bytes) -> bool:
    """The last six characters are the CRC-32 of the 30 that follow the prefix, in base 62 (GitHub and npm tokens)."""
    body, check = secret[-36:-6], secret[-6:]
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _B62[d : d + 1] + out
    return out == check


def jwt_header(secret: bytes) -> bool:
    try:
        head = secret.split(b".")[0]
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def pem_body(secret: bytes) -> bool | None:
    """The base64 body decodes to a DER sequence of the length that its header states, or to an OpenSSH key; None if it is encrypted by headers."""
    lines = re.sub(rb"\\+[nrt]", b"\n", re.sub(rb"-----[^-]+-----", b"", secret)).replace(b"\\/", b"/")
    if re.search(rb"(?m)^\s*DEK-Info:", lines):
        return None
    body = b"".join(re.sub(rb"(?m)^\s*[A-Za-z][0-9A-Za-z-]*:.*$", b"", lines).split())
    try:
        der = base64.b64decode(body, validate=True)
    except (binascii.Error, ValueError):
        return False
    if der.startswith(b"openssh-key-v1\0"):
        return True
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    k = der[1] & 0x7F
    return k <= 4 and len(der) == 2 + k + int.from_bytes(der[2 : 2 + k], "big")


def base64_key(secret: bytes) -> bool:
    """The base64 is that of 64 bytes, without stray bits in its last digit."""
    try:
        return base64.b64encode(base64.b64decode(secret, validate=True)) == secret and len(base64.b64decode(secret)) == 64
    except (binascii.Error, ValueError):
        return False


def pypi_macaroon(secret: bytes) -> bool:
    """The token decodes to a macaroon of version 2 whose location is the package index."""
    body = secret.removeprefix(b"pypi-")
    try:
        x = base64.urlsafe_b64decode(body + b"=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return False
    return x.startswith((b"\x02\x01\x08pypi.org", b"\x02\x01\x0dtest.pypi.org"))


def bech32(secret: bytes) -> bool:
    """The Bech32 checksum in the last six digits."""
    text = secret.lower()
    at = text.rfind(b"1")
    digits = [_BECH.find(c) for c in text[at + 1 :]]
    check = 1
    for v in [*(c >> 5 for c in text[:at]), 0, *(c & 31 for c in text[:at]), *digits]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return min(digits) >= 0 and check == 1


def base58_check(secret: bytes) -> bool:
    """The last four of the bytes in base 58 are the start of the others' double SHA-256."""
    n = 0
    for c in secret:
        n = n * 58 + _B58.find(c)
    x = n.to_bytes((len(secret) * 733 + 999) // 1000, "big").lstrip(b"\0")
    return len(x) > 4 and hashlib.sha256(hashlib.sha256(x[:-4]).digest()).digest()[:4] == x[-4:]


def aws_account(secret: bytes) -> bool:
    """The identifier's base-32 digits hold a twelve-digit account number; of chance identifiers this rules out one in eleven only."""
    try:
        x = base64.b32decode(secret[4:20])
    except (binascii.Error, ValueError):
        return False
    return ((int.from_bytes(x[:6], "big") & 0x7FFFFFFFFF80) >> 7) < 10**12


class Rule(NamedTuple):
    """A kind of secret: the pattern is matched where a keyword begins, in bytes; its group is the secret (all if there is none).

    ``check`` names a function that validates what the secret embeds; a secret whose check fails isn't reported. ``whole`` tells that no
    letter or digit may stand before the keyword. ``run`` is the class of the bytes that a secret and its surroundings are made of: where a
    match fails, keywords further on in the same run would fail for the same reason and are skipped, but for those in its last ``tail``
    bytes. So a run full of keywords is read once, not once for each of them.
    """

    name: str
    keywords: tuple[str, ...]
    pattern: bytes
    check: str | None = None
    whole: bool = True
    run: bytes | None = None
    tail: int = 0


_END = rb"(?![0-9A-Za-z])"
_URLSAFE = rb"[0-9A-Za-z_\-]"
#: What a value without quotes may hold.
_PLAIN = rb"""[^\s"'<>(){}\[\],;\\]"""
RULES: tuple[Rule, ...] = (
    Rule("github-token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), rb"gh[pousr]_[0-9A-Za-z]{36}" + _END, "crc32_base62"),
    Rule("github-fine-grained-token", ("github_pat_",), rb"github_pat_[0-9A-Za-z]{22}_[0-9A-Za-z]{59}" + _END),
    Rule("npm-token", ("npm_",), rb"npm_[0-9A-Za-z]{36}" + _END, "crc32_base62"),
    Rule("pypi-token", ("pypi-",), rb"pypi-[0-9A-Za-z_\-]{64,}+", "pypi_macaroon"),
    Rule("aws-access-key", ("akia", "asia"), rb"(?:AKIA|ASIA)[A-Z2-7]{16}" + _END, "aws_account"),
    Rule("azure-storage-key", ("accountkey=",), rb"(?i:AccountKey)=([0-9A-Za-z+/]{86}==)", "base64_key", whole=False),
    Rule("google-api-key", ("aiza",), rb"AIza[0-9A-Za-z_\-]{35}" + _END),
    Rule("google-client-secret", ("gocspx-",), rb"GOCSPX-[0-9A-Za-z_\-]{28}" + _END),
    Rule("slack-token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), rb"xox[bpars]-[0-9A-Za-z\-]{10,}+"),
    Rule("slack-webhook", ("hooks.slack.com/services/",), rb"hooks\.slack\.com/services/T[0-9A-Z]{8,}/B[0-9A-Z]{8,}/[0-9A-Za-z]{24}" + _END, whole=False),
    Rule("stripe-key", ("sk_live_", "rk_live_"), rb"[sr]k_live_[0-9A-Za-z]{20,}+"),
    Rule("sendgrid-key", ("sg.",), rb"SG\.[0-9A-Za-z_\-]{22}\.[0-9A-Za-z_\-]{43}" + rb"(?![0-9A-Za-z_\-])"),
    Rule("twilio-key", tuple(f"sk{x:x}" for x in range(16)), rb"SK[0-9a-f]{32}" + _END),
    Rule("gitlab-token", ("glpat-",), rb"glpat-[0-9A-Za-z_\-]{20,}+"),
    Rule("digitalocean-token", ("dop_v1_", "doo_v1_", "dor_v1_"), rb"do[por]_v1_[0-9a-f]{64}" + _END),
    Rule("shopify-token", ("shpat_", "shpca_", "shppa_", "shpss_"), rb"shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}" + _END),
    Rule("databricks-token", ("dapi",), rb"dapi[0-9a-f]{32}" + _END),
    Rule("huggingface-token", ("hf_",), rb"hf_[A-Za-z]{34}" + _END),
    Rule("age-key", ("age-secret-key-1",), rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}" + _END, "bech32"),
    Rule("extended-private-key", ("xprv",), rb"xprv[1-9A-HJ-NP-Za-km-z]{107}" + _END, "base58_check"),
    # the first eyJ of a run of its characters begins the token
    Rule("json-web-token", ("eyj",), rb"eyJ[0-9A-Za-z_\-]{10,}+\.eyJ[0-9A-Za-z_\-]{10,}+\.[0-9A-Za-z_\-]{10,}+", "jwt_header", run=_URLSAFE),
    # line ends may be escaped (JSON), header lines (Proc-Type, DEK-Info) may come before the body
    Rule("private-key", ("-----begin",), rb"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:\s|\\+[nrt])*+(?:[A-Za-z][0-9A-Za-z\-]*+:(?:(?!-----)[^\r\n\\])*+(?:[\r\n]|\\+[nr])+[ \t]*)*+(?:[\s0-9A-Za-z+/=]|\\+[nrt/]){40,}+-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----", "pem_body", whole=False),
    Rule("url-password", ("://",), rb"://[^\s/?#:@\"'<>]*+:([^\s/?#@\"'<>]{3,}+)@", whole=False),
    # the keyword may have suffixes (SECRET_KEY); a value without quotes ends at white space, a comma, a semicolon or the text's end
    Rule("assigned-secret", ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key"), rb"""(?i:token|secret|password|passwd|api[_-]?key|access_key)(?:[_\-][0-9A-Za-z]{1,32}){0,4}(?:\\?["'])?\s{0,3}(?:=>|=|:)\s{0,3}(?:\\?["'](""" + _PLAIN + rb"""{16,}+)(?=\\?["'])|(""" + _PLAIN + rb"""{16,}+)(?=[\s,;]|\Z))""", whole=False, run=_PLAIN, tail=200),
)
CHECKS = {f.__name__: f for f in (crc32_base62, jwt_header, pem_body, aws_account, base64_key, pypi_macaroon, bech32, base58_check)}
_WORD = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


class Finder:
    """Finds the secrets of a text; one automaton holds the keywords of all rules."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern), re.compile(r.run + rb"*+") if r.run else None) for r in rules]
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(rules):
            for w in r.keywords:
                by_word.setdefault(w.lower(), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w, at in by_word.items():
            self.automaton.add_word(w, (len(w), at))
        if by_word:
            self.automaton.make_automaton()

    def find(self, data: bytes) -> list[tuple[int, int, str, str]]:
        """(start, end, rule, check) in bytes, in order, without overlaps: the earlier start wins, then the longer, then the earlier rule.

        What begins inside a secret of the same rule isn't looked at.
        """
        if not self.rules or not len(self.automaton):
            return []
        found = []
        free = [0] * len(self.rules)
        # One character for each byte, ASCII in lower case: offsets are those of the bytes.
        for last, (length, at) in self.automaton.iter(data.lower().decode("latin-1")):
            start = last - length + 1
            for i in at:
                rule, pattern, run = self.rules[i]
                if start < free[i] or rule.whole and start and data[start - 1] in _WORD:
                    continue
                good = False
                if m := pattern.match(data, start):
                    a, b = m.span(m.lastindex or 0)
                    good = None if rule.check is None else CHECKS[rule.check](data[a:b])
                if good is False:
                    if run:
                        free[i] = max(start + 1, run.match(data, start).end() - rule.tail)
                    continue
                free[i] = b
                found.append((a, -b, i, "none" if good is None else "valid"))
        out, after = [], 0
        for a, b, i, check in sorted(found):
            if a >= after:
                out.append((a, -b, self.rules[i][0].name, check))
                after = -b
        return out


def findings(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, rule, start, end, checksum, digest): the secrets of all texts; start and end count characters, digest is the start of the secret's SHA-256.

    checksum is valid for kinds of secrets that embed one (what doesn't fit it isn't returned), else none. Secrets have no greatest length. Nulls: null and empty texts have no row; a null doc_id is
    returned as null. Repeated rows give their findings again. Whole texts are scanned, of any length. Of overlapping secrets the earlier is
    returned. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(rules)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                for a, b, rule, check in finder.find(data):
                    start = len(data[:a].decode("utf-8", "surrogatepass"))
                    rows.append((doc_id, rule, start, start + len(data[a:b].decode("utf-8", "surrogatepass")), check, hashlib.sha256(data[a:b]).hexdigest()[:16]))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()))], ["doc_id", "rule", "start", "end", "checksum", "digest"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, rule string, start int, end int, checksum string, digest string")


def redact(text: str, finder: Finder) -> str:
    data = text.encode("utf-8", "surrogatepass")
    out, free = [], 0
    for a, b, rule, _ in finder.find(data):
        out += [data[free:a], b"<", rule.upper().encode(), b">"]
        free = b
    return text if not out else b"".join([*out, data[free:]]).decode("utf-8", "surrogatepass")


@extra_aside("text", "n_chars")
def redacted(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with each secret of its texts replaced by its rule's name in angle brackets and ``n_chars``, if there is such a column, set to the new length where the text changed.

    All rows and columns stay, whatever the columns' names. Nulls: null texts stay null, a null doc_id or n_chars is as good as any (n_chars
    is set where the text changed). Empty texts stay empty; texts of any length are scanned whole; repeated rows are changed alike. An empty
    table gives an empty result.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(rules)
        for s in texts:
            yield s.map(lambda t: None if t is None else redact(t, finder))
            give_back()

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = docs.withColumn("__clean", F.pandas_udf(run, "string")("text"))
    if "n_chars" in docs.columns:
        # texts that didn't change keep the length that the table states
        n = F.char_length("__clean").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__clean").isNull() | (F.col("__clean") == F.col("text")), F.col("n_chars")).otherwise(n))
    return out.withColumn("text", F.col("__clean")).select(*docs.columns)


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_secret_scan": op5_secret_scan}
ORACLE: dict[str, str] = {}
