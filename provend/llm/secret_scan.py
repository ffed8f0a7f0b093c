"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions at the hits, checksum validation.

One pass of an Aho-Corasick automaton over the lower-cased text gives every
place of a keyword. The rule of that keyword is tried there and nowhere else,
anchored at the hit, so a text without keywords costs the one pass. Rules whose
tokens carry their own check value (a CRC32 in base 62, a decodable header, a
DER length, the lengths in an OpenSSH key) accept a match only if the value is right.
An encrypted key with header lines has no value to check; its body must be base64. Lines
of a key may be parted by escaped line breaks, as in JSON. Runs of hex digits have
no keyword; they are found by a plain run search.

The three base kinds follow their definition exactly: leftmost non-overlapping
matches of the whole expression, then those too short are dropped, so a short
match still uses up its place.

Defined cases: a null text counts as empty and has no spans; an id may be null
or repeated, each row stands for itself; positions are code points, end
exclusive; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import string
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base kinds in their order, then the kinds of this scanner.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]*(?:(\.)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*)?")
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"
                 r"((?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----|\\[nr])[^\r\n])*+)*+)"  # header lines
                 r"((?:[A-Za-z0-9+/=\s]|\\[nr])++)-----END (?:[A-Z]+ )*PRIVATE KEY-----")
ENCRYPTED = re.compile(r"(?:^|\s|\\[nr])Proc-Type:[ \t]*4[ \t]*,[ \t]*ENCRYPTED")
LINE_BREAKS = re.compile(r"\s|\\[nr]")
OPENSSH = b"openssh-key-v1\0"
OPENSSH_TAGS = {b"aes128-gcm@openssh.com": 16, b"aes256-gcm@openssh.com": 16, b"chacha20-poly1305@openssh.com": 16}

BASE62 = string.digits + string.ascii_uppercase + string.ascii_lowercase
ASCII_LOWER = {ord(c): c.lower() for c in string.ascii_uppercase}


def base62_crc32(body: str) -> str:
    """The six base-62 digits of the CRC32 that GitHub and npm tokens end with."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _crc_ok(m: re.Match) -> bool:
    return base62_crc32(m[1]) == m[2]


def _jwt_ok(m: re.Match) -> bool:
    if not m[1]:
        return False
    head = m[0].split(".", 1)[0]
    try:
        value = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return False
    return isinstance(value, dict) and "alg" in value


def _pem_ok(m: re.Match) -> bool:
    """The body is base64 of one DER sequence or OpenSSH key whose stated lengths are those it has, or encrypted."""
    try:
        der = base64.b64decode(LINE_BREAKS.sub("", m[2]), validate=True)
    except (binascii.Error, ValueError):
        return False
    if ENCRYPTED.search(m[1]):
        return len(der) > 0
    if der.startswith(OPENSSH):
        return _openssh_ok(der)
    if len(der) < 2 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return 0 < n <= 4 and len(der) == 2 + n + int.from_bytes(der[2:2 + n], "big")


def _openssh_ok(key: bytes) -> bool:
    """Cipher, key derivation and its options, number of keys, each public key, private part; some ciphers add a tag."""
    at = len(OPENSSH)

    def number() -> int:
        nonlocal at
        at += 4
        return int.from_bytes(key[at - 4:at], "big")

    def field() -> bytes:
        nonlocal at
        n = number()
        at += n
        return key[at - n:at]

    cipher, _, _, keys = field(), field(), field(), number()
    while keys > 0 and at < len(key):
        field()
        keys -= 1
    private = field()
    return keys == 0 and len(private) > 0 and len(key) == at + OPENSSH_TAGS.get(cipher, 0)


#: keyword (lower case) -> kind, anchored expression, validation of the match
RULES = {
    **{w: ("assign", ASSIGN, lambda m: len(m[2]) >= 12) for w in
       ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", ACCESS, lambda m: len(m[0]) >= 18),
    **{w: ("github", GITHUB, _crc_ok) for w in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")},
    "npm_": ("npm", NPM, _crc_ok),
    "eyj": ("jwt", JWT, _jwt_ok),
    "-----begin ": ("pem", PEM, _pem_ok),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in RULES:
        a.add_word(word, word)
    a.make_automaton()
    return a


def find_spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start and then the order of ``KINDS``."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters lower-case to two; keep positions
        low = text.translate(ASCII_LOWER)
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    free: dict[str, int] = {}  # by kind: the end of its last match
    for at, word in sorted((end + 1 - len(w), w) for end, w in automaton.iter(low)):
        kind, rule, valid = RULES[word]
        if at < free.get(kind, 0):
            continue
        if m := rule.match(text, at):
            free[kind] = m.end()
            if valid(m):
                out.append((at, m.end(), kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(text):
    """Column of the spans found in a text column: array<struct<kind, start, end>>."""
    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        a = _automaton()
        return pa.array([[{"kind": k, "start": s, "end": e} for s, e, k in find_spans(t, a)]
                         for t in texts.to_pylist()], SPAN)
    return spans(text)


def redacted(text):
    """Column of the text with every secret replaced by ``[SECRET]``; overlapping spans become one; null stays null."""
    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        a, out = _automaton(), []
        for t in texts.to_pylist():
            parts, at = [], 0
            merged: list[list[int]] = []
            for s, e, _ in find_spans(t, a):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            for s, e in merged:
                parts += [t[at:s], "[SECRET]"]
                at = e
            out.append(t if not merged else "".join([*parts, t[at:]]))
        return pa.array(out, pa.string())
    return clean(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's id and its spans. One map over the texts, no exchange."""
    return docs.select(F.col(id_col).alias("doc_id"), secret_spans(F.col(text_col)).alias("found"))


def _listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: counts, the digest of the base spans and the list of all spans for every document."""
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return (scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
            .select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                    count("hex").alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"),
                    _listed(F.col("found")).alias("spans")))
