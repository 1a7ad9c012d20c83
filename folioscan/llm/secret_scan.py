"""Secrets in texts: a keyword automaton first, anchored patterns where it hits, then embedded checksums.

An Aho-Corasick automaton reads each text once for the words by which secrets
are known; a pattern is tried only where one of its words begins. Tokens that
carry a checksum count only if it is right, so they need no other evidence.
Runs of hexadecimal digits have no word, and one pattern looks for them.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("assign", "access", "hex")

# The alphabets of these encodings.
_BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
# Fixed value: the generator of the Bech32 checksum.
_BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)


def crc_holds(token: bytes) -> bool:
    """Whether the last six characters are the CRC-32, in base 62, of what stands between the underscore and them."""
    body, given = token[token.index(b"_") + 1 : -6], token[-6:]
    value, digits = zlib.crc32(body), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_BASE62[digit])
    return bytes(reversed(digits)) == given


def base58_holds(token: bytes) -> bool:
    """Whether a Base58Check value of 82 bytes ends with the first four bytes of its double SHA-256."""
    value = 0
    for c in token:
        value = value * 58 + _BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_holds(token: bytes) -> bool:
    """Whether the checksum of a Bech32 value is right; it is of one case throughout."""
    if token.lower() != token and token.upper() != token:
        return False
    name, _, data = token.lower().rpartition(b"1")
    check = 1
    for value in [*(c >> 5 for c in name), 0, *(c & 31 for c in name), *(_BECH32.index(c) for c in data)]:
        top = check >> 25
        check = (check & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate(_BECH32_GENERATOR):
            if top >> i & 1:
                check ^= g
    return check == 1


@dataclass(frozen=True)
class Rule:
    """A kind of secret: the words it begins with (lower case), its pattern, and what a match must pass."""

    kind: str
    words: tuple[str, ...]
    pattern: re.Pattern
    passes: Callable[[re.Match], bool]


_SAME = rb"(?![A-Za-z0-9_])"
#: In the order in which spans of one start are given. The first two are base kinds; the others need their checksum.
RULES = (
    Rule("assign", ("password", "passwd", "secret", "token", "apikey", "api_key"), re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[1]) >= 6),
    Rule("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("github", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}" + _SAME), lambda m: crc_holds(m[0])),
    Rule("npm", ("npm_",), re.compile(rb"npm_[A-Za-z0-9]{36}" + _SAME), lambda m: crc_holds(m[0])),
    Rule("xprv", ("xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}" + _SAME), lambda m: base58_holds(m[0])),
    Rule("age", ("age-secret-key-1",), re.compile(rb"(?i:AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58})" + _SAME), lambda m: bech32_holds(m[0])),
    Rule("nsec", ("nsec1",), re.compile(rb"(?i:nsec1[02-9AC-HJ-NP-Z]{58})" + _SAME), lambda m: bech32_holds(m[0])),
)
KINDS = (*BASE, *(r.kind for r in RULES if r.kind not in BASE))
_HEX = re.compile(rb"[0-9a-f]{24,}")


@dataclass
class Scanner:
    """Finds the secrets of one text after another."""

    rules: tuple[Rule, ...] = RULES
    automaton: object = field(init=False)

    def __post_init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, rule in enumerate(self.rules):
            for word in rule.words:
                self.automaton.add_word(word, (i, len(word) - 1))
        self.automaton.make_automaton()

    def spans(self, raw: bytes) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in bytes, sorted; of each kind from the left, none over another."""
        hits: dict[int, list[int]] = {}
        # ASCII letters alone change case in bytes, so places stay
        for last, (i, before) in self.automaton.iter(raw.lower().decode("latin-1")):
            hits.setdefault(i, []).append(last - before)
        found = [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(raw)]
        for i, starts in hits.items():
            rule, end = self.rules[i], 0
            for start in sorted(starts):
                if start < end:
                    continue
                if m := rule.pattern.match(raw, start):
                    if rule.kind in BASE:
                        # a base match that is too short still takes its place
                        end = m.end()
                        if rule.passes(m):
                            found.append((start, KINDS.index(rule.kind), end))
                    elif rule.passes(m):
                        end = m.end()
                        found.append((start, KINDS.index(rule.kind), end))
        return sorted(found)


def in_code_points(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans with offsets in code points; the bytes are gone through once."""
    if not spans or raw.isascii():
        return spans
    at = last = 0
    place = {}
    for x in sorted({p for a, _, b in spans for p in (a, b)}):
        at += len(raw[last:x].decode("utf-8", "replace"))
        place[x], last = at, x
    return [(place[a], k, place[b]) for a, k, b in spans]


_scanners: dict[str, Scanner] = {}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: the id column and spans, an array of (kind, start, end) by start, then kind.

    Offsets are code points, ends exclusive. Base kinds are assign (a word for
    a secret, a sign and a value of 6 or more characters; the span covers all
    of it), access (AKIA, 20 or more characters) and hex (24 or more digits).
    Besides, github and npm tokens (CRC-32 in base 62), xprv keys (Base58Check),
    age and nsec keys (Bech32) count where their checksum is right and no
    further letter or digit follows. Spans of different kinds may overlap.

    One projection without an exchange. A null or empty text has no spans; a
    null id, equal ids and repeated rows stay as they are. Other columns are
    not read, whatever their names. An empty table gives no rows.
    """
    if id_col == "spans":
        raise ValueError("the result has a column spans of its own")
    kind = docs.schema[id_col].dataType.simpleString()
    shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "all" not in _scanners:
            _scanners["all"] = Scanner()
        scanner = _scanners["all"]
        for batch in batches:
            bodies = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            rows = []
            for body in bodies:
                raw = body.as_py()
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in in_code_points(raw, scanner.spans(raw))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, shape)], names=["id", "spans"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return found.withColumnRenamed("id", id_col)


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with each run of overlapping spans replaced by ``mask``."""
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        done = F.when(s["start"] >= state["at"], F.concat(state["done"], gap, F.lit(mask))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.greatest(state["at"], s["end"]).alias("at"))

    return F.aggregate(spans, begin, step, lambda s: F.concat(s["done"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))
