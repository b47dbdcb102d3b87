"""Secrets in text: fixed patterns, and literals assigned to names that sound secret.

The lexer reads source and configuration syntax into name-literal pairs
(``name = "literal"``, ``name: literal``, ``"name" => 'literal'``, ``NAME=literal``,
``<name>literal</name>``, triple quotes, YAML blocks, and PEM blocks, whose label is the
name), remembers the literal of each plain name, and follows names that
are assigned to other names.  A literal counts when the name it reaches is sensitive and the
literal looks random enough for that name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import map_rows, schema_of

#: The patterns of the base kinds, and the shortest match of each.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SHORTEST_ASSIGN, SHORTEST_ACCESS = 6, 20

#: How far a part of a name speaks for a secret, from 0 to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 0.9, "credential": 0.8, "credentials": 0.8,
    "token": 0.8, "apikey": 1.0, "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "authkey": 0.9, "auth": 0.5,
    "bearer": 0.7, "signature": 0.4, "salt": 0.5, "key": 0.4, "session": 0.4, "cookie": 0.4, "dsn": 0.4, "webhook": 0.4,
}
#: Parts that turn a sensitive name into a harmless one, such as max_tokens or key_id.
HARMLESS = {"id", "name", "count", "max", "min", "length", "len", "size", "type", "path", "file", "url", "field", "label", "limit", "num", "index"}
#: A literal is reported from this product of the name's weight and the literal's randomness on.
THRESHOLD = 0.35
#: A text whose letters in a row hold none of these has no sensitive name; plain searches are far quicker than the patterns.
_HINTS = tuple(n.encode() for n in SENSITIVE if not any(other != n and other in n for other in SENSITIVE))
#: What may stand in a name between or within its parts.
_BETWEEN = b"0123456789_.-"
#: A run of 24 holds eight places in a row of every third character.
_HEX_THIRDS = re.compile(r"[0-9a-f]{8}")
_PAIR = re.compile(
    r"""(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,79})(?P=quote)[ \t]*(?:=>|:=|[:=](?!=))[ \t]*"""
    r"""(?:\"{3}(?P<triple>(?s:.+?))\"{3}|'{3}(?P<triples>(?s:.+?))'{3}"""
    r"""|"(?P<double>[^"\n]+)"|'(?P<single>[^'\n]+)'|(?P<bare>[^\s"'<>,;(){}\[\]]+))"""
    r"""|<(?P<tag>[A-Za-z_][A-Za-z0-9_.-]{0,79})>(?P<inner>[^<>\n]+)</(?P=tag)>"""
)
#: A YAML block: all lines indented deeper than its name.
_BLOCK = re.compile(
    r"""^(?P<indent>[ \t]*)(?:-[ \t]+)?(?P<quote>["']?)(?P<name>[A-Za-z_][A-Za-z0-9_.-]{0,79})(?P=quote)[ \t]*:[ \t]*[|>][0-9+-]{0,2}[ \t]*\r?\n"""
    r"""(?P<block>(?:(?P=indent)[ \t]+\S[^\n]*(?:\n|\Z)|[ \t\r]*\n)+)""",
    re.MULTILINE,
)
#: A PEM block ends with its last line, or where the text ends.
_PEM = re.compile(r"-----BEGIN (?P<name>(?:[A-Z0-9]+ ){0,9}PRIVATE KEY(?: BLOCK)?)-----(?P<pem>[^-]+(?:-(?!----)[^-]*)*)")
_KINDS = ("triple", "triples", "double", "single", "bare", "inner", "block", "pem")
#: Longer literals of harmless names, as those in triple quotes, may hold pairs of their own.
LONG = 512
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def sensitivity(name: str) -> float:
    """Weight of a name by its parts in snake, kebab, dotted or camel case."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or HARMLESS & set(parts):
        return 0.0
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return max((SENSITIVE.get(p, 0.0) for p in (*parts, *joined)), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy per character over 4 bits, lowered for short, plain lower-case or placeholder literals."""
    if len(literal) < 6 or re.fullmatch(r"(.)\1*|[xX*.]+|\$\{.*|\{\{.*|<.*|(?i:true|false|none|null|undefined|changeme|example)", literal):
        return 0.0
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in Counter(literal).values())
    kinds = sum(bool(re.search(k, literal)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    # words of one kind of character have about 3 bits; what has 4 is as random as any
    return min(entropy / 4, 1.0) * (1.0 if kinds > 1 else 0.3 + 0.7 * min(max(entropy - 3, 0.0), 1.0))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the three patterns, leftmost and non-overlapping by kind; too short ones are dropped after matching."""
    found = []
    low = text.lower()
    for m in ASSIGN.finditer(text) if any(x in low for x in ("passw", "secret", "token", "key")) else ():
        if m.end(1) - m.start(1) >= SHORTEST_ASSIGN:
            found.append(("assign", *m.span()))
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= SHORTEST_ACCESS]
    # every run has the whole of a possible match, so asking for the length at once drops the same ones
    if _HEX_THIRDS.search(text[::3]):
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _pairs(text: str) -> Iterator[re.Match]:
    """Matches of ``_PAIR``, also those inside triple quotes and long literals of harmless names."""
    m = _PAIR.search(text)
    while m:
        yield m
        kind = next(k for k in _KINDS[:6] if m[k] is not None)
        begin, after = m.start(kind), m.end()
        if (kind in ("triple", "triples") or after - begin > LONG) and not sensitivity(m["name"] or m["tag"]):
            after = begin + LONG if kind == "bare" else begin
        m = _PAIR.search(text, after)


def lexed_spans(text: str) -> list[tuple[str, int, int]]:
    """Literals that reach a sensitive name: ``literal`` if assigned to it, ``constant`` if by way of other names."""
    letters = text.lower().encode().translate(None, _BETWEEN)
    if not any(x in letters for x in _HINTS):
        return []
    held: dict[str, tuple[str, int, int]] = {}  # name -> the literal it has at this point of the text, and where that stands
    found = set()
    pairs = [*_pairs(text), *_BLOCK.finditer(text), *_PEM.finditer(text)]
    for m in sorted(pairs, key=lambda m: m.end("name") if m["name"] else m.end("tag")):  # a block comes after the bar of its name
        groups = m.groupdict()
        name = groups["name"] or groups["tag"]
        kind = next(k for k in _KINDS if groups.get(k) is not None)
        literal, begin, end = m[kind], *m.span(kind)
        if kind in ("triple", "triples", "block", "pem"):  # the spaces around are none of it
            begin += len(literal) - len(literal.lstrip())
            literal = literal.strip()
            end = begin + len(literal)
        through = "literal"
        if kind == "bare":
            literal = literal.rstrip(".,")
            end = begin + len(literal)
            if _NAME.fullmatch(literal) and literal in held:
                literal, begin, end = held[literal]
                through = "constant"
        held[name] = (literal, begin, end)
        weight = sensitivity(name)
        if weight and weight * randomness(literal) >= THRESHOLD:
            found.add((through, begin, end))
    return sorted(found, key=lambda s: (s[1], s[2]))


#: Kinds in the order in which those with one start are listed.
KINDS = ("assign", "access", "hex", "literal", "constant")


def all_spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and base spans with the lexer's; by start, then kind as listed, in code points, end exclusive."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    return base, sorted(base + lexed_spans(text), key=order)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, counts of the base kinds, digest of the base spans and all spans of each row's whole text.

    Returns ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.  A null or empty
    text has no span: counts 0, the digest of the empty string and empty ``spans``.  Rows are
    independent, so repeated rows and null keys come back as they are.
    """
    added = {"n_assign": T.LongType(), "n_access": T.LongType(), "n_hex": T.LongType(), "base_sha256": T.StringType(), "spans": T.StringType()}

    def run(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, texts in batches:
            out: list[list] = [[] for _ in added]
            for value in texts:
                base, spans = all_spans(value)
                kinds = Counter(s[0] for s in base)
                digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
                row = (kinds["assign"], kinds["access"], kinds["hex"], digest, ",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield [keys, *out]

    return map_rows(df, [key, text], schema_of(df, key, **added), run)


def mask(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows with each span in ``text`` replaced by ``mark``; overlapping spans become one.

    All other columns, whatever their names, stay as they are; a null text stays null.
    """
    @F.pandas_udf(T.StringType())
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda value: value if value is None else _masked(value, mark))

    return df.withColumn(text, masked(F.col(text)))


def _masked(text: str, mark: str) -> str:
    out, done = [], 0
    for _, begin, end in all_spans(text)[1]:
        if begin >= done:
            out += [text[done:begin], mark]
        done = max(done, end)
    return "".join([*out, text[done:]]) if out else text
