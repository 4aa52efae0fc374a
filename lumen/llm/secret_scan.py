"""Secrets in texts: known forms, and literals that source code or configuration assigns to sensitive names.

A text is lexed once into names, string literals and operators. Assignments,
mapping entries, keyword and positional arguments, tags, flags, headers and
bare configuration lines give pairs of a name and the terms of its value. Names
among the terms stand for what was assigned to them, and so do references
inside strings, so a literal is followed through constants and concatenations
to the name that it ends in. A pair counts if the name is sensitive and the
value looks like a secret; the spans are those of the literals it came from.
Texts without any sensitive word are not lexed: no name in them could count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the forms and their least lengths, in the order of the kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
# end of fixed values
KINDS = ("assign", "access", "hex", "literal")
#: A pair counts from this product of the name's and the literal's score; shorter literals never do.
LEAST_SCORE, LEAST_LENGTH = 0.5, 6

#: Words of a name and how much they say, alone or in pairs; words that turn a name into something about a secret.
STRONG = {"password", "passwd", "passphrase", "passcode", "pwd", "pw", "secret", "credential", "credentials", "apikey", "authtoken", "accesstoken", "clientsecret", "secretkey", "privatekey", "accesskey"}
FAIR = {"token", "pass", "auth", "authorization", "bearer", "jwt", "pat", "psk", "dsn"}
PAIRED = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("master", "key"), ("account", "key"), ("shared", "key"), ("auth", "key"), ("license", "key"), ("deploy", "key"), ("connection", "string"), ("webhook", "url")}
ABOUT = {"length", "len", "size", "min", "max", "count", "limit", "type", "kind", "name", "names", "field", "label", "hint", "prompt", "placeholder", "file", "path", "dir", "url", "uri", "endpoint", "host", "ttl", "expiry", "expires", "expiration", "policy", "regex", "pattern", "id", "ids", "header", "param", "parameter", "attr", "column", "algorithm", "alg", "hash", "encoder", "version", "prefix", "suffix", "error", "message", "required", "enabled", "valid"}
#: What stands where a secret will be filled in.
BLANK = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|0+|1234567?8?9?0?|<.*>|\[.*\]|%.*%|\{\{.*\}\}|\$\{?[\w.:-]+\}?|(?:change|replace|insert|enter|fill)[-_ ]?(?:me|this|here|it)?.*|your[-_ ].*|my[-_ ]?(?:password|secret|token|key)|(?:example|sample|dummy|placeholder|redacted|todo|fixme|none|null|nil|undefined|true|false|empty|default|unset|string|optional|required)[-_ ]?\w{0,12})$")
#: What every sensitive name, and what a password in an address, holds; and what the first known form does.
STEMS, WORDS = ("pass", "pwd", "pw", "secret", "token", "credential", "auth", "bearer", "jwt", "pat", "psk", "dsn", "key", "connection", "webhook", "identified"), ("passw", "secret", "token", "api")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

LEX = re.compile(
    r"""(?P<string>(?<![\w])[rRbBuUfF]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\\]*`))"""
    r"""|(?P<name>[A-Za-z_$][\w$]*(?:(?:->|::|[.-])[A-Za-z_$][\w$]*)*)"""
    r"""|(?P<op>:=|=>|===?|!==?|[<>]=|\+=|\?=|\|\|=|[=:+,;.(){}\[\]|&<>])"""
    r"""|(?P<line>\n)""",
    re.ASCII,
)
TRIPLE = re.compile(r'''(?<!\w)[rRbBuUfF]{0,2}("""|\'\'\')''', re.ASCII)
LINE = re.compile(r"^[ \t]*(?:(?:export|set|ENV|ARG|-|#|//)[ \t]+)*([A-Za-z_][\w.-]*)[ \t]*(?::=|[:=])[ \t]*([^\s\"'`,;{}()\[\]<>#][^\s\"'`]*)[ \t]*(?:[#;].*)?$", re.M | re.ASCII)
FLAG = re.compile(r"(?<![\w-])--?([A-Za-z][\w-]*)[ \t=]+([^\s\"'`=-][^\s\"'`]*)", re.ASCII)
HEADER = re.compile(r"(?i)\b(authorization|x-[a-z0-9-]+)[\"']?[ \t]*[:=][ \t]*[\"']?(?:(?:bearer|basic|token)[ \t]+)?([A-Za-z0-9+/_.=~-]{6,})", re.ASCII)
USERINFO = re.compile(r"://[^\s/:@\"'`]*:([^\s/@\"'`]+)@")
TAG, ATTRIBUTE = re.compile(r"<(/?)([A-Za-z_][\w.:-]*)([^<>]*)>", re.ASCII), re.compile(r"([A-Za-z_][\w.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.ASCII)
REFERENCE = re.compile(r"\$\{([A-Za-z_][\w.]*)(?::?-[^}]*)?\}|\$([A-Za-z_]\w*)|#\{([A-Za-z_][\w.]*)\}|%\(([A-Za-z_]\w*)\)s|\{\{\s*([A-Za-z_][\w.]*)\s*\}\}|\{([A-Za-z_][\w.]*)\}", re.ASCII)
SETTER = re.compile(r"(?:^|[.>:])(?:set|with|add|put)_?([A-Z_]\w*)$", re.ASCII)
#: Calls that give their first string on, and those that give their last one where the first names it.
GIVES = {"str", "string", "bytes", "b64decode", "decode", "encode", "unhexlify", "fromhex", "trim", "strip", "buffer.from", "atob", "securestring", "literal", "text"}
JOINS = {"+", ".", "&", "|"}


@dataclass
class Pair:
    """A name, where its value begins, and the value's terms: ("text", value, start, end), ("name", name) or ("other",)."""

    name: str
    at: int
    terms: list[tuple] = field(default_factory=list)
    bare: bool = False


def lex(text: str) -> list[tuple[str, str, int, int]]:
    """Tokens (kind, value, start, end); of a string the value and place of what is between its quotes."""
    out, at, open_ = [], 0, [m for m in TRIPLE.finditer(text)]
    starts, skip = [m.start() for m in open_], {}
    for m in open_:
        skip[m.start()] = m
    no_end: set[str] = set()
    while (m := LEX.search(text, at)) is not None:
        kind, a, b = m.lastgroup, m.start(), m.end()
        k = bisect_right(starts, a) - 1
        triple = skip[starts[k]] if k >= 0 and starts[k] == a else None
        if triple is not None and triple[1] not in no_end:
            end = text.find(triple[1], triple.end())
            if end >= 0:
                out.append(("string", text[triple.end() : end], triple.end(), end))
                at = end + 3
                continue
            no_end.add(triple[1])
        if kind == "string":
            while text[a] not in "\"'`":
                a += 1
            out.append((kind, text[a + 1 : b - 1], a + 1, b - 1))
        else:
            out.append((kind, m[0], a, b))
        at = b
    return out


def _value(tokens: list, i: int) -> tuple[list[tuple], int]:
    """The terms of the expression that begins at token i, and where it ends."""
    terms, n, depth = [], len(tokens), 0
    while i < n:
        kind, value, a, b = tokens[i]
        if kind == "string":
            terms.append(("text", value, a, b))
            i += 1
        elif kind == "name" and value in ("new", "await", "return") and i + 1 < n:
            i += 1
            continue
        elif kind == "name" and i + 1 < n and tokens[i + 1][1] == "(" and tokens[i + 1][0] == "op":
            inner, i, strings = 1, i + 2, []
            while i < n and inner:
                k, v, x, y = tokens[i]
                inner += (k == "op" and v == "(") - (k == "op" and v == ")")
                if k == "string" and inner == 1:
                    strings.append(("text", v, x, y))
                i += 1
            last = value.lower().rpartition(".")[2]
            if strings and (last in GIVES or value.lower() in GIVES):
                terms.append(strings[0])
            elif len(strings) == 2 and ("env" in last or last in ("get", "getproperty", "setdefault")):
                terms.append(strings[1])
            else:
                terms.append(("other",))
        elif kind == "name":
            terms.append(("name", value))
            i += 1
        elif kind == "op" and value == "(" and not terms:
            depth += 1
            i += 1
            continue
        else:
            break
        while i + 1 < n and tokens[i][1] == "." and tokens[i][0] == "op" and tokens[i + 1][0] == "name":  # a method of a literal
            i += 2
            if i < n and tokens[i][1] == "(":
                inner, i = 1, i + 1
                while i < n and inner:
                    inner += (tokens[i][1] == "(") - (tokens[i][1] == ")")
                    i += 1
        j = i
        while j < n and tokens[j][0] == "line" and (depth or j + 1 < n and tokens[j + 1][1] in JOINS):
            j += 1
        if j < n and tokens[j][0] == "string" and terms[-1][0] == "text":
            i = j
        elif j < n and tokens[j][0] == "op" and tokens[j][1] in JOINS:
            i = j + 1
            while i < n and tokens[i][0] == "line":
                i += 1
        else:
            break
    return terms, i


def _target(tokens: list, i: int) -> str | None:
    """The name to the left of the operator at token i: an identifier, a quoted key, the key of a subscript, or what a type annotation belongs to."""
    if not i:
        return None
    kind, value, _, _ = tokens[i - 1]
    if tokens[i][1] in ("=", ":=") and kind != "line":
        for j in range(i - 2, max(-1, i - 10), -1):
            if tokens[j][0] == "line" or tokens[j][1] in "=,;({":
                break
            if tokens[j][1] == ":" and j and tokens[j - 1][0] == "name" and (j < 2 or tokens[j - 2][1] not in ("?", "[")):
                return tokens[j - 1][1]
    if kind in ("name", "string"):
        return value
    if value == "]" and i >= 3 and tokens[i - 2][0] == "string" and tokens[i - 3][1] == "[":
        return tokens[i - 2][1]
    return None


def pairs(text: str) -> list[Pair]:
    """All pairs of a text, by place."""
    tokens, out = lex(text), []
    for i, (kind, value, a, _) in enumerate(tokens):
        if kind == "op" and value in ("=", ":=", "=>", ":", "?=", "||="):
            name = _target(tokens, i)
            if name:
                out.append(Pair(name, a, _value(tokens, i + 1)[0]))
        elif kind == "name" and i + 1 < len(tokens):
            after = tokens[i + 1]
            if after[0] == "string" and (value.lower() in ("password", "passwd") or value.lower() == "by" and i and tokens[i - 1][1].lower() == "identified"):
                out.append(Pair("password", a, [("text", *after[1:])]))
            elif after[1] == "(" and (m := SETTER.search(value)):
                out.append(Pair(m[1], a, _value(tokens, i + 2)[0]))
            if after[1] == "(" and i + 3 < len(tokens) and tokens[i + 2][0] == "string" and tokens[i + 3][1] == ",":
                out.append(Pair(tokens[i + 2][1], a, _value(tokens, i + 4)[0]))
    out += [Pair(m[1], m.start(), [("text", m[2], m.start(2), m.end(2))], True) for m in LINE.finditer(text)]
    out += [Pair(m[1], m.start(), [("text", m[2], m.start(2), m.end(2))], True) for m in FLAG.finditer(text)]
    out += [Pair(m[1], m.start(), [("text", m[2], m.start(2), m.end(2))]) for m in HEADER.finditer(text) if m[1].lower() == "authorization" or re.search("(?i)key|token|secret|auth", m[1])]
    out += [Pair("password", m.start(), [("text", m[1], m.start(1), m.end(1))]) for m in USERINFO.finditer(text)]
    before = None
    for m in TAG.finditer(text):
        has = {k.lower(): (x or y, at) for k, x, y, at in ((g[1], g[2], g[3], m.start(3) + max(g.start(2), g.start(3))) for g in ATTRIBUTE.finditer(m[3]))}
        named = next((has[k][0] for k in ("key", "name", "id") if k in has), None)
        if named and "value" in has:
            out.append(Pair(named, m.start(), [("text", has["value"][0], has["value"][1], has["value"][1] + len(has["value"][0]))]))
        if m[1] and before is not None and before[0] == m[2]:
            inside = text[before[2] : m.start()]
            kept = inside.strip()
            at = before[2] + inside.find(kept) if kept else 0
            for name in before[:2]:
                if kept and name:
                    out.append(Pair(name, before[2], [("text", kept, at, at + len(kept))], name == before[0]))
        before = None if m[1] else (m[2], named, m.end())
    return sorted(out, key=lambda p: p.at)


class Constants:
    """What each name was assigned, in the order of the text."""

    def __init__(self, found: list[Pair]):
        self.by: dict[str, list[Pair]] = {}
        for p in found:
            for name in {p.name, re.split(r"->|::|[.]", p.name)[-1]}:
                self.by.setdefault(name, []).append(p)

    def _of(self, name: str, at: int, seen: frozenset) -> tuple[str, list[tuple[int, int]]] | None:
        """The last assignment before `at`, or else the first one after it."""
        have = [p for n in (name, re.split(r"->|::|[.]", name)[-1]) for p in self.by.get(n, [])[:1]] and self.by.get(name, self.by.get(re.split(r"->|::|[.]", name)[-1], []))
        if not have:
            return None
        p = have[max(0, bisect_right(have, at, key=lambda x: x.at) - 1)]
        return None if id(p) in seen or p.at == at else self.value(p, seen)

    def value(self, p: Pair, seen: frozenset = frozenset()) -> tuple[str, list[tuple[int, int]]]:
        """The text of a pair's value and the spans of the literals in it; what is not known is left out, and a name that leads back to itself gives nothing."""
        seen = seen | {id(p)}
        text, spans = [], []
        for t in p.terms:
            if t[0] == "name":
                known = self._of(t[1], p.at, seen) if len(seen) < 50 else None
                if known:
                    text.append(known[0])
                    spans += known[1]
            elif t[0] == "text":
                known = self._of(t[1], p.at, seen) if p.bare and re.fullmatch(r"[A-Za-z_]\w*", t[1]) and len(seen) < 50 else None
                if known and known[0]:
                    text.append(known[0])
                    spans += known[1]
                    continue
                end, own = 0, False
                for m in REFERENCE.finditer(t[1]):
                    known = self._of(next(g for g in m.groups() if g), p.at, seen) if len(seen) < 50 else None
                    if known is None or not known[0]:
                        continue
                    own |= m.start() > end
                    text += [t[1][end : m.start()], known[0]]
                    spans += known[1]
                    end = m.end()
                text.append(t[1][end:])
                if own or end < len(t[1]):
                    spans.append((t[2], t[3]))
        return "".join(text), spans


def name_score(name: str) -> float:
    """How sensitive a name is, 0 to 1."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words:
        return 0.0
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    pair = any(p in PAIRED for p in zip(words, words[1:], strict=False))
    best = 1.0 if pair or joined & STRONG or set(words) & STRONG else 0.8 if set(words) & FAIR else 0.0
    if ("webhook", "url") in zip(words, words[1:], strict=False):
        return best
    return best * 0.2 if words[-1] in ABOUT or words[0] in ("max", "min", "num", "is", "has", "show", "forgot", "reset") or words[-1] == "tokens" else best


def literal_score(value: str, bare: bool) -> float:
    """How much a literal looks like a secret, 0 to 1. Bare values must hold a digit or mixed letters: words of prose do not."""
    if len(value) < LEAST_LENGTH or re.search(r"\s", value) or BLANK.match(value):
        return 0.0
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    if bits < 1.5 or bare and (classes < 2 or value.isalpha() and value[1:].islower() or not re.search(r"[0-9]", value) and classes < 3):
        return 0.0
    return 0.55 + 0.15 * (classes >= 2) + 0.15 * (bits >= 3) + 0.15 * (len(value) >= 16)


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int
    name: str | None
    score: float


def assigns(text: str) -> bool:
    """False only where no pair could count: no operator, or no stem of a sensitive name."""
    if not any(o in text for o in ("=", ":", "(", "<", "--", "BY", "by", "PASSW", "passw")):
        return False
    low = text.lower()
    return any(s in low for s in STEMS) or USERINFO.search(text) is not None


def base(text: str) -> list[Finding]:
    """The known forms, leftmost and not overlapping within a kind."""
    low = text.lower() if ":" in text or "=" in text else ""
    out = [Finding("assign", m.start(), m.end(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if any(w in low for w in WORDS) else []
    out += [Finding("access", m.start(), m.end(), None, 1.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [Finding("hex", m.start(), m.end(), None, 1.0) for m in HEX.finditer(text)]


def added(text: str, known: list[Finding]) -> list[Finding]:
    """Literals that end in a sensitive name, but for those that lie within a known form."""
    if not assigns(text):
        return []
    found = pairs(text)
    constants, best = Constants(found), {}
    for p in found:
        sensitive = name_score(p.name)
        if sensitive < LEAST_SCORE:
            continue
        value, spans = constants.value(p)
        score = sensitive * literal_score(value, p.bare)
        if score >= LEAST_SCORE:
            for span in spans:
                if span[1] > span[0] and score > best.get(span, ("", 0.0))[1]:
                    best[span] = (p.name, score)
    cover = sorted((f.start, f.end) for f in known)
    reach, ends = 0, []
    for _, e in cover:
        ends.append(reach := max(reach, e))
    inside = lambda a, b: (k := bisect_right(cover, (a, math.inf)) - 1) >= 0 and ends[k] >= b
    return [Finding("literal", a, b, name, score) for (a, b), (name, score) in best.items() if not inside(a, b)]


def find(text: str | None) -> list[Finding]:
    """All findings of a text, by start and then in the order of the kinds."""
    if not text:
        return []
    known = base(text)
    return sorted(known + added(text, known), key=lambda f: (f.start, KINDS.index(f.kind), f.end))


FINDING = "struct<kind:string,start:long,end:long,name:string,score:double>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, findings (kind, start, end in code points, end exclusive, name, score) of each row.

    A null or empty text has none; a very long one is lexed whole, in time and
    memory in proportion to it. Rows are independent: repeated rows and null ids
    give rows of their own, and an empty table gives none. Other columns are not
    read. Equal spans of a kind are one finding, by its best score.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[vars(f) for f in find(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], names=["doc_id", "findings"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, findings array<{FINDING}>")


def query(spark, sf_dir: str) -> DataFrame:
    """Counts and digest of the known forms, and all spans."""
    from .common import read

    found = F.col("findings")
    shown = lambda fs: F.array_join(F.transform(fs, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter(found, lambda f: f["kind"] == kind)).cast("long")
    return scan(read(spark, sf_dir, "documents")).select(
        "doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(shown(F.filter(found, lambda f: f["kind"] != "literal")).cast("binary"), 256).alias("base_sha256"), shown(found).alias("spans")
    )
