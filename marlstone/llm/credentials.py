"""Credentials written out in source code and configuration files.

1. Every file is scanned once for literals that stand where a credential stands (after a credential's name, in an
   address, behind an authorization scheme, in a login) or that have the build of one (provider tokens, key blocks).
2. The literals are indexed over the corpus, with the owners of every place where they stand: a value that many owners
   share is a placeholder, unless its build alone proves it, and so is one that says nothing but "put your key here".
   What is left, rare and structured, is confirmed.
3. Every file is scanned again for the confirmed values, wherever they stand, with an automaton. So that no automaton
   holds the values of the whole corpus, a hash of each run of words of a file is looked up in a bit array of bounded
   size; the few surroundings that pass meet the values with exactly that hash by a join, and an automaton of the
   batch's values reads them. A common beginning or ending of values brings nothing together.
"""

from __future__ import annotations

import base64
import bisect
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.ranks import salt
from marlstone.llm import sieve
from marlstone.llm.hashing import AT_ONCE, Spans, codes_of
from marlstone.session import cut

# --- fixed values: public formats of tokens and names of credentials ---
STRUCTURED = [
    r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[opsur]_[A-Za-z0-9]{36}(?![0-9A-Za-z])",
    r"glpat-[A-Za-z0-9_\-]{20}(?![0-9A-Za-z_\-])",
    r"[sr]k_live_[A-Za-z0-9]{24,}",
    r"xox[abprs]-\d{10,13}-\d{10,13}-[A-Za-z0-9]{24,}",
    r"AIza[0-9A-Za-z_\-]{35}(?![0-9A-Za-z_\-])",
    r"npm_[A-Za-z0-9]{36}(?![0-9A-Za-z])",
    r"SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}(?![0-9A-Za-z_\-])",
    r"dop_v1_[a-f0-9]{64}(?![0-9A-Za-z])",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}",
]
NAME_ENDS = ("password", "passwd", "passphrase", "passwort", "pwd", "pass", "pw", "secret", "token", "apikey", "credential", "credentials")
KEY_BEFORE = ("api", "secret", "access", "auth", "signing", "encryption", "private", "hmac", "master", "service", "client", "fernet", "account", "storage", "webhook", "deploy", "license", "admin", "crypto", "cipher", "aes", "jwt", "session")
# words that ask for a credential or stand for none; a value of nothing but these has no structure
SAYING = (
    "access", "admin", "api", "auth", "basic", "bearer", "change", "client", "credential", "disabled", "dummy", "empty", "enabled", "enter", "example", "false", "fill", "here", "hidden",
    "in", "insert", "key", "masked", "me", "my", "new", "nil", "none", "not", "null", "optional", "pass", "passwd", "passphrase", "password", "placeholder", "pwd", "redacted", "removed",
    "replace", "required", "root", "sample", "secret", "set", "str", "strict", "string", "test", "the", "this", "to", "do", "token", "true", "undefined", "user", "value", "vault", "with", "your",
)
# what a line with a credential, or a text with one, must hold in lower case, by the kind of place
TRIGGERS = {
    "name": ("pass", "pwd", "pw", "secret", "token", "key", "credential"),
    "scheme": ("bearer", "basic", "token"),
    "address": ("://",),
    "login": ("login", "authenticate", "signin", "sign_in", "basicauth", "basic_auth", "-u"),
    "sql": ("identified by",),
    "build": ("akia", "ghp_", "gho_", "ghs_", "ghu_", "ghr_", "glpat-", "k_live_", "xox", "aiza", "npm_", "sg.", "dop_v1_", "eyj"),
    "block": ("-----begin",),
}
# --- end of fixed values ---

IDENT = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_structured = re.compile(r"(?<![A-Za-z0-9_\-])(?:" + "|".join(STRUCTURED) + ")")
_pem = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----.*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
_public = re.compile(r"-----BEGIN (?!(?:[A-Z0-9]+ )*PRIVATE KEY)[A-Z0-9 ]+-----.*?-----END [A-Z0-9 ]+-----", re.S)
_userinfo = re.compile(r"[a-z][a-z0-9+.\-]*://([^\s:/@'\"]*):([^\s/@'\"]+)@", re.I)
_query = re.compile(rf"[?&;]({IDENT})=([^&\s'\"#;]+)")
_scheme = re.compile(r"\b(bearer|basic|token)[ \t]+([A-Za-z0-9+/=_.~\-]{8,})", re.I)
_curl = re.compile(r"(?:\s-u|\s--user|\s--proxy-user)[ =]([^\s:'\"]+):([^\s'\"]+)")
_named_quoted = re.compile(rf"""(?<![A-Za-z0-9_])\\?(["']?)(-{{0,2}}{IDENT})\\?\1(?:[ \t]*\])?[ \t]*(?::[ \t]*{IDENT}(?:\[[^\]\n]*\])?[ \t]*)?(?:=>|:=|===?|!==?|=|:|,|\bis\b)[ \t]*(?:default[ \t]*=[ \t]*)?(?:[bBuUrR]{{0,2}})(\\?["'])""")
_named_bare = re.compile(rf"""(?:^|(?<=\r))([ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+)?)({IDENT})[ \t]*[:=][ \t]*((?![bBuUrRfF]{{0,2}}["'])[^\s(\[{{][^\r\n]*)""", re.M)
_spread = re.compile(rf"""(?<![A-Za-z0-9_])({IDENT})[ \t]*(?::[ \t]*{IDENT}[ \t]*)?=[ \t]*(\(?)""")
_piece = re.compile(r"""\s*(?:\+|\\\r?\n|\.)?\s*[bBuUrR]{0,2}("(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')""")
_sql = re.compile(r"\b(?:PASSWORD|IDENTIFIED BY)\s+(\\?['\"])([^'\"\r\n]+?)\1", re.I)
_call = re.compile(r"""\b([A-Za-z_][\w.]*)\(([^()\r\n]*)\)""")
_string = re.compile(r"""[bBuU]?("(?:[^"\\\r\n]|\\.)*"|'(?:[^'\\\r\n]|\\.)*')""")
_said = re.compile(rf"""(?:#|//|/\*|^\s*\*|--|;|<!--)[^\r\n]*?\b(password|passwd|pwd|passphrase|secret|token|api[ _-]?key|key|login|credentials?)\b([^\r\n]*)""", re.I | re.M)
_closes = re.compile(r"\s*\)")
_word = re.compile(r"[^\s\"'`,;()<>\[\]{}]+")


def credential_name(name: str) -> bool:
    """Whether a variable, field or option of that name holds a credential (not its place, policy or length)."""
    plain = re.sub(r"[^a-z0-9]", "", name.rsplit(".", 1)[-1].lower() if not name.startswith("-") else name.lower())
    if plain.endswith(NAME_ENDS):
        return not plain.endswith(("bypass", "compass", "trespass"))
    return plain.endswith("key") and plain[:-3].endswith(KEY_BEFORE)


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


_saying = re.compile("(?:" + "|".join(sorted(SAYING, key=len, reverse=True)) + r"|\d{1,2})+")
_reference = re.compile(r"\$\{|\{\{|%\(|<[^<>]*>|\$\(|^\{.*\}$|\{[A-Za-z_][\w.\[\]'\"]*\}|^\$[A-Za-z_]\w*$|\[A-Za-z|\\[dw]|\{\d+(,\d*)?\}")
_masked = re.compile(r"(.)\1{5,}|\*{3,}|\.{4,}")
_kept_at = re.compile(r"(?:[a-z][a-z0-9+.\-]*://[^@]*$|arn:|vault:|kv/|env:|file:|op://|ssm:|secret[s]?/|projects/)", re.I)
_path = re.compile(r"\.{0,2}/[\w./\-]+$")


def _random(s: str) -> bool:
    """Whether a run of letters and digits looks drawn at random: both cases and digits, and hardly a sign twice."""
    return len(s) >= 12 and bool(re.search(r"[a-z]", s)) and bool(re.search(r"[A-Z]", s)) and bool(re.search(r"\d", s)) and entropy(s) > 3.2


def placeholder(value: str) -> bool:
    """Whether a value is no credential by its own look: empty, masked, a reference to where one is kept, or a pattern."""
    v = value.strip()
    plain = re.sub(r"[^a-z0-9]", "", v.lower())
    if len(v) < 4 or len(plain) < 3 or len(set(plain)) <= 2:
        return True
    if _reference.search(v) or _masked.search(v) or _kept_at.match(v):
        return True
    return bool(_path.match(v)) and not _random(max(v.split("/"), key=len))


def structured(value: str) -> bool:
    """Whether a value holds more than words that ask for a credential; a filler within a value does not matter."""
    plain = re.sub(r"[^a-z0-9]", "", value.lower())
    return len(plain) > 64 or not _saying.fullmatch(plain)


def _is_value(value: str) -> bool:
    """Whether a value that stands at a credential's place is one."""
    return not placeholder(value) and not re.search(r"\s", value.strip()) and not re.fullmatch(r"(?:os\.|self\.|process\.|config\.|settings\.)[\w.\[\]\"']+|[A-Za-z_][\w.]*\(.*\)?|\d{1,5}", value)


def _digestlike(name: str) -> bool:
    return bool(re.search(r"sha\d*|md5|digest|checksum|commit|trace|request_?id|uuid|etag|hash$|b64|icon|pattern|regex|label|hint|prompt|message|policy|_file|_path|ttl|count|length|public", name, re.I))


def _basic(value: str) -> bool:
    try:
        return b":" in base64.b64decode(value, validate=True)
    except ValueError:
        return False


def _bare(rest: str) -> str:
    """An unquoted value without a trailing comment or separator."""
    rest = re.split(r"\s+[#;]|\s+//", rest, maxsplit=1)[0].rstrip()
    return rest.rstrip(",;")


def _automaton():
    import ahocorasick

    machine, of = ahocorasick.Automaton(), {}
    for bit, words in enumerate(TRIGGERS.values()):
        for w in words:
            of[w] = of.get(w, 0) | 1 << bit
    for w, bits in of.items():
        machine.add_word(w, bits)
    machine.make_automaton()
    return machine


_machine = None
NAME, SCHEME, ADDRESS, LOGIN, SQL, BUILD, BLOCK = (1 << i for i in range(len(TRIGGERS)))


def _lower(text: str) -> str:
    """In lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def _lines(text: str) -> tuple[list[tuple[int, int, int]], int]:
    """(start, end, kinds of places) of the lines that may hold a credential, and the kinds of all of them."""
    global _machine
    if _machine is None:
        _machine = _automaton()
    out, a, z, bits, all_bits = [], 0, -1, 0, 0
    for end, kinds in _machine.iter(_lower(text)):
        all_bits |= kinds
        if end < z:
            bits |= kinds
            continue
        if bits:
            out.append((a, z, bits))
        a = max(text.rfind("\n", 0, end + 1), text.rfind("\r", max(0, text.rfind("\n", 0, end + 1)), end + 1)) + 1
        z, r = text.find("\n", end), -1
        z = len(text) if z < 0 else z
        r = text.find("\r", end, z)
        z, bits = (z if r < 0 else r), kinds
    if bits:
        out.append((a, z, bits))
    return out, all_bits


def scan(text: str) -> list[tuple[int, int, str, str]]:
    """(start, length, kind, value) of each literal that is a credential by its place or build.

    kind is build, place or piece; value is the literal, or for a piece all pieces of it joined.
    """
    lines, bits = _lines(text)
    if not lines:
        return []
    found: dict[tuple[int, int], tuple[str, str]] = {}
    shut: list[tuple[int, int]] = []

    def put(a: int, b: int, kind: str, value: str | None = None) -> None:
        if b > a and not any(x < b and a < y for x, y in shut):
            found.setdefault((a, b), (kind, text[a:b] if value is None else value))

    if bits & BLOCK:
        for m in _public.finditer(text):
            shut.append(m.span())
        for m in _pem.finditer(text):
            put(*m.span(), "build")
            shut.append(m.span())
    for a, z, kinds in lines:
        if kinds & BUILD:
            for m in _structured.finditer(text, a, z):
                if not placeholder(m[0]):
                    put(*m.span(), "build")
        if kinds & ADDRESS:
            for m in _userinfo.finditer(text, a, z):
                if _is_value(m[2]):
                    put(*m.span(2), "place")
        if kinds & SCHEME:
            for m in _scheme.finditer(text, a, z):
                v = m[2]
                if m[1].lower() == "basic" and _basic(v):
                    put(*m.span(2), "build")
                elif m[1].lower() == "bearer" and re.search(r"\d", v) and not placeholder(v):
                    put(*m.span(2), "place")
        if kinds & LOGIN:
            for m in _curl.finditer(text, a, z):
                if _is_value(m[2]):
                    put(*m.span(2), "place")
        if kinds & (SQL | NAME):
            for m in _sql.finditer(text, a, z):
                if _is_value(m[2]):
                    put(*m.span(2), "place")
        if kinds & NAME:
            _by_name(text, a, z, put)
        if kinds & (NAME | LOGIN):
            _by_call(text, a, z, put)
            _by_saying(text, a, z, put)
    # of spans that overlap, the one with a build, else the longest, else the first
    out: list[tuple[int, int, str, str]] = []
    for (a, b), (kind, value) in sorted(found.items(), key=lambda x: (x[1][0] != "build", x[0][0] - x[0][1], x[0][0])):
        if not any(x < b and a < x + n for x, n, _, _ in out):
            out.append((a, b - a, kind, value))
    return sorted(out)


def _string_end(text: str, at: int, q: str) -> int:
    """Where the string closes whose opening quote ends at at; -1 if it does not on its line."""
    close = at
    while True:
        close = text.find(q, close)
        if close < 0:
            return -1
        if len(q) == 1 and text[close - 1] == "\\" and close > at:
            close += 1
            continue
        return close if "\n" not in text[at:close] else -1


def _by_name(text: str, a: int, z: int, put) -> None:
    """Literals behind a credential's name in one line; what a string is continued by may stand in the next ones."""
    for m in _query.finditer(text, a, z):
        if credential_name(m[1]) and _is_value(m[2]):
            put(*m.span(2), "place")
    for m in _named_quoted.finditer(text, a, z):
        name = m[2]
        if not credential_name(name) or _digestlike(name):
            continue
        if text[m.end() - 1 : m.end() + 2] in ('"""', "'''"):
            continue
        close = _string_end(text, m.end(), m[3])
        if close < 0:
            continue
        span = (m.end(), close)
        tail = text[close + len(m[3]) : close + len(m[3]) + 2].lstrip()
        sep = text[m.end(2) : m.end()]
        if "," in sep and not m[1]:
            continue  # an argument after a variable: the name says nothing of it
        if "," in sep and tail[:1] == "]":
            continue
        value = text[span[0] : span[1]]
        pieces = [span]
        at = close + len(m[3])
        while len(m[3]) == 1:  # "a" + "b": one case per piece
            p = _piece.match(text, at)
            if not p or not re.search(r"\+|\\\r?\n", text[at : p.start(1)]):
                break
            pieces.append((p.start(1) + 1, p.end(1) - 1))
            at = p.end()
        whole = "".join(text[x:y] for x, y in pieces)
        if _is_value(whole) and (m[1] or not re.fullmatch(r"[a-z]+(?:: )?", value) or len(value) > 12):
            for x, y in pieces:
                put(x, y, "place" if len(pieces) == 1 else "piece", whole)
    for m in _spread.finditer(text, a, z):  # name = ( "a" newline "b" )
        if m[2] and credential_name(m[1]) and not _digestlike(m[1]):
            at, pieces = m.end(), []
            while p := _piece.match(text, at):
                pieces.append((p.start(1) + 1, p.end(1) - 1))
                at = p.end()
            whole = "".join(text[x:y] for x, y in pieces)
            if pieces and _closes.match(text, at) and _is_value(whole):
                for x, y in pieces:
                    put(x, y, "place" if len(pieces) == 1 else "piece", whole)
    for m in _named_bare.finditer(text, a, z):
        if credential_name(m[2]) and not _digestlike(m[2]):
            v = _bare(m[3])
            if _is_value(v) and not re.search(r"[()]|^[a-z_]+\.[a-z_.]+$|^f?[\"']", v) and not re.match(r"(?:str|int|bool|bytes|float|None|Optional)\b", v):
                put(m.start(3), m.start(3) + len(v), "place")


def _by_call(text: str, a: int, z: int, put) -> None:
    """set_secret("name", "value") and login("user", "value")."""
    for m in _call.finditer(text, a, z):
        args = list(_string.finditer(m[2]))
        if len(args) == 2:
            name = m[1].rsplit(".", 1)[-1].lower()
            v = args[1][1][1:-1]
            at = m.start(2) + args[1].start(1) + 1
            if (re.search(r"login|authenticate|sign_?in|basic_?auth", name) or re.match(r"(set|put|store|add|register)\w*(secret|token|password|credential|key)", name)) and _is_value(v):
                put(at, at + len(v), "place")


def _by_saying(text: str, a: int, z: int, put) -> None:
    """Values that a comment names."""
    for m in _said.finditer(text, a, z):
        for w in _word.finditer(m[2]):
            v = w[0].rstrip(".:!?") if re.fullmatch(r"[a-z]+[.:!?]*", w[0], re.I) else w[0]
            strong = bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and len(v) >= 8
            after_slash = re.search(r"/\s$", m[2][: w.start()]) is not None
            if (strong or (after_slash and len(v) >= 8)) and _is_value(v) and (after_slash or (entropy(v) > 3.2 and len(v) >= 16) or re.search(r"(?:was|is|:|=|->)\s$", m[2][: w.start()])):
                put(m.start(2) + w.start(), m.start(2) + w.start() + len(v), "place")


# --- over a corpus ------------------------------------------------------------------------------------------------

#: Words of a value that are looked up by their hash.
MOST_RUNS = 8
_of_words: list[np.ndarray] = []


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters, digits and underscores."""
    if not _of_words:
        _of_words.append(np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000))
    edges = np.diff(np.concatenate([[False], _of_words[0][codes], [False]]).astype(np.int8))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def value_key(value: str) -> tuple[int, int, int, int] | None:
    """(hash, runs, before, after) of a value's first words, 8 at most: the hash of what they span, their number, and how
    many code points of the value lie before and behind. None for a value without a letter or digit."""
    codes = codes_of(value)
    starts, ends = _runs(codes)
    if not len(starts):
        return None
    n = min(MOST_RUNS, len(starts))
    h = Spans(codes).of(starts[:1], ends[n - 1 : n])
    return int(h.view(np.int64)[0]), n, int(starts[0]), len(value) - int(ends[n - 1])


def _scan_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for key, owner, text in zip(b["_id"], b["_owner"], b["_text"]):
            for a, n, kind, value in scan(text):
                # a key block proves itself and is never looked up by its value
                block = value.startswith("-----BEGIN")
                out.append((key, owner, a, n, kind, None if block else value, block or structured(value)))
        yield pd.DataFrame(out, columns=["_id", "_owner", "start_pos", "n_chars", "kind", "value", "structured"])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = [(*k, v) for v in b["value"] if (k := value_key(v)) is not None]
        yield pd.DataFrame(out, columns=["h", "runs", "before", "after", "value"])


def _look(words, runs: list[int], before: int, after: int):
    """The surroundings of every run of words whose hash passes the sieve: before and after it as far as any value reaches."""

    def portion(held: list[tuple]) -> pd.DataFrame:
        codes = np.concatenate([x for _, _, _, c in held for x in (c, np.array([10], np.uint32))])
        bounds = np.cumsum([0] + [len(c) + 1 for *_, c in held])
        starts, ends = _runs(codes)
        spans, out = Spans(codes), []
        for k in runs:
            s, e = starts[: len(starts) - k + 1], ends[k - 1 :]
            h = spans.of(s, e)
            yes = np.flatnonzero(sieve.passes(words.value, h))
            of = np.searchsorted(bounds, s[yes], side="right") - 1
            for i, x, y, hh in zip(of, s[yes] - bounds[of], e[yes] - bounds[of], h[yes].view(np.int64)):
                key, owner, text, _ = held[i]
                if y <= len(text):  # else it would reach into the next text
                    at = max(0, int(x) - before - 1)
                    out.append((key, owner, int(hh), at, text[at : int(y) + after + 1], at > 0))
        return pd.DataFrame(out, columns=["_id", "_owner", "h", "off", "part", "cut_off"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held, size = [], 0
            for key, owner, text in zip(b["_id"], b["_owner"], b["_text"]):
                held.append((key, owner, text, codes_of(text)))
                size += len(text)
                if size >= AT_ONCE:
                    yield portion(held)
                    held, size = [], 0
            if held:
                yield portion(held)

    return run


def _rescan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The places of the values of a batch in its surroundings, found by an automaton; a value stands between signs that
    are neither letters, digits nor underscores."""
    import ahocorasick

    for b in batches:
        machine, out = ahocorasick.Automaton(), set()
        for v in b["value"].unique():
            machine.add_word(v, v)
        machine.make_automaton()
        for key, owner, off, part in zip(b["_id"], b["_owner"], b["off"], b["part"]):
            for end, v in machine.iter(part):
                a, z = end - len(v) + 1, end + 1
                before, behind = part[a - 1 : a] if a else "", part[z : z + 1]
                if (a or not off) and not (before.isalnum() or before == "_" or behind.isalnum() or behind == "_"):
                    out.add((key, owner, off + a, len(v), "seen", v))
        yield pd.DataFrame(list(out), columns=["_id", "_owner", "start_pos", "n_chars", "kind", "value"])


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of spans of one file that overlap: one found by its build first, then by its place, then the longest."""
    order = {"build": 0, "place": 1, "piece": 1, "seen": 2}
    for b in batches:
        out = []
        for key, spans in zip(b["_id"], b["spans"]):
            kept: list[tuple[int, int]] = []
            for s in sorted(spans, key=lambda s: (order[s["kind"]], -s["n_chars"], s["start_pos"])):
                a, z = s["start_pos"], s["start_pos"] + s["n_chars"]
                i = bisect.bisect(kept, (a, z))
                if not (i and kept[i - 1][1] > a) and not (i < len(kept) and kept[i][0] < z):
                    kept.insert(i, (a, z))
            out += [(key, a, z - a) for a, z in kept]
        yield pd.DataFrame(out, columns=["_id", "start_pos", "n_chars"])


def _evidence(df: DataFrame, key: str, owner: str, text: str, least_owners: int, most_bits: int) -> tuple[DataFrame, DataFrame]:
    """(places, shared): every literal found by its place, its build or the second scan, and the values that are
    placeholders because that many owners have them, none of which its build proves."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    files = df.select(F.col(key).alias("_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), F.col(text).alias("_text")).filter("length(_text) > 0")
    found = f"_id {kind}, _owner string, start_pos int, n_chars int, kind string, value string"
    hits = cut(files.mapInPandas(_scan_files, f"{found}, structured boolean"), "hits")
    # the values that the files are scanned for again; provider tokens are found by their build in every file anyway
    token = F.col("value").rlike("^(?:" + "|".join(STRUCTURED) + ")$")
    asked = hits.filter(F.col("structured") & F.col("value").isNotNull() & ((F.col("kind") != "build") | ~token))
    values = cut(asked.select("value").distinct().mapInPandas(_keyed, "h long, runs int, before int, after int, value string"), "values")
    reach = values.agg(F.coalesce(F.max("before"), F.lit(0)), F.coalesce(F.max("after"), F.lit(0)), F.collect_set("runs"), F.count("*")).first()  # at most 8 numbers of runs
    table = spark.sparkContext.broadcast(sieve.build(values, "h", sieve.bits_for(reach[3], most_bits)))
    look = _look(table, sorted(reach[2]), reach[0], reach[1])
    around = files.mapInPandas(look, f"_id {kind}, _owner string, h long, off int, part string, cut_off boolean")
    # salted: one value may stand in a large share of all files
    salts = 8
    spread = values.select("h", "value", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    met = around.withColumn("_salt", salt("_id", "off", buckets=salts)).join(spread, ["h", "_salt"])
    seen = met.select("_id", "_owner", "off", "part", "value").mapInPandas(_rescan, found)
    places = cut(hits.unionByName(seen.withColumn("structured", F.lit(True))), "places")
    # the index of literals: owners by value; distinct pairs are combined before they move
    by_owner = places.filter("value IS NOT NULL").groupBy("value", "_owner").agg(F.bool_or(F.col("kind") == "build").alias("proven"))
    shared = by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.bool_or("proven").alias("proven")).filter((F.col("n_owners") >= least_owners) & ~F.col("proven"))
    return places, shared.select("value", "n_owners")


def find_credentials(df: DataFrame, key: str = "submission_id", owner: str = "project_name", text: str = "content", least_owners: int = 20, most_bits: int = 1 << 26) -> DataFrame:
    """(key, start_pos, n_chars): every credential written out in text, in code points from 0, each once.

    A value that least_owners owners or more have, anywhere in their files, is taken for a placeholder, unless its build
    proves it in some file; a value of nothing but words such as "your token here" is one by itself. A confirmed value
    counts wherever it stands between signs that are no part of a word, whatever its length; one written in pieces is
    indexed as a whole, and each piece is a case. Null and empty texts give no rows; files that do not parse are
    scanned like any other; a null key or owner is a key or owner like any other; repeated rows count once, and an
    empty table gives no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    places, shared = _evidence(df, key, owner, text, least_owners, most_bits)
    spans = places.filter("structured").join(shared, "value", "left_anti").select("_id", "start_pos", "n_chars", "kind").distinct()
    lists = spans.groupBy("_id").agg(F.collect_list(F.struct("start_pos", "n_chars", "kind")).alias("spans"))  # one file's
    return lists.mapInPandas(_settle, f"_id {kind}, start_pos int, n_chars int").withColumnRenamed("_id", key)


def decisions(df: DataFrame, key: str = "submission_id", owner: str = "project_name", text: str = "content", least_owners: int = 20, most_bits: int = 1 << 26) -> DataFrame:
    """(decision, n_values, n_places): what became of all literals, in different values and places: shared and unstructured
    ones are placeholders; the others are found by build, by place (or piece), or by the second scan alone (seen)."""
    places, shared = _evidence(df, key, owner, text, least_owners, most_bits)
    first = F.min(F.struct(F.when(F.col("kind") == "build", 0).when(F.col("kind") == "seen", 2).otherwise(1).alias("o"), "kind"))
    one = places.groupBy("_id", "start_pos", "n_chars").agg(first.alias("k"), F.max("value").alias("value"), F.bool_or("structured").alias("structured"))
    marked = one.join(shared.withColumnRenamed("value", "_v"), F.col("value") == F.col("_v"), "left")
    decision = F.when(F.col("_v").isNotNull(), "shared").when(~F.col("structured"), "unstructured").otherwise(F.col("k.kind"))
    return marked.groupBy(decision.alias("decision")).agg(F.count_distinct("value").alias("n_values"), F.count("*").alias("n_places"))


def blank(text: str, spans: list[tuple[int, int]]) -> str:
    """text with each span's characters replaced by '*'; line ends stay, so lines and positions do not move."""
    out, at = [], 0
    for a, n in sorted(spans):
        out += [text[at:a], re.sub(r"[^\r\n]", "*", text[a : a + n])]
        at = a + n
    return "".join([*out, text[at:]])


def redact(df: DataFrame, found: DataFrame, key: str = "submission_id", text: str = "content") -> DataFrame:
    """df with the found spans of text blanked, all other columns and rows as they are, repeats included."""
    own, spans = f"_key_{uuid.uuid4().hex}", f"_spans_{uuid.uuid4().hex}"  # no column of df is called so
    lists = found.groupBy(F.col(key).alias(own)).agg(F.collect_list(F.struct("start_pos", "n_chars")).alias(spans))
    both = df.join(lists, df[key].eqNullSafe(lists[own]), "left").drop(own)

    @F.pandas_udf("string")
    def blanked(texts: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or s is None else blank(t, [(x["start_pos"], x["n_chars"]) for x in s]) for t, s in zip(texts, places)], dtype=object)

    return both.withColumn(text, F.when(F.col(spans).isNull(), F.col(text)).otherwise(blanked(F.col(text), F.col(spans)))).drop(spans)
