"""Credentials in source text: a trigram index proposes leaves, detections verify them.

Every detection is a regular expression from which the trigrams a match must contain are derived.
The index keeps, per trigram that some detection needs, the leaves that contain it, in their text or
in the strings it joins; postings are
intersected per required literal, and only the leaves that remain are read by the detections.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeloom.lineage import written

# Forms of issued tokens.
TOKEN_FORMS = {
    "access_key_id": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "forge_token": r"(?<![A-Za-z0-9])(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}",
    "forge_pat": r"(?<![A-Za-z0-9])(?:github_pat_\w{22,}|glpat-[\w-]{18,})",
    "chat_token": r"(?<![A-Za-z0-9])xox[abprs]-[0-9A-Za-z-]{16,}",
    "payment_key": r"(?<![A-Za-z0-9])(?:sk|rk)_live_[0-9A-Za-z]{16,}",
    "web_token": r"(?<![\w-])eyJ[\w-]{10,}\.eyJ[\w-]{4,}\.[\w-]{8,}",
    "cloud_key": r"(?<![\w-])AIza[\w-]{35}",
}
PRIVATE_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
LOGIN_ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://(?P<user>[^\s:/@\"'`<>{}$]*):(?P<value>[^\s/@\"'`]+)@"
HEADER = r"(?i:\b(?P<scheme>bearer|basic))[ ]+(?P<value>[A-Za-z0-9+/=._~-]{8,})"
OPTION = r"--?(?P<name>[A-Za-z][\w-]*)(?:=|[ ]+)(?P<value>[^\s\"'`,)]+)"
NAMED = r"(?P<name>[A-Za-z_$@][\w$.-]*)[\"'`\]]*[ \t]*(?::=|=>|[:=]|(?<=\w)[ \t]+(?=[\"'`]))[ \t]*"
LOGIN_NOTE = r"(?i:\b(?:login|credentials?|zugang)\b)[^\n\"'`/]*?[ ](?P<user>[\w.-]+)[ ]*/[ ]*(?P<value>[^\s\"'`]+)"

# Words that name a credential, and words that say the value only describes, locates or digests one.
SECRET_WORDS = ["pass", "passwd", "password", "passphrase", "passcode", "pwd", "pw", "secret", "token", "apikey", "credential", "credentials", "kennwort", "passwort"]
SECRET_PAIRS = [("api", "key"), ("access", "key"), ("auth", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("deploy", "key"), ("encryption", "key"), ("master", "key"), ("account", "key"), ("service", "key"), ("session", "key"), ("auth", "code")]
DESCRIBING_WORDS = ["label", "header", "name", "path", "file", "url", "uri", "endpoint", "hash", "digest", "sha", "sha1", "sha256", "md5", "fingerprint", "public", "pub", "id", "count", "limit", "length", "len", "size", "width", "steps", "type", "field", "prompt", "hint", "regex", "pattern", "policy", "expires", "expiry", "ttl", "kind", "column", "param", "env", "var"]
PLACEHOLDER_WORDS = ["todo", "fixme", "xxx", "changeme", "change", "replace", "replaceme", "insert", "your", "example", "sample", "dummy", "placeholder", "redacted", "masked", "hidden", "removed", "none", "null", "nil", "undefined", "true", "false", "empty", "unset", "secret", "password", "passwd", "token", "test", "foo", "bar"]
LITERAL = re.compile(r"(?P<q>\"\"\"|'''|[\"'`])(?P<body>(?:\\.|(?!(?P=q))[^\n\\])*)(?P=q)")
JOINED = re.compile(r"[ \t]*(?:\+|\*|\.\.|\.|<>|&|\\)?[ \t]*(?:\\?\r?\n[ \t]*)?(?:\+|\.\.|\.)?[ \t]*(?:u8|[rRfFbBuUL]{1,2})?(?=[\"'`])")
JOIN = re.compile(r"[\"'`]" + JOINED.pattern)
BARE = re.compile(r"[^\s\"'`#;,()\[\]{}<>][^\s\"'`;,)]*")
FORMS = [re.compile(p) for p in TOKEN_FORMS.values()]
PEM, ADDRESS, AUTH, OPT, NOTE, NAME = (re.compile(p) for p in (PRIVATE_KEY, LOGIN_ADDRESS, HEADER, OPTION, LOGIN_NOTE, NAMED))


def words_of(name: str) -> list[str]:
    """The words of an identifier: ``dbPass_12`` is db, pass."""
    return [w.lower() for w in re.findall(r"(?i:sha256|sha1|md5)|[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name) if not w.isdigit()]


def names_secret(name: str) -> bool:
    words = words_of(name)
    pairs = set(zip(words, words[1:]))
    secret = any(w in SECRET_WORDS for w in words) or any(p in pairs for p in SECRET_PAIRS)
    describing = [w for w in words if w in DESCRIBING_WORDS]
    return secret and not describing


def stands_for_itself(value: str, least: int = 6) -> bool:
    """Whether a value would work as it is written: no placeholder, reference, path, sentence or bare word."""
    v = value.strip()
    if len(v) < least or re.search(r"\s", v) or len(set(v)) < 5:
        return False
    if re.search(r"\$\{|\$\(|\{\{|%\{|%\(|<[^>]*>|^\$[A-Za-z_]\w*$|^%\w+%$|^\*+$|^\{.*\}$", v):
        return False
    if re.match(r"(?:[a-z][a-z0-9+.-]*://|\.{0,2}/[\w.-]+(?:/|$)|~/|vault:|env:|ssm:|file:|arn:)", v) or re.match(r"[\w.]*(?:env|ENV|environ|getenv|process)\b[.\[(]", v):
        return False
    if re.match(r"(?:ssh-(?:rsa|ed25519|dss)|ecdsa-)", v):
        return False
    parts = [p.lower() for p in re.findall(r"[A-Za-z]+", v)]
    has_digit = bool(re.search(r"\d", v))
    if parts and any(p in PLACEHOLDER_WORDS for p in parts) and all(len(p) >= 2 and p.isalpha() for p in parts) and not has_digit:
        return False
    if not has_digit:  # words only, as in a name or label; a long mix of cases is none
        changes = sum(a.islower() != b.islower() for a, b in zip(v, v[1:]))
        return len(v) >= 16 and changes >= len(v) // 4
    if re.fullmatch(r"[\d.,:_ -]+", v):
        return False
    return bool(parts)


def _key_follows(text: str, end: int) -> bool:
    return bool(re.match(r"(?:\\n|[\s\"'`+*.,\\()])*(?:(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*\n\s*)*(?:\\n|[\s\"'`+*.,\\()])*[A-Za-z0-9+/=]{16,}", text[end:]))


def _basic(value: str) -> bool:
    try:
        return ":" in base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8")
    except ValueError:
        return False


def _literals(text: str) -> Iterator[tuple[str, list[tuple[int, int, int]], int]]:
    """Quoted strings with what they're joined to: the joined value, its pieces (start in the value, start and end in the text), and where the first quote is."""
    at = 0
    while m := LITERAL.search(text, at):
        first, value, pieces = m.start(), "", []
        while m:
            pieces.append((len(value), m.start("body"), m.end("body")))
            value += m.group("body")
            at = m.end()
            glue = JOINED.match(text, at)
            m = LITERAL.match(text, glue.end()) if glue else None
        yield value, pieces, first


def find(text: str) -> list[tuple[int, int, str]]:
    """``start, end, kind`` of the credentials in a text, in order and without overlaps."""
    found: dict[int, tuple[int, str]] = {}

    def add(start: int, end: int, kind: str) -> None:
        found[start] = max(found.get(start, (0, "")), (end, kind))

    def scan(value: str, place) -> None:
        """Forms that tell a credential wherever they stand; ``place`` gives the spans in the text."""
        for kind, form in zip(TOKEN_FORMS, FORMS):
            for m in form.finditer(value):
                place(m.start(), m.end(), kind)
        for m in ADDRESS.finditer(value):
            if len(m["value"]) >= 3 and not re.search(r"[${}<>*]|^%\w+%$", m["value"]) and not all(w.lower() in PLACEHOLDER_WORDS for w in re.findall(r"[A-Za-z]+|\d+", m["value"])):
                place(m.start("value"), m.end("value"), "login_address")
        for m in AUTH.finditer(value):
            if m["scheme"].lower() == "basic" and _basic(m["value"]) or m["scheme"].lower() == "bearer" and len(m["value"]) >= 16 and stands_for_itself(m["value"]):
                place(m.start("value"), m.end("value"), "authorization")
        for m in OPT.finditer(value):
            if names_secret(m["name"]) and stands_for_itself(m["value"]):
                place(m.start("value"), m.end("value"), "option")
        for m in NAME.finditer(value):
            bare = BARE.match(value, m.end())
            if bare and names_secret(m["name"]) and stands_for_itself(bare.group().rstrip(".,")):
                place(bare.start(), bare.start() + len(bare.group().rstrip(".,")), "named")

    scan(text, add)
    for m in PEM.finditer(text):
        if _key_follows(text, m.end()):
            stop = re.compile(r"-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----").search(text, m.end())
            add(m.start(), stop.end() if stop else m.end(), "private_key")
    for m in NOTE.finditer(text):
        if stands_for_itself(m["value"]):
            add(m.start("value"), m.end("value"), "login_note")
    for value, pieces, first in _literals(text):
        def place(start: int, end: int, kind: str, pieces=pieces) -> None:
            for at, begin, stop in pieces:
                if at <= start < at + stop - begin:
                    add(begin + start - at, min(stop, begin + end - at), kind)
                elif start < at < end and len(pieces) > 1:
                    found.setdefault(begin, (min(stop, begin + end - at), "joined"))

        if len(pieces) > 1:
            scan(value, place)
        line = text.rfind("\n", 0, first) + 1
        before = re.search(r"(?P<name>[A-Za-z_$@][\w$.-]*)[\"'`\]]*[ \t]*(?::[ \t]*[\w<>\[\]. ]+)?(?::=|=>|[:=]|[ \t])[ \t]*[(\[{]?[ \t]*(?:u8|R|L|r|b|f)?$", text[line:first])
        if not before and not text[line:first].strip():  # the value on a line below its name
            above = text[:line].rstrip()
            before = re.search(r"(?P<name>[A-Za-z_$@][\w$.-]*)[\"'`\]]*[ \t]*(?::=|=>|[:=])[ \t]*[(\[{\\]*$", above[above.rfind("\n") + 1:])
        if before and names_secret(before["name"]) and stands_for_itself(value) and not PEM.search(value):
            place(0, len(value), "named")
    out, last = [], -1
    for start in sorted(found):
        end, kind = found[start]
        if start >= last:
            out.append((start, end, kind))
            last = end
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each credential blanked by as many asterisks per line, so that quotes, line ends and everything around them stay valid."""
    for start, end, _ in sorted(spans, reverse=True):
        text = text[:start] + re.sub(r"[^\r\n\"'`\\]", "*", text[start:end]) + text[end:]
    return text


# --- the index

def required(pattern: str) -> list[str]:
    """Lower-case literals of which a match contains at least one, each of three characters or more; derived from the parsed expression."""
    def walk(tree) -> tuple[list[str] | None, list[str]]:
        """The strings the tree may be as a whole (None: unknown), and the best set of required literals within."""
        exact: list[str] | None = [""]
        best: list[str] = []

        def keep(options):
            nonlocal best
            if options and min(map(len, options)) >= 3 and (not best or min(map(len, options)) > min(map(len, best))):
                best = options

        for op, arg in tree:
            if op is sre.LITERAL:
                here, inner = [chr(arg).lower()], []
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 6:
                here, inner = sorted({chr(a).lower() for _, a in arg}), []
            elif op is sre.SUBPATTERN:
                here, inner = walk(arg[3])
            elif op is sre.BRANCH:
                each = [walk(b) for b in arg[1]]
                here = [x for e, _ in each for x in e] if all(e is not None for e, _ in each) else None
                inner = [x for _, b in each for x in b] if all(b for _, b in each) else []
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                once, inner = walk(arg[2])
                keep(inner)
                if once is not None and exact is not None and len(exact) * len(once) <= 64:  # what stands before goes on into the first copy
                    keep([a + b for a in exact for b in once])
                here = None
            elif op in (sre.ASSERT, sre.ASSERT_NOT, sre.AT):
                continue
            else:
                here, inner = None, []
            keep(inner)
            if here is not None and exact is not None and len(exact) * len(here) <= 64:
                exact = [a + b for a in exact for b in here]
            else:
                keep(exact or [])
                exact = here if here is not None else [""]
                if here is None:
                    keep(inner)
            keep(exact)
        whole = exact if exact is not None else None
        return (whole if all(o in (sre.LITERAL, sre.IN, sre.SUBPATTERN, sre.BRANCH, sre.ASSERT, sre.ASSERT_NOT, sre.AT) for o, _ in tree) else None), best

    return walk(sre_parse.parse(pattern))[1]


def detections() -> list[str]:
    """The expressions of :func:`find` that tell a credential by themselves; named values and options are told by the words of :func:`names_secret`."""
    return [*TOKEN_FORMS.values(), PRIVATE_KEY, LOGIN_ADDRESS, HEADER, LOGIN_NOTE]


def wanted() -> list[tuple[str, ...]]:
    """Lower-case literals of which a text that :func:`find` reports contains all of at least one tuple, itself or in its joined strings.

    From the expressions, and from the words that name a credential: each word stands in the name as it is, and of a pair both do, whatever is between them.
    """
    every = {(x,) for p in detections() for x in required(p)} | {(w,) for w in SECRET_WORDS} | set(SECRET_PAIRS)
    alone = {x for x, *more in every if not more}
    return sorted(x for x in every if not any(y in a and x != (y,) for a in x for y in alone))  # one that contains another needs no postings of its own


def literals() -> list[str]:
    """Those of :func:`wanted` that stand alone."""
    return [x for x, *more in wanted() if not more]


def _code(gram: str) -> int:
    code = int.from_bytes(gram.encode("latin-1"))
    return code if len(gram) == 3 else 1 << 24 | code


def grams_of(literal: str) -> list[int]:
    """Codes of the trigrams of a literal; of one of two letters, the code of the pair."""
    width = min(3, len(literal))
    return sorted({_code(literal[i:i + width]) for i in range(len(literal) - width + 1)})


def needed_grams(every: tuple[str, ...]) -> list[int]:
    return sorted({g for x in every for g in grams_of(x)})


def _folded(text: str) -> bytes:
    """Lower case, with the letters that an expression without regard to case takes for i and s."""
    return text.replace("\u0130", "i").lower().replace("\u0131", "i").replace("\u017f", "s").encode("utf-8", "surrogatepass")


def _read_texts(text: str) -> Iterator[str]:
    """What :func:`find` reads of a text: itself and its strings as they are joined."""
    yield text
    if JOIN.search(text):
        yield from (value for value, pieces, _ in _literals(text) if len(pieces) > 1)


def _postings(grams: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = np.zeros(1 << 25, bool)
        need[grams] = True
        schema = pa.schema([("gram", pa.int32()), ("chunks", pa.list_(pa.int64()))])
        for batch in batches:
            texts, owners = [], []
            for k, source in enumerate(batch.column("source").to_pylist()):
                for x in _read_texts(source):
                    texts.append(_folded(x) + b"\n")  # no literal has a line feed, so none goes on into the next text
                    owners.append(k)
            keys = batch.column("chunk").to_numpy()
            data = np.frombuffer(b"".join(texts) + b"\n", np.uint8)
            if not texts:
                continue
            ends, owners = np.cumsum([len(t) for t in texts]), np.array(owners)
            pairs = data[:-1].astype(np.int32) << 8 | data[1:]
            found = []
            for codes in (pairs | 1 << 24, pairs[:-1] << 8 | data[2:]):
                at = np.flatnonzero(need[codes])
                found.append(codes[at].astype(np.int64) << 32 | owners[np.searchsorted(ends, at, "right")])
            found = np.unique(np.concatenate(found))
            gram, chunk = found >> 32, found & 0xFFFFFFFF
            starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]]) if len(gram) else np.zeros(0, np.int64)
            offsets = np.r_[starts, len(gram)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[chunk], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(gram[starts].astype(np.int32)), lists], schema=schema)

    return run


def trigram_index(chunks: DataFrame, grams: list[int]) -> DataFrame:
    """``gram, chunks``: posting lists over ``chunk, source`` for the given trigrams; one list per trigram and batch of rows, so no list grows with the table."""
    return written(chunks.mapInArrow(_postings(grams), "gram int, chunks array<bigint>"), "trigrams")


def candidate_chunks(index: DataFrame, every: list[tuple[str, ...]]) -> DataFrame:
    """``chunk`` of those that contain all trigrams of one of the tuples of literals: the intersection of its postings."""
    rows = [(n, g, len(needed_grams(x))) for n, x in enumerate(every) for g in needed_grams(x)]  # as many as the detections have trigrams
    needs = index.sparkSession.createDataFrame(rows, "literal int, gram int, needed int")
    hits = index.join(needs, "gram").select("literal", "needed", F.explode("chunks").alias("chunk"))
    return hits.groupBy("chunk", "literal").agg(F.count("*").alias("n"), F.first("needed").alias("needed")).where("n >= needed").select("chunk").distinct()


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for id_, start, text in zip(batch["id"], batch["line_start"], batch["source"]):
            spans = find(text)
            if spans:
                lines = sorted({int(start) + text.count("\n", 0, s) for s, _, k in spans if k != "joined"}) if start == start and start is not None else []
                rows.append((id_, lines, sorted({k for _, _, k in spans if k != "joined"}), redact(text, spans)))
        yield pd.DataFrame(rows, columns=["id", "lines", "kinds", "redacted"])


def credential_leaves(code: DataFrame) -> DataFrame:
    """``id, lines, kinds, redacted``: leaves with credentials, the lines of the file on which they begin, and the source with them blanked.

    Rows without id or source are left out; exact duplicates count once; a row without ``line_start`` has no lines. Sources are read whole.
    """
    every = wanted()
    leaves = code.where("source is not null and id is not null").select("id", "line_start", "source")
    chunks = leaves.select(F.xxhash64("id", "source").alias("chunk"), "source")
    index = trigram_index(chunks, sorted({g for x in every for g in needed_grams(x)}))
    some = candidate_chunks(index, every)
    rows = leaves.withColumn("chunk", F.xxhash64("id", "source")).join(some, "chunk", "left_semi").drop("chunk")
    return rows.mapInPandas(_verify, "id string, lines array<int>, kinds array<string>, redacted string").distinct()


def credential_lines(code: DataFrame) -> DataFrame:
    """``id, line_no`` of each line on which a credential begins."""
    return credential_leaves(code).select("id", F.explode("lines").alias("line_no")).distinct()
