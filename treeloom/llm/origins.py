"""Files nobody wrote by hand for their repository: generated, minified, vendored, or data in the dress of code.

Everything is told by clusters of token shingles with identifiers masked. MinHash bands propose pairs that are verified
on the shingle sets. Whole files: links across repositories show vendoring. With literals masked too, files of one
repository that share their forms are a generator's family, and so are the pieces (declarations, statements) of a file
of which eight or more are linked: a file that is mostly such pieces is generated, or minified where it is packed into
long lines. The same of pieces that are literals only shows data.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.functions.text import first_segment
from treeloom.lineage import written
from treeloom.llm.files import whole_files
from treeloom.llm.syntax import languages as grammars
from treeloom.operators.components import components

LANGUAGES = ["julia", "cpp", "python", "javascript"]
#: 40 bands of 8 rows propose a pair of similarity 0.8 with a probability of 0.9994, one of 0.4 with 0.026; forms are compared in one repository and take 20 of 6 (0.998 and 0.08), pieces in one file and take 10 of 4 (0.995 and 0.23).
WIDTH, BANDS, BAND_ROWS, FORM_BANDS, FORM_ROWS, PIECE_BANDS, PIECE_ROWS, SIMILAR = 5, 40, 8, 20, 6, 10, 4, 0.8
#: An original: three names and a tenth of all begin with the name of its repository.
OWN_NAMES, OWN_SHARE = 3, 0.1
#: Smaller sets agree by chance once names are masked: such files are compared whole, token by token, if they have this many tokens and are valid in their language (an error page stored in place of a file is no copy of it).
MASKED_FROM, LEAST_COPY = 32, 20
#: A family of files of a repository: three or more of MASKED_FROM forms or more, which are alike by nine tenths: names and literals are masked, and a writer's long files have much of the rest in common.
FAMILY_FILES, FAMILY_SIMILAR = 3, 0.9
#: A family of pieces: eight or more in one file; half of a file's tokens stand in such pieces if it is generated, nine tenths of its characters in pieces that are literals only if it is data.
FAMILY_PIECES, FAMILY_SHARE, LITERAL_SHARE = 8, 0.5, 0.9
#: A piece of code has six tokens or more, one of a literal is a line of it, at most forty characters; packed lines hold 25 tokens on average besides literals and commas.
PIECE_TOKENS, LITERAL_PIECE, PACKED_TOKENS = 6, 40, 25
PART_FILES = 1_000
# Words that stay as they are when identifiers are masked.
KEYWORDS = frozenset(
    "function end def return for in if class import export from const let var struct using while else elif elseif auto int void bool char float double long async await public private protected static new this self "
    "nothing null nullptr None true false True False try catch except finally throw raise switch case default break continue do begin module template namespace typedef enum lambda yield with as and or not is".split())
STRINGS = r'"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|R"\w*\(.*?\)\w*"|`(?:[^`\\]|\\.)*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
REST = r"|\d[\w.]*|[^\W\d]\w*|[^\s\w]"
# Words that head a declaration of members, what stands between literals, and tokens that go on with what an unindented line before them began.
CONTAINERS = frozenset("class struct namespace module baremodule interface enum union extern trait".split())
BETWEEN = frozenset("[](){}:;=+-")
GOES_ON = frozenset("end else elseif elif except finally catch ) ] }".split())
HASH_COMMENTS = re.compile(STRINGS + r"|#=.*?=#|#[^\n]*|\n[ \t]*" + REST, re.S)
SLASH_COMMENTS = re.compile(STRINGS + r"|//[^\n]*|/\*.*?\*/" + REST, re.S)
VALUES = re.compile(r"[\w+/=.-]+|[^\s\w]")
PROSE = re.compile(r"[^\W\d_]+ [^\W\d_]+ [^\W\d_]+")
SETS = "array<struct<masked: boolean, id: bigint, size: int, shingles: array<int>, bands: array<bigint>>>"
PIECES = "array<struct<literal: boolean, id: bigint, n: int, weight: int, shingles: array<int>, bands: array<bigint>>>"
FEATURES = (
    "file string, language string, repository string, n_tokens int, n_chars int, packed boolean, own_names int, n_names int, "
    f"sets {SETS}, form_id bigint, form_set array<int>, form_bands array<bigint>, pieces {PIECES}")
COLUMNS = ["file", "language", "repository", "n_tokens", "n_chars", "packed", "own_names", "n_names", "sets", "form_id", "form_set", "form_bands", "pieces"]
_RNG = np.random.default_rng(7)
_MULTIPLY, _ADD = _RNG.integers(0, 1 << 31, (2, BANDS * BAND_ROWS), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


class _Codes(dict):
    """Token -> a number with literals kept; the number's lowest two bits tell masked identifiers (1), literals (2) and commas (3)."""

    def __missing__(self, token):
        c = token[0]
        if c.isalpha() or c == "_":
            value = zlib.crc32(token.encode()) << 2 if token in KEYWORDS else 1
            if token[-1] in "\"'" and len(token) > 1:
                value = zlib.crc32(token.encode()) << 2 | 2
        elif c.isdigit() or c in "\"'`" and len(token) > 1:
            value = zlib.crc32(token.encode()) << 2 | 2
        else:
            value = zlib.crc32(token.encode()) << 2 | (3 if c == "," else 0)
        if len(self) > 500_000:
            self.clear()
        self[token] = value
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(31)
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of five codes; a text of fewer tokens is one shingle."""
    if len(codes) == 0:
        return np.zeros(0, np.uint64)
    n = max(1, len(codes) - WIDTH + 1)
    out = np.full(n, 17, np.uint64)
    for k in range(min(WIDTH, len(codes))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n].astype(np.uint64))
    return out


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = BAND_ROWS) -> list[int]:
    """One key per band of MinHash rows."""
    k = bands * rows
    mixed = (_mix(values.astype(np.uint64)) >> np.uint64(16)).astype(np.uint32)
    least = (mixed[:, None] * _MULTIPLY[:k] + _ADD[:k]).min(axis=0).reshape(bands, rows).astype(np.uint64)
    keys = np.zeros(bands, np.uint64)
    for r in range(rows):
        keys = _mix(keys * np.uint64(31) + least[:, r])
    return (keys ^ np.arange(bands, dtype=np.uint64)).view(np.int64).tolist()


def counted(values: np.ndarray) -> np.ndarray:
    """A set that tells how often each hash occurs: of equal ones each counts with its number. Long files of one style have all their forms in common, but not as often."""
    values = np.sort(values)
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    number = np.arange(len(values)) - np.repeat(starts, np.diff(np.r_[starts, len(values)]))
    return np.unique(_mix(values * np.uint64(31) + number.astype(np.uint64)).astype(np.uint32))


def _set_of(codes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(codes).astype(np.uint32))


def _id_of(values: np.ndarray) -> int:
    """A hash of a set."""
    return int.from_bytes(blake2b(values.tobytes(), digest_size=8).digest(), signed=True)


def cut_by_lines(tokens: list[str]) -> tuple[list[str], list[int]]:
    """Tokens without line ends, and where pieces begin: at lines without indentation, and at those of the members of a class or module."""
    out, cuts, depth, level, indent, at_start, opened = [], [], 0, 0, 0, True, False
    for t in tokens:
        if t[0] == "\n":
            at_start, indent = True, len(t) - 1
            continue
        if at_start and depth <= 0:
            if opened or indent < level:
                level, opened = indent, False
            if indent <= level and t not in GOES_ON:
                cuts.append(len(out))
                opened = t in CONTAINERS
        at_start = False
        out.append(t)
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth -= 1
    return out, cuts


def cut_by_braces(tokens: list[str]) -> list[int]:
    """Where pieces begin: after a semicolon or closing brace that stands in no bracket but those of classes, structures and namespaces."""
    cuts, begin, open_at = [0] if tokens else [], 0, []  # open_at: whether each open bracket holds members
    for i, t in enumerate(tokens):
        ends = False
        if t in "([{":
            holds = t == "{" and all(open_at) and "(" not in tokens[begin:i] and any(x in CONTAINERS for x in tokens[begin:i])
            open_at.append(holds)
            ends = holds
        elif t in ")]}":
            if open_at:
                open_at.pop()
            ends = t == "}" and all(open_at)
        elif t == ";":
            ends = all(open_at)
        if ends and i + 1 < len(tokens):
            begin = i + 1
            cuts.append(begin)
    return cuts


@lru_cache(50_000)
def _piece(codes: bytes) -> tuple[int, np.ndarray]:
    """Id and set of a piece's codes."""
    values = _set_of(np.frombuffer(codes, np.int64))
    return _id_of(values), values


def _literal_runs(tokens: list[str], kinds: list[int]) -> Iterator[str]:
    """Stretches of a file that are nothing but literals and what stands between them."""
    run: list[str] = []
    for t, k in zip(tokens, kinds):
        if k >= 2 or t in BETWEEN:
            run.append(t)
        elif run:
            yield "".join(run)
            run = []
    yield "".join(run)


def pieces_of(tokens: list[str], masked: np.ndarray, kinds: list[int], cuts: list[int]) -> list[dict]:
    """``literal, id, n, weight, shingles, bands`` of the distinct pieces of a file: declarations and statements by tokens, lines of literals by characters.

    Only pieces that may be of a family are returned: eight pieces have sets of a size that a similarity of 0.8 allows; and only if those make up the share of the file that decides something.
    """
    found: dict[tuple, list[int]] = {}
    whole = sum(map(len, tokens))
    spans = [(a, b) for a, b in zip(cuts, [*cuts[1:], len(tokens)]) if b - a >= PIECE_TOKENS]
    if len(spans) >= FAMILY_PIECES and sum(b - a for a, b in spans) >= FAMILY_SHARE * len(tokens):
        for a, b in spans:
            seen = found.setdefault((False, masked[a:b].tobytes()), [0, 0])
            seen[0] += 1
            seen[1] += b - a
    between = sum(len(t) for t, k in zip(tokens, kinds) if k >= 2 or t in BETWEEN)
    for run in _literal_runs(tokens, kinds) if between >= LITERAL_SHARE * whole else ():
        for line in run.split("\n"):
            for a in range(0, len(line), LITERAL_PIECE):
                part = line[a:a + LITERAL_PIECE]
                if not PROSE.search(part) and not part.isspace():
                    codes = np.array([1 if x[0].isalnum() or x[0] in "+/=._-" else ord(x[0]) << 2 for x in VALUES.findall(part)], np.int64)
                    seen = found.setdefault((True, codes.tobytes()), [0, 0])
                    seen[0] += 1
                    seen[1] += len(part)
    out = []
    for literal, all_of_it, share in ((False, len(tokens), FAMILY_SHARE), (True, whole, LITERAL_SHARE)):
        own = {codes: counts for (sort, codes), counts in found.items() if sort == literal}
        if sum(n for n, _ in own.values()) < FAMILY_PIECES or sum(weight for _, weight in own.values()) < share * all_of_it:
            continue
        merged: dict[int, list] = {}
        for codes, (n, weight) in own.items():
            id_, values = _piece(codes)
            seen = merged.setdefault(id_, [0, 0, values])
            seen[0] += n
            seen[1] += weight
        sizes = np.array([len(values) for _, _, values in merged.values()])
        many = np.array([n for n, _, _ in merged.values()])
        order = np.argsort(sizes)
        ahead, ordered = np.r_[0, np.cumsum(many[order])], sizes[order]
        near = ahead[np.searchsorted(ordered, sizes / SIMILAR, "right")] - ahead[np.searchsorted(ordered, sizes * SIMILAR, "left")]
        kept = [(id_, *x) for (id_, x), k in zip(merged.items(), near.tolist()) if k >= FAMILY_PIECES]
        if sum(weight for _, _, weight, _ in kept) >= share * all_of_it:
            out += [{"literal": literal, "id": id_, "n": n, "weight": weight, "shingles": values.view(np.int32), "bands": band_keys(values, PIECE_BANDS, PIECE_ROWS)} for id_, n, weight, values in kept]
    return out


def _features():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code_of = _Codes()
        with np.errstate(over="ignore"):
            for batch in batches:
                rows, held = [], 0
                for file, language, text in zip(batch["file"], batch["language"], batch["text"]):
                    if language in ("python", "julia"):
                        tokens, cuts = cut_by_lines([t for t in HASH_COMMENTS.findall(text) if t[0] != "#"])
                    else:
                        tokens = [t for t in SLASH_COMMENTS.findall(text) if t[:2] not in ("//", "/*")]
                        cuts = cut_by_braces(tokens)
                    codes = np.fromiter(map(code_of.__getitem__, tokens), np.int64, len(tokens))
                    kinds = codes & 3
                    masked = np.where(kinds == 2, 2, codes)
                    table = kinds >= 2  # of a table's literals one counts
                    kept, forms = _set_of(codes), counted(shingles(masked[~(table & np.r_[False, table][:-1])]))
                    sets = []
                    if len(kept) >= MASKED_FROM:
                        sets.append({"masked": True, "id": _id_of(kept), "size": len(kept), "shingles": kept.view(np.int32), "bands": band_keys(kept)})
                    elif len(tokens) >= LEAST_COPY and grammars()[language].accepts(text):
                        exact = int.from_bytes(blake2b("\0".join(tokens).encode("utf-8", "surrogatepass"), digest_size=8).digest(), signed=True)
                        sets.append({"masked": False, "id": exact, "size": len(kept), "shingles": [], "bands": []})
                    repository = file.split("/", 1)[0]
                    own, names = 0, {t for t, k in zip(tokens, kinds.tolist()) if k == 1}
                    for name in names:
                        first = re.match(r"[a-z]{4,}|[A-Z]{4,}", name)
                        own += bool(first and len(first.group()) < len(name) and repository.lower().startswith(first.group().lower()))
                    rows.append((
                        file, language, repository, len(tokens), sum(map(len, tokens)), int((kinds < 2).sum()) >= PACKED_TOKENS * (text.count("\n") + 1), own, len(names), sets, _id_of(forms) if len(forms) else None,
                        forms.view(np.int32), band_keys(forms, FORM_BANDS, FORM_ROWS) if len(forms) else [], pieces_of(tokens, masked, kinds.tolist(), cuts)))
                    held += len(tokens)
                    if held > 500_000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=COLUMNS)

    return run


def _similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        kept = []
        for x, y, least in zip(batch["shingles_a"], batch["shingles_b"], batch["least"]):
            both = len(np.intersect1d(x, y, assume_unique=True))
            kept.append(both >= least * (len(x) + len(y) - both))
        yield batch.loc[kept, ["a", "b"]]


def near_duplicates(sets: DataFrame) -> DataFrame:
    """``a, b`` with a < b: sets (``id, shingles, bands``) whose Jaccard similarity is that of their column ``least``, 0.8 without it, or more, each pair once.

    Pairs come from equal bands and are verified on the whole sets. A band key of very many sets is cut into parts on one side. Sets of different ``least`` must not share bands.
    """
    if "least" not in sets.columns:
        sets = sets.withColumn("least", F.lit(SIMILAR))
    keys = sets.select("id", "least", F.size("shingles").alias("n"), F.explode(F.array_distinct("bands")).alias("band"))
    sizes = keys.groupBy("band").agg(F.count("*").alias("held")).where("held > 1").select("band", F.ceil(F.col("held") / PART_FILES).cast("bigint").alias("parts"))
    inside = written(keys.join(sizes, "band"), "bands")
    a = inside.select("band", "least", F.col("id").alias("a"), F.col("n").alias("n_a"), F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    b = inside.select("band", F.col("id").alias("b"), F.col("n").alias("n_b"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    near = (F.col("n_a") >= F.col("least") * F.col("n_b")) & (F.col("n_b") >= F.col("least") * F.col("n_a"))  # sets of other sizes can't be as similar
    pairs = written(a.join(b, ["band", "part"]).where("a < b").where(near).select("a", "b", "least").distinct(), "pairs")  # few pairs are sent to the sets, many are joined with them
    pairs = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("shingles_a")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("shingles_b")), "b")
    return pairs.select("a", "b", "least", "shingles_a", "shingles_b").mapInPandas(_similar, "a bigint, b bigint")


def _tagged(space: int, *key: str) -> Column:
    """Ids of the sets of a space: a hash whose lowest two bits name it."""
    return F.xxhash64(*key).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(space)).alias("id")


def _in_space(links: DataFrame, space: int) -> DataFrame:
    """The links of a space in both directions."""
    own = links.where(F.col("a").bitwiseAND(F.lit(3)) == space)
    return own.unionByName(own.select(F.col("b").alias("a"), F.col("a").alias("b")))


def several_files(forms: DataFrame, ends: DataFrame) -> DataFrame:
    """``repository, form_id`` of the sets of forms (``id, repository, form_id, n_files``) whose family, linked within the repository by ``ends``, has three files or more.

    In a family of three files or more, each set has three files around it or is linked to one that has.
    """
    counts = forms.select("id", "n_files")
    near = ends.join(counts.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n_files").alias("n"))
    around = counts.join(near, "id", "left").select("id", (F.col("n_files") + F.coalesce("n", F.lit(0))).alias("n")).where(F.col("n") >= FAMILY_FILES).select("id")
    family = around.unionByName(ends.join(around.withColumnRenamed("id", "b"), "b", "left_semi").select(F.col("a").alias("id"))).distinct()
    return forms.join(family, "id", "left_semi").select("repository", "form_id")


def piece_families(pieces: DataFrame, ends: DataFrame) -> DataFrame:
    """``file, literal, family, weight`` of the pieces (``id, file, literal, piece_id, n, weight``) that stand in a family of their file: linked by ``ends`` to pieces of it that make eight with them. ``family`` is the least linked set's id."""
    counts = pieces.select("id", "piece_id", "n")
    near = ends.join(counts.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("others"), F.min("piece_id").alias("least"))
    around = pieces.select("id", "file", "literal", "piece_id", "n", "weight").join(near, "id", "left")
    return around.where(F.col("n") + F.coalesce("others", F.lit(0)) >= FAMILY_PIECES).select("file", "literal", F.least("piece_id", F.coalesce("least", "piece_id")).alias("family"), "weight")


def file_origins(code: DataFrame, languages: DataFrame, with_classes: bool = True) -> DataFrame:
    """``file, language, origin, class_id, n_links, family_share``: ``generated``, ``minified``, ``data``, ``vendored`` or ``own`` for every file in julia, cpp, python or javascript.

    data: nine tenths of the file's characters stand in families (:func:`piece_families`) of pieces that are literals only; generated: half of its tokens in families of other pieces, or it is of a
    family of files of its repository (:func:`several_files`); such a file is ``minified`` if its lines are packed, and so is one that is packed without repeating itself, which has no link to show.
    vendored: none of these, and similar to a file of another repository, unless it is the original: three or more of its names, and a tenth of all, begin with the name of its own repository, and
    no file similar to it bears out another repository in that way. Files of less than 32 shingles are similar if they are valid in their language and all their tokens, twenty or more, are equal.

    class_id: equal for files linked by a similarity of 0.8 or more (with_classes; copies of a set of shingles count as one), of generated, minified and data files the family that holds most of them;
    n_links: distinct similar sets besides its own; family_share: the share of its tokens (data: of its characters) in families, zero where the sizes of its pieces already tell that it stays below what
    decides. Comments count for nothing, so notices don't decide. Exact duplicate rows count once; files without any text in ``code`` are left out; an empty file is ``own``.
    """
    features = written(whole_files(code, languages, LANGUAGES).mapInPandas(_features(), FEATURES), "features")
    # three spaces of sets, linked at once: whole files (equal ones are one), forms of a repository's files, pieces of a file
    named_own = (F.col("own_names") >= OWN_NAMES) & (F.col("own_names") >= OWN_SHARE * F.col("n_names"))
    files = features.select("file", "repository", F.when(named_own, F.col("repository")).alias("claim"), F.explode("sets").alias("s")).select("file", "repository", "claim", F.col("s.masked").alias("masked"), F.col("s.id").alias("set_id"), F.col("s.shingles").alias("shingles"), F.col("s.bands").alias("bands"))
    files = files.withColumn("id", _tagged(0, "masked", "set_id"))
    whole = files.groupBy("id").agg(F.first("shingles").alias("shingles"), F.first("bands").alias("bands"), F.min("repository").alias("r1"), F.max("repository").alias("r2"), F.min("claim").alias("c1"), F.max("claim").alias("c2"))
    forms = features.where(F.size("form_set") >= MASKED_FROM).groupBy("repository", "form_id").agg(F.first("form_set").alias("shingles"), F.first("form_bands").alias("bands"), F.count("*").alias("n_files"))
    pieces = features.select("file", F.explode("pieces").alias("p")).select("file", F.col("p.literal").alias("literal"), F.col("p.id").alias("piece_id"), F.col("p.n").alias("n"), F.col("p.weight").alias("weight"), F.col("p.shingles").alias("shingles"), F.col("p.bands").alias("bands"))
    sets = whole.select("id", "shingles", "bands", F.lit(SIMILAR).alias("least"), "r1", "r2", "c1", "c2")
    sets = sets.unionByName(forms.select(_tagged(1, "repository", "form_id"), "shingles", F.transform("bands", lambda x: F.xxhash64("repository", x)).alias("bands"), F.lit(FAMILY_SIMILAR).alias("least"), "repository", "form_id", "n_files"), allowMissingColumns=True)
    sets = sets.unionByName(pieces.select(_tagged(2, "file", "literal", "piece_id"), "shingles", F.transform("bands", lambda x: F.xxhash64("file", "literal", x)).alias("bands"), F.lit(SIMILAR).alias("least"), "file", "literal", "piece_id", "n", "weight"), allowMissingColumns=True)
    sets = written(sets, "sets")
    links = written(near_duplicates(sets.select("id", "shingles", "bands", "least")), "links")
    space = lambda k: sets.where(F.col("id").bitwiseAND(F.lit(3)) == k)

    totals = piece_families(space(2), _in_space(links, 2)).groupBy("file", "literal", "family").agg(F.sum("weight").alias("weight")).groupBy("file").agg(
        F.sum(F.when(F.col("literal"), F.col("weight"))).alias("literals"), F.sum(F.when(~F.col("literal"), F.col("weight"))).alias("tokens"),
        F.max_by("family", F.when(F.col("literal"), F.struct("weight", "family"))).alias("data_family"), F.max_by("family", F.when(~F.col("literal"), F.struct("weight", "family"))).alias("code_family"))
    several = several_files(space(1), _in_space(links, 1)).withColumn("of_several", F.lit(True))
    own = space(0).select("id", "r1", "r2", "c1", "c2")
    reach = _in_space(links, 0).join(own.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
        F.min("r1").alias("n1"), F.max("r2").alias("n2"), F.min("c1").alias("m1"), F.max("c2").alias("m2"), F.count("*").alias("n_links"))
    reach = own.join(reach, "id", "left").select(
        "id", F.least("c1", "m1").alias("first_claim"), F.greatest("c2", "m2").alias("last_claim"), F.least("r1", F.coalesce("n1", "r1")).alias("lo"), F.greatest("r2", F.coalesce("n2", "r2")).alias("hi"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    reach = reach.withColumn("class_id", F.col("id"))
    if with_classes:
        found = components(links.where(F.col("a").bitwiseAND(F.lit(3)) == 0)).select(F.col("node").alias("id"), "component")
        reach = reach.join(found, "id", "left").withColumn("class_id", F.coalesce("component", "class_id")).drop("component")
    original = F.coalesce(F.col("claim").isNotNull() & (F.col("first_claim") == F.col("last_claim")), F.lit(False))
    spread = files.select("file", "id", "claim").join(reach, "id").select("file", ((F.col("lo") < F.col("hi")) & ~original).alias("elsewhere"), "n_links", "class_id")  # a file has one set

    share = F.coalesce(F.col("tokens") / F.col("n_tokens"), F.lit(0.0))
    literals = F.coalesce(F.col("literals") / F.col("n_chars"), F.lit(0.0))
    origin = F.when(literals >= LITERAL_SHARE, "data").when(F.col("packed"), "minified").when(share >= FAMILY_SHARE, "generated").when(F.col("elsewhere"), "vendored").when(F.col("of_several"), "generated").otherwise("own")
    judged = features.select("file", "language", "repository", "n_tokens", "n_chars", "packed", "form_id").join(totals, "file", "left").join(spread, "file", "left").join(several, ["repository", "form_id"], "left")
    judged = judged.withColumn("origin", origin)
    family = F.when(F.col("origin") == "data", F.col("data_family")).when(F.col("origin").isin("generated", "minified"), F.coalesce("code_family", F.xxhash64("repository", "form_id")))
    return judged.select(
        "file", "language", "origin", F.coalesce(family, "class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.round(F.when(F.col("origin") == "data", literals).otherwise(share), 6).alias("family_share"))


def foreign_files(code: DataFrame, languages: DataFrame) -> DataFrame:
    """``path`` of the files that are not hand-written for their repository."""
    return file_origins(code, languages, with_classes=False).where("origin <> 'own'").select(F.col("file").alias("path"))


def hand_written_listing(files: DataFrame, code: DataFrame, languages: DataFrame) -> DataFrame:
    """``path, repository`` of the newest listing of each path in ``files`` whose text in ``code`` is hand-written."""
    from treeloom.functions.text import clean_path

    own = file_origins(code, languages, with_classes=False).where("origin = 'own'").select(F.col("file").alias("path"))
    return files.select(clean_path(F.col("path")).alias("path")).distinct().join(own, "path", "left_semi").select("path", first_segment(F.col("path")).alias("repository"))
