"""Syntax of six languages as lexers and grammars for the generalised parser.

A text becomes a string of token classes. Bracketed groups, innermost first, are replaced by one
class that stands for the set of rules their content derives; what is left are short pieces
(statements, arguments, lines). Each distinct piece is parsed once per worker by
:class:`~treeloom.llm.gll.Grammar`, so repeated code costs a look-up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from treeloom.llm.gll import Grammar

MEMO_ENTRIES = 200_000


class Rejected(Exception):
    """No dialect accepts the text."""


class Terminals(dict):
    """The set of terminals of a character; none for characters that stand for no token."""

    def __missing__(self, key):
        return frozenset()


class Alphabet(dict):
    """Characters for sets of terminals, made when first asked for; ``sets`` is the way back."""

    def __init__(self):
        self.sets: dict[str, frozenset] = Terminals()

    def __missing__(self, key):
        c = chr(0x4E00 + len(self.sets))
        self[key], self.sets[c] = c, key if isinstance(key, frozenset) else frozenset([key])
        return c

    def of(self, *terminals: str) -> str:
        return self[frozenset(terminals)]


class Memo(dict):
    """Results by piece; emptied when it has grown to its bound."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, key):
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[key] = value = self.f(key)
        return value


GROUP = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")
NEWLINE, ERROR = "\n", "err"
WORD = r"[^\W\d][\w]*"


class Language:
    """One language: ``token`` splits, ``classify`` gives a token's classes, ``grammar`` and the ``*_lists`` tell what a group may be.

    lists: for each bracket (and ``top``) the rules its content may derive, as name -> (separator, rule of a piece, may end with the separator).
    """

    grammar: Grammar
    token: re.Pattern
    words: dict[str, tuple]
    dialects: tuple[str, ...]
    lists: dict[str, dict[str, tuple]] = {}

    def __init__(self):
        self.abc = Alphabet()
        comma = self.abc.of(",")
        self.repeated = re.compile(f"((?:[^{comma}]{{1,6}}{comma}))\\1{{2,}}")  # a list of equal elements is as valid as one of two of them
        self.tokens = Memo(self.classes_of)
        self.groups = Memo(self.group)
        self.pieces = Memo(lambda key: self.grammar.accepted((key[0],), self.repeated.sub(r"\1\1", key[1]), self.abc.sets))

    def classes_of(self, token: str) -> str:
        names = self.words.get(token)
        return self.abc.of(*names) if names else self.classify(token)

    def classify(self, token: str) -> str:
        raise NotImplementedError

    def lexed(self, text: str) -> str:
        return "".join(map(self.tokens.__getitem__, self.token.findall(text)))

    def is_list(self, content: str, separator: str | None, rule: str, open_end: bool, whole: str) -> bool:
        if separator is None or any(w in content for w in whole):
            return bool(self.pieces[(rule if separator is None else rule + "List", content)])
        parts = content.split(separator)
        if open_end and parts[-1] == "":
            parts.pop()
        return all(self.pieces[(rule, p)] for p in parts)

    def inside(self, bracket: str, content: str) -> str:
        return content.replace(NEWLINE, "")

    def group(self, text: str) -> str:
        names = self.derives(text[0], self.inside(text[0], text[1:-1]))
        if not names:
            raise Rejected
        return self.abc.of(*names)

    def derives(self, bracket: str, content: str) -> list[str]:
        return [name for name, (separator, rule, open_end, whole) in self.lists[bracket].items() if self.is_list(content, separator, rule, open_end, whole)]

    def reduced(self, s: str) -> str:
        again = 1
        while again:
            s, again = GROUP.subn(lambda m: self.groups[m.group()], s)
        if any(c in s for c in "()[]{}"):
            raise Rejected
        return s

    def accepts(self, text: str) -> frozenset:
        """The dialects that accept the text; all of them if it is empty or white space only."""
        if not text.strip():
            return frozenset(self.dialects)
        try:
            return frozenset(self.whole(text.removeprefix("\ufeff")))
        except Rejected:
            return frozenset()

    def whole(self, text: str):
        raise NotImplementedError


class Json(Language):
    dialects = ("json",)
    token = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\b(?:true|false|null)\b|[^ \t\r\n]')
    words = {"true": ("lit",), "false": ("lit",), "null": ("lit",)}
    grammar = Grammar("""
Val: str | lit | obj | arr
Pair: str : Val
""")

    def __init__(self):
        super().__init__()
        comma = self.abc.of(",")
        self.lists = {"{": {"obj": (comma, "Pair", False, "")}, "[": {"arr": (comma, "Val", False, "")}, "(": {}}

    def classify(self, token):
        if len(token) > 1 and token[0] == '"':
            return self.abc.of("str")
        if token in "()[]{}":
            return token
        return self.abc.of(token if token in ",:" else "lit" if token[-1].isdigit() else ERROR)

    def is_list(self, content, *how):
        return content == "" or super().is_list(content, *how)

    def whole(self, text):
        return self.dialects if self.pieces[("Val", self.reduced(self.lexed(text)))] else ()


class Toml(Language):
    dialects = ("toml",)
    token = re.compile(
        r'"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*|\r?\n'
        r"|\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?"
        r"|[+-]?(?:\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?\d[\d_]*)?|inf|nan)(?![\w-])|[A-Za-z0-9_-]+|[^ \t]", re.S)
    words = {"true": ("key", "lit"), "false": ("key", "lit")}
    grammar = Grammar("""
Key: key | str | num | Key . Key
Val: str | num | lit | arr | tab
Pair: Key = Val
Line: % | Pair | head | heads
ArrList: % | Val
Name: Key
Names: head
""")

    def __init__(self):
        super().__init__()
        comma = self.abc.of(",")
        self.lists = {"{": {"tab": (comma, "Pair", False, "")}, "[": {"arr": (comma, "Val", True, ""), "head": (None, "Name", False, ""), "heads": (None, "Names", False, "")}, "(": {}}

    def inside(self, bracket, content):
        return content if bracket == "{" else super().inside(bracket, content)

    def classify(self, token):
        abc, c = self.abc, token[0]
        if c == "#":
            return ""
        if token[-1] == "\n":
            return NEWLINE
        if c in "\"'":
            return abc.of("str") if len(token) > 1 else abc.of(ERROR)
        if token in "()[]{}":
            return token
        if token in ",.=":
            return abc.of(token)
        if re.fullmatch(r"[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d[\d_]*)?(?:[eE][+-]?\d+)?|[+-]?(?:inf|nan)|0x[\da-fA-F_]+|0o[0-7_]+|0b[01_]+|\d{4}-\d\d-\d\d.*|\d\d:\d\d:\d\d.*", token):
            return abc.of("num")
        return abc.of("key") if re.fullmatch(r"[A-Za-z0-9_-]+", token) else abc.of(ERROR)

    def is_list(self, content, *how):
        return content == "" and how[0] is not None or super().is_list(content, *how)

    def whole(self, text):
        return self.dialects if all(self.pieces[("Line", x)] for x in set(self.reduced(self.lexed(text)).split(NEWLINE))) else ()


def fields_close(text: str) -> bool:
    """Whether the fields of a formatted string are closed and hold something; doubled braces are text, quotes within a field are skipped."""
    depth, k, filled = 0, text.find(text[-1]) + 1, False
    while k < len(text):
        c = text[k]
        if c == "{":
            if not depth and text[k + 1:k + 2] == "{":
                k += 1
            else:
                depth, filled = depth + 1, False
        elif c == "}":
            if depth and filled:
                depth -= 1
            elif depth or text[k + 1:k + 2] != "}":
                return False
            else:
                k += 1
        elif depth and c in "\"'" and c != text[-1]:
            k, filled = text.find(c, k + 1), True
            if k < 0:
                return False
        else:
            filled |= not c.isspace()
        k += 1
    return depth == 0


class Python(Language):
    dialects = ("python3.8", "python3.12")
    token = re.compile(
        r'(?i:[rbfu]{0,2})(?:"""(?:[^\\]|\\.)*?"""|\'\'\'(?:[^\\]|\\.)*?\'\'\'|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\')'
        r"|#[^\n]*|\\\r?\n|\n[ \t\f]*|" + WORD +
        r"|(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:D\.(?:D)?|\.D)(?:[eE][+-]?D)?[jJ]?|D[eE][+-]?D[jJ]?|D[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)(?!\w)".replace("D", r"\d(?:_?\d)*") +
        r"|\.\.\.|\*\*=?|//=?|<<=?|>>=?|[-+*/%@&|^<>=!:]=|->|[^\s]", re.S)
    words = {
        **{w: ("op",) for w in "or and // / % << >> & | ^ == != < > <= >=".split()}, "+": ("pm",), "-": ("pm",), "*": ("star",), "**": ("dstar",), "@": ("at",), "~": ("tilde",), "/": ("op", "slash"),
        **{w: ("aug",) for w in "+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split()}, "...": ("num",), ":=": ("walrus",), "->": ("arrow",),
        **{w: (w,) for w in "not in is if else elif for while try except finally with def class lambda return yield await async import from as global nonlocal del assert raise".split()},
        **{w: ("jump",) for w in ("pass", "break", "continue")}, **{w: ("num",) for w in ("True", "False", "None")}, **{w: ("id", w) for w in ("match", "case", "type", "print")},
        **{w: (w,) for w in ", ; : . =".split()}}
    grammar = Grammar("""
Expr: lambda : Expr | lambda LamPars : Expr | Or | Or if Or else Expr
LamPars: LamPar | LamPar , | LamPar , LamPars
LamPar: id | id = Expr | star id | star | dstar id | slash
Or: Un | Un Bin Or
Bin: op | pm | star | dstar | at | in | not in | is | is not
Un: Pre Un | Prim
Pre: pm | tilde | not | await
Prim: Atom Trails
Trails: % | Trail Trails
Trail: . id | pargs | bsub
Atom: id | num | Strs | pexpr | blist | cdict | cset
Strs: str | str Strs
Star: Expr | star Or
Exprs: Star | Star , | Star , Exprs
Named: Expr | id walrus Expr
Arg: Named | id = Expr | star Expr | dstar Expr
ArgList: Named Comp | Args
Args: % | Arg | Arg , | Arg , Args
Comp: for Targets in Or | for Targets in Or CompNext | async Comp
CompNext: Comp | if CompIf | if CompIf CompNext
CompIf: Or | id walrus Expr | lambda : Expr
Target: Place | star Place
Place: id | pexpr | blist | Atom Last | Atom Trails Last
Last: . id | bsub
Targets: Target | Target , | Target , Targets
Elem: Named | star Or | Named Comp
ElemList: % | Elem | Elem , | Elem , ElemList
InPar: Named | Named Comp | star Or | Yield
InParList: Elem | Yield | Elem , | Elem , InParList
DItem: Expr : Expr | dstar Or
DItemList: Expr : Expr Comp | DItems
DItems: % | DItem | DItem , | DItem , DItems
Sub: Named | star Or | Slice
SubList: Sub | Sub , | Sub , SubList
Slice: Opt : Opt | Opt : Opt : Opt
Opt: % | Expr
ParList: % | Front | Front , | Front , Back | Back
Front: Plains | Plains , Dflts | Dflts
Plains: Plain | Plain , Plains
Plain: id Note | slash
Dflts: Dflt | Dflt , Dflts
Dflt: id Note = Expr | slash
Back: star id Stars Keys | star , Key Keys | dstar id Note | dstar id Note ,
Stars: % | : Star
Keys: % | , | , Key Keys | , dstar id Note | , dstar id Note ,
Key: id Note | id Note = Expr
Note: % | : Expr
Import: id | id as id
ImportList: Import | Import , | Import , ImportList
Yield: yield | yield Exprs | yield from Expr
Small: Exprs | Chain | Place aug Rest | Place : Expr | Place : Expr = Rest | jump | return | return Exprs | raise | raise Expr | raise Expr from Expr | import Mods | from Dots import Names | global Ids | nonlocal Ids | del Targets | assert Expr | assert Expr , Expr | Yield | id walrus Expr
Chain: Targets = Rest | Targets = Chain
Rest: Exprs | Yield
Mods: Mod | Mod , Mods
Mod: Dotted | Dotted as id
Dotted: id | id . Dotted
Dots: Dotted | Lead | Lead Dotted
Lead: . | num | . Lead | num Lead
Names: star | ImportList | pnames
Ids: id | id , Ids
Simple: Small | Small ; | Small ; Simple
Alias: type id = Expr | type id bsub = Expr
Body: Simple
IfHead: if Named :
ElifHead: elif Named :
ElseHead: else :
LoopHead: for Targets in Exprs : | while Named : | async for Targets in Exprs :
TryHead: try :
ExceptHead: except : | except Expr : | except Expr as id :
GroupHead: except star Expr : | except star Expr as id :
FinallyHead: finally :
WithHead: with Items : | async with Items :
WithParHead: with pwith : | async with pwith :
Item: Expr | Expr as Target
Items: Item | Item , Items
WithItemList: Item | Item , | Item , WithItemList
DefHead: def id pparams : | def id pparams arrow Expr : | async DefHead
DefTypedHead: def id bsub pparams : | def id bsub pparams arrow Expr : | class id bsub : | class id bsub pargs :
ClassHead: class id : | class id pargs :
DecoHead: at Named
MatchHead: match Exprs :
CaseHead: case Pats : | case Pats if Named :
Pats: Pat | Pat , | Pat , Pats
Pat: Or | Or as id | star id
IfFull: IfHead Body
ElifFull: ElifHead Body
ElseFull: ElseHead Body
LoopFull: LoopHead Body
TryFull: TryHead Body
ExceptFull: ExceptHead Body
FinallyFull: FinallyHead Body
WithFull: WithHead Body
DefFull: DefHead Body
ClassFull: ClassHead Body
CaseFull: CaseHead Body
TypedFull: DefTypedHead Body
Stmt8: simple | If | Loop | Try | With | Def | Deco Def | match8
Stmt12: Stmt8 | alias | If | Loop | TryGroup | With2 | Typed | Deco Typed | matchhead match_in
Deco: deco | deco Deco
If: if suite ElifTail | iffull ElifTail
ElifTail: % | Else | elif suite ElifTail | eliffull ElifTail
Else: else suite | elsefull
Loop: loop suite | loop suite Else | loopfull | loopfull Else
Try: TryStart Excepts | TryStart Excepts Else | TryStart Excepts Fin | TryStart Excepts Else Fin | TryStart Fin
TryStart: try suite | tryfull
Excepts: Except | Except Excepts
Except: except suite | exceptfull
TryGroup: TryStart Groups | TryStart Groups Else | TryStart Groups Fin
Groups: group suite | group suite Groups
Fin: finally suite | finallyfull
With: with suite | withfull
With2: withpar suite
Def: def suite | deffull | class suite | classfull
Typed: typed suite | typedfull
Cases: case suite | case suite Cases | casefull | casefull Cases
""")
    #: What a line may be -> the terminal it is on the level of blocks.
    LINES = {
        "Simple": "simple", "Alias": "alias", "IfHead": "if", "ElifHead": "elif", "ElseHead": "else", "LoopHead": "loop", "TryHead": "try", "ExceptHead": "except", "GroupHead": "group", "FinallyHead": "finally",
        "WithHead": "with", "WithParHead": "withpar", "DefHead": "def", "DefTypedHead": "typed", "ClassHead": "class", "DecoHead": "deco", "MatchHead": "matchhead", "CaseHead": "case", "IfFull": "iffull", "ElifFull": "eliffull", "ElseFull": "elsefull",
        "LoopFull": "loopfull", "TryFull": "tryfull", "ExceptFull": "exceptfull", "FinallyFull": "finallyfull", "WithFull": "withfull", "DefFull": "deffull", "ClassFull": "classfull", "CaseFull": "casefull", "TypedFull": "typedfull"}
    INDENT, LAST_INDENT = 0xE000, "\uf8ff"
    NEWLINES = re.compile("([\ue000-\uf8ff])")
    BLOCK = re.compile("\x02[^\x02\x03]*\x03")

    def __init__(self):
        super().__init__()
        comma, whole = self.abc.of(","), self.abc.of("lambda") + self.abc.of("for") + self.abc.of("yield")
        self.lists = {
            "(": {"pargs": (comma, "Arg", True, whole), "pexpr": (comma, "InPar", True, whole), "pparams": (None, "ParList", True, ""), "pnames": (comma, "Import", True, ""), "pwith": (None, "WithItemList", True, "")},
            "[": {"blist": (comma, "Elem", True, whole), "bsub": (comma, "Sub", True, whole)}, "{": {"cdict": (comma, "DItem", True, whole), "cset": (comma, "Elem", True, whole)}}
        self.widths, self.width_of = Memo(self.level), {}
        self.lines = Memo(self.line)
        self.blocks = Memo(self.block)
        self.statements = Memo(lambda p: self.grammar.accepted(("Stmt8", "Stmt12", "Cases"), p, self.abc.sets))

    def is_list(self, content, separator, rule, open_end, whole):
        if content == "":
            return rule in ("Arg", "Elem", "DItem", "InPar") and separator is not None or rule == "ParList"
        return super().is_list(content, separator, rule, open_end, whole)

    def inside(self, bracket, content):
        return self.NEWLINES.sub("", content)

    def classify(self, token):
        c, abc = token[0], self.abc
        if c == "\n":
            width = 0
            for x in token[1:]:
                width = (width // 8 + 1) * 8 if x == "\t" else 0 if x == "\f" else width + 1
            return self.widths[width]
        if c == "#" or c == "\\" and token[-1] == "\n":
            return ""
        if token in "()[]{}":
            return token
        if token[-1] in "\"'" and len(token) > 1:
            return abc.of("str" if not re.match("(?i:f|fr|rf)[\"']", token) or fields_close(token) else ERROR)
        if c.isalpha() or c == "_":
            return abc.of("id")
        return abc.of("num") if c.isdigit() or c == "." and len(token) > 1 else abc.of(ERROR)

    def level(self, width):
        """A character for an indentation; the deeper, the later it may have been met, so its width is looked up."""
        c = chr(self.INDENT + len(self.width_of))
        if c > self.LAST_INDENT:
            raise Rejected
        self.width_of[c] = width
        return c

    def line(self, content):
        names = self.grammar.accepted(self.LINES, content, self.abc.sets)
        if not names:
            raise Rejected
        return self.abc.of(*(self.LINES[n] for n in names))

    def block(self, content):
        """Which kind of suite the statements of a block make: of either dialect, or of the cases of a match."""
        sets, piece, found = self.abc.sets, "", None
        pieces = []
        for k, c in enumerate(content):
            names = sets[c]
            follows = names & {"elif", "else", "except", "group", "finally", "eliffull", "elsefull", "exceptfull", "finallyfull", "casefull", "case"}
            if piece and not follows and (sets[piece[-1]] & {"simple", "alias", "suite", "suite12", "match_in"} or any(x.endswith("full") for x in sets[piece[-1]])):
                pieces.append(piece)
                piece = ""
            piece += c
        pieces.append(piece)
        found = frozenset.intersection(*(self.statements[p] for p in pieces))
        if not found:
            raise Rejected
        names = []
        if "Stmt8" in found:
            names += ["suite"]
        elif "Stmt12" in found:
            names += ["suite", "only12"]
        if "Cases" in found:
            names += ["match_in"]
        return self.abc.of(*names)

    def whole(self, text):
        parts = self.NEWLINES.split(self.reduced(self.lexed("\n" + text.replace("\r\n", "\n"))))
        out, levels, modern = [], [0], False
        for k in range(1, len(parts), 2):
            if not parts[k + 1]:
                continue
            width = self.width_of[parts[k]]
            if width > levels[-1]:
                levels.append(width)
                out.append("\x02")
            else:
                while width < levels[-1]:
                    levels.pop()
                    out.append("\x03")
                if width != levels[-1]:
                    raise Rejected
            out.append(self.lines[parts[k + 1]])
        s = "".join(out) + "\x03" * (len(levels) - 1)
        again = 1
        while again:
            def inner(m):
                nonlocal modern
                c = self.blocks[m.group()[1:-1]]
                modern |= "only12" in self.abc.sets[c]
                return c
            s, again = self.BLOCK.subn(inner, s)
        if not s:
            return self.dialects
        names = self.abc.sets[self.blocks[s]]
        if "suite" not in names:
            raise Rejected
        return self.dialects[1:] if modern or "only12" in names else self.dialects


class Braces(Language):
    """What the languages with braces share: statements end with a semicolon (or a line end), compound ones with a block."""

    STATEMENTS: dict[str, tuple[str, str]]  # group name -> rule of a piece before a separator, rule of one without
    BEGINS: tuple[str, ...]  # words that after a block begin a statement

    def __init__(self):
        super().__init__()
        self.begins = re.compile("[" + "".join(self.abc.of(*self.words[w]) for w in self.BEGINS) + "]")
        self.semi = self.abc.of(";")

    def parts_of(self, content: str) -> tuple[frozenset, frozenset]:
        """The distinct pieces of a list of statements: those before a separator, and those that end with a block or are the last."""
        closed, ended, sets = set(), set(), self.abc.sets
        pieces = self.split.split(content)
        for k, piece in enumerate(pieces):
            start = 0
            for m in self.begins.finditer(piece):
                if m.start() > start and "block" in sets[piece[m.start() - 1]]:
                    ended.add(piece[start:m.start()])
                    start = m.start()
            (closed if k < len(pieces) - 1 else ended).add(piece[start:])
        return frozenset(closed), frozenset(ended)

    def statements(self, content: str, rules: tuple[str, str]) -> bool:
        closed, ended = self.parts_of(content)
        return all(self.pieces[(rules[0], p)] for p in closed) and all(self.pieces[(rules[1], p)] for p in ended)

    def derives(self, bracket, content):
        names = super().derives(bracket, content.replace(NEWLINE, "")) if bracket != "{" or self.semi not in content else []
        if bracket == "{":
            names += [name for name, rules in self.STATEMENTS.items() if self.statements(content, rules)]
        return names

    def inside(self, bracket, content):
        return content

    def whole(self, text):
        return self.dialects if self.statements(self.reduced(self.lexed(text)), self.TOP) else ()


class JavaScript(Braces):
    dialects = ("module",)
    BEGINS = ("if", "for", "var", "let", "const", "function", "return", "switch", "try", "throw", "class", "import", "export")
    INNER = r"(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{(?:[^{}`]|`(?:[^`\\]|\\.)*`|\{[^{}`]*\})*\})*\})*"
    TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{" + INNER + r"\})*`"
    REGEX = r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
    token = re.compile(
        r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\'|' + TEMPLATE + r'|//[^\n]*|/\*.*?\*/|\n'
        r"|(?:[(,=:\[!&|?{};+\n]|\breturn|\btypeof)\s*" + REGEX + r"|[$#]?(?:(?:[^\W\d]|\$)[\w$]*)"
        r"|(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])"
        r"|\.\.\.|=>|\?\.(?!\d)|>>>=?|[=!]==?|\*\*=?|<<=?|>>=?|&&=?|\|\|=?|\?\?=?|\+\+|--|[-+*/%&|^<>]=|[^\s]", re.S)
    words = {
        **{w: ("op",) for w in "* / % ** << >> >>> & | ^ && || ?? == != === !== < > <= >=".split()}, "*": ("op", "star"), "+": ("pm",), "-": ("pm",), "!": ("not",), "~": ("not",), "++": ("inc",), "--": ("inc",),
        "=": ("=",), **{w: ("aug",) for w in "+= -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()}, "=>": ("arrow",), "?.": ("opt",), "...": ("dots",),
        **{w: (w, "name") for w in "function class extends new return if else for while do switch case default throw try catch finally in instanceof import export await yield super var const".split()},
        **{w: ("unary", "name") for w in ("typeof", "void", "delete")}, **{w: ("jump", "name") for w in ("break", "continue", "debugger")}, **{w: ("lit", "name") for w in ("this", "null", "true", "false")},
        **{w: ("id", "name", w) for w in "let async of get set static from as".split()}, **{w: (w,) for w in ", ; : . ?".split()}}
    grammar = Grammar("""
Expr: Asn | Asn , Expr
Asn: Tern | Place = Asn | Place aug Asn | Head arrow Asn | Head arrow block | yield | yield Asn | yield star Asn
Head: id | pparams | async id | async pparams
Tern: Bin | Bin ? Asn : Asn
Bin: Un | Un Op Bin
Op: op | pm | in | instanceof
Un: Pre Un | Post | Post inc
Pre: not | pm | inc | unary | await
Post: Prim Trails
Trails: % | Trail Trails
Place: id | array | object | pexpr | Prim Trails Last
Last: . name | index
Trail: . name | index | pargs | tpl | opt name | opt pargs | opt index
Prim: id | num | str | tpl | regex | lit | array | object | pexpr | Fun | Cls | new Post | super | import pargs | import . name | new . name
Fun: function pparams block | function id pparams block | function star pparams block | function star id pparams block | async Fun
Cls: class classbody | class id classbody | class extends Post classbody | class id extends Post classbody
Elem: % | Asn | dots Asn
ElemList: Elem
Arg: Asn | dots Asn
Par: Pattern | Pattern = Asn | dots Pattern
Pattern: id | array | object
Prop: Key : Asn | name | id = Asn | Mods Key pparams block | dots Asn | Key pparams block
Key: name | str | num | index
Mods: Mod | Mod Mods
Mod: static | async | get | set | star
Name: name | name as name | str as name | name as str
ForHead: Init ; Opt ; Opt | Var Pattern Of Expr | Post Of Expr
Init: % | Var Decls | Expr
Of: of | in
Opt: % | Expr
Var: var | let | const
Free: var | let
Consts: Pattern = Asn | Pattern = Asn , Consts
Decls: Decl | Decl , Decls
Decl: Pattern | Pattern = Asn
Piece: Comps | Comps Simple
Comps: % | Comp Comps
Comp: block | Fun | Cls | if pexpr Body | if pexpr Body else Body | for pfor Body | for await pfor Body | while pexpr Body | do Body while pexpr | try block Handler | switch pexpr switchbody | id : Body | export Fun | export Cls | export default Fun | export default Cls
Handler: catch block | catch pparams block | finally block | catch block finally block | catch pparams block finally block
Body: Comp | Simple | Simple ; | ;
Simple: Expr | Free Decls | const Consts | return | return Expr | throw Expr | jump | jump id | import From | export names | export names from Src | export star from Src | export star as name from Src | export default Asn | export Free Decls | export const Consts
Src: str | str id object
From: Src | id from Src | names from Src | id , names from Src | star as id from Src | id , star as id from Src
SwPiece: Labels Piece
Labels: % | case Expr : Labels | default : Labels
Members: Methods | Methods Field
Methods: % | Method Methods
Method: Key pparams block | Mods Key pparams block | static block
Field: Key | Key = Asn | Mods Key | Mods Key = Asn
""")
    STATEMENTS = {"block": ("Piece", "Piece"), "classbody": ("Members", "Members"), "switchbody": ("SwPiece", "SwPiece")}
    TOP = ("Piece", "Piece")

    def __init__(self):
        super().__init__()
        comma, of = self.abc.of(","), lambda *names: "".join(c for w, t in self.words.items() if set(t) & set(names) for c in [self.abc.of(*t)])
        self.lists = {
            "(": {"pargs": (comma, "Arg", True, ""), "pexpr": (None, "Expr", False, ""), "pparams": (comma, "Par", True, ""), "pfor": (None, "ForHead", False, "")},
            "[": {"array": (comma, "Elem", True, ""), "index": (None, "Expr", False, "")}, "{": {"object": (comma, "Prop", True, ""), "names": (comma, "Name", True, "")}}
        goes_on = re.escape(of("op", "pm", "=", "aug", ",", ".", "?", ":", "arrow", "opt", "not", ";"))
        self.joins = re.compile(
            f"(?<=[{goes_on}{of('else', 'do')}])\n+|\n+(?=[{re.escape(of('op', '=', 'aug', ',', '.', '?', ':', 'arrow', 'opt', ';', 'else', 'catch', 'finally', 'instanceof'))}\n(\\[`)])|^\n+|\n+$")
        self.heads = re.compile(f"([{of('if', 'while', 'for')}][^\n])\n+|({of('do')}[^\n])\n+(?={of('while')})")
        self.split = re.compile(f"\n|{self.abc.of(';')}(?!\n?[{of('else')}])")
        self.once = re.compile(f"([{of('do')}][^{self.semi}\n{of('while')}]+){self.semi}\n*(?=[{of('while')}])")  # the body of a loop that is one statement

    def is_list(self, content, separator, rule, open_end, whole):
        if content == "":
            return rule in ("Arg", "Elem", "Par", "Prop", "Name")
        return super().is_list(content, separator, rule, open_end, whole)

    def lexed(self, text):
        if text.startswith("#!"):
            text = text.partition("\n")[2]
        return self.joins.sub("", super().lexed(text))

    def parts_of(self, content):
        return super().parts_of(self.once.sub(r"\1", self.heads.sub(lambda m: m[1] or m[2], self.joins.sub("", content))))

    def classify(self, token):
        c, abc = token[0], self.abc
        if c == "\n" and len(token) == 1 or c == "/" and token[:2] == "/*" and "\n" in token:
            return NEWLINE
        if c == "/" and token[:2] in ("//", "/*") and len(token) > 2:
            return ""
        if c == "/" and token == "//":
            return ""
        if token in "()[]{}":
            return token
        if len(token) > 1 and c in "\"'":
            return abc.of("str")
        if len(token) > 1 and c == "`":
            return abc.of("tpl")
        before = re.match(r"([(,=:\[!&|?{};+\n]|return|typeof)\s*/(?![/*])", token)
        if before and len(token) > len(before.group()):
            lead = before.group(1)
            return (NEWLINE if lead == "\n" else lead if lead in "([{" else self.tokens[lead] if lead not in "&|" else abc.of("op")) + abc.of("regex")
        if c.isalpha() or c in "_$#" and len(token) > 1 or c in "_$":
            return abc.of("id", "name")
        return abc.of("num") if c.isdigit() or c == "." and len(token) > 1 else abc.of(ERROR)


class Cpp(Braces):
    dialects = ("c++17", "c++20")
    BEGINS = ("if", "for", "return", "switch", "try", "int", "const", "class", "template", "namespace", "using", "public")
    token = re.compile(
        r'(?:u8|[uUL])?R"([^()\\\s]{0,16})\(.*?\)\1"|(?:u8|[uUL])?"(?:[^"\\\n]|\\.)*"|(?:u8|[uUL])?\'(?:[^\'\\\n]|\\.)+\'|//[^\n]*|/\*.*?\*/'
        r"|(?:^|(?<=\n))[ \t]*#[ \t]*(?:include|define|if|ifdef|ifndef|else|elif|endif|pragma|undef|error|warning|line)\b(?:[^\n\\]|\\.)*|" + WORD +
        r"|(?:0[xX][\da-fA-F']+|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)[uUlLfFzZ]*(?!\w)"
        r"|\.\.\.|::|->\*?|<=>|<<=|[-+*/%&|^<>=!]=|&&|\|\||\+\+|--|[^\s]", re.S)
    words = {
        **{w: ("ty",) for w in "int char auto bool void double float long short unsigned signed wchar_t char8_t char16_t char32_t".split()},
        **{w: ("qual",) for w in "const static constexpr inline virtual explicit friend mutable volatile extern register thread_local consteval constinit".split()}, "typename": ("typename",),
        **{w: ("cls",) for w in ("class", "struct", "union")}, **{w: (w,) for w in "enum namespace using template typedef operator return if else for while do switch case default goto try catch new throw noexcept".split()},
        **{w: ("acc",) for w in ("public", "private", "protected")}, **{w: ("jump",) for w in ("break", "continue")}, **{w: ("lit",) for w in ("this", "nullptr", "true", "false")},
        **{w: ("cast",) for w in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast")}, **{w: ("size",) for w in ("sizeof", "alignof", "typeid", "decltype", "alignas", "static_assert")}, "delete": ("delete",),
        **{w: ("co",) for w in ("co_await", "co_yield", "co_return")}, "requires": ("requires",), "concept": ("concept",), "export": ("export",),
        **{w: ("op",) for w in "/ % | ^ || == != <= >= <=>".split()}, "&": ("ptr",), "*": ("ptr",), "&&": ("ptr",), "+": ("pm",), "-": ("pm",), "!": ("not",), "~": ("not", "tilde"), "++": ("inc",), "--": ("inc",), "<": ("lt",), ">": ("gt",),
        **{w: ("aug",) for w in "+= -= *= /= %= &= |= ^= <<= >>=".split()}, "::": ("scope",), "->": ("dot", "arrow"), ".": ("dot",), "->*": ("op",), "...": ("dots",), **{w: (w,) for w in ", ; : = ?".split()}}
    grammar = Grammar("""
Name: Part | scope Part | Name scope Part
Part: id | id lt TArgs gt | id lt gt | tilde id | operator OpName
OpName: op | pm | ptr | not | inc | lt | gt | lt lt | gt gt | = | aug | pargs | index | Type | dot | new | delete | , | str id
TArgs: TArg | TArg , TArgs | TArg dots
TArg: Type | Type Abs | Un | Type pparams
Type: Quals Core Quals
Quals: % | qual Quals | attr Quals | size pargs Quals
Core: Tys | Name | cls Name | enum Name | typename Name | size pexpr
Tys: ty | ty Tys | ty qual Tys
Abs: Ptrs | Ptrs arrsfx | pfn pparams
Ptrs: ptr | ptr qual | ptr Ptrs | ptr qual Ptrs
PtrsO: % | Ptrs
Expr: Asn | Asn , Expr
Asn: Tern | Tern = AsnOrInit | Tern aug AsnOrInit | throw Asn | throw | co Asn
AsnOrInit: Asn | init
Tern: Bin | Bin ? Expr : Asn
Bin: Un | Un Op Bin
Op: op | pm | ptr | lt | gt | lt lt | gt gt
Un: Pre Un | pcast Un | Post | Post inc
Pre: not | pm | inc | ptr | new | delete | delete index | co
Post: Prim Trails
Trails: % | Trail Trails
Trail: dot Name | index | pargs | init | dot typename Name
Prim: Name | num | Strs | chr | lit | pexpr | Lambda | Tys pargs | Tys init | cast lt Type gt pexpr | cast lt Type Abs gt pexpr | size pexpr | size ptype | size dots pexpr | new Type | Tys | typename Name | requires pparams block | requires block
Strs: str | str Strs
Lambda: index block | index pparams FnTail block | caps block | caps pparams FnTail block
FnTail: % | FnT FnTail
FnT: qual | noexcept | noexcept pexpr | id | ptr | arrow Type PtrsO | attr | requires Bin
Arg: AsnOrInit | AsnOrInit dots | Type | Type Abs
Init: AsnOrInit | dot id = AsnOrInit | dot id init | AsnOrInit dots
Par: Type | Type Abs | Type PtrsO Dcl | Type PtrsO Dcl = AsnOrInit | Type Abs = AsnOrInit | Type = AsnOrInit | dots | Type PtrsO dots | Type PtrsO dots id
Dcl: id | id arrsfx | id ArrS | pfn pparams
ArrS: arrsfx | arrsfx ArrS
TypeOnly: Type | Type Abs
FnPtr: ptr id | Name scope ptr id | ptr
Cap: id | ptr id | ptr | = | lit | id = Asn | ptr lit
Enumerator: id | id = Asn | id attr
ForHead: InitS ; Opt ; Opt | Type PtrsO ForVar : AsnOrInit | InitS ; Type PtrsO ForVar : AsnOrInit
ForVar: id | index
InitS: % | Expr | Type Dcls
Opt: % | Expr
Cond: Expr | Type PtrsO id = AsnOrInit | Type PtrsO id init | InitS ; Expr
Dcls: DclI | DclI , Dcls
DclI: PtrsO QDcl | PtrsO QDcl = AsnOrInit | PtrsO QDcl init | PtrsO QDcl pargs | PtrsO id : Asn | PtrsO index = Asn
QDcl: Name | Name ArrS | pfn pparams | pfn
FnDcl: Name pparams FnTail
Fn: Type PtrsO FnDcl | FnDcl | qual Fn | attr Fn
FnDef: Fn block | Fn : MemInits block | Fn try block Catches
MemInits: MemInit | MemInit , MemInits
MemInit: Name pargs | Name init | Name pargs dots
Decl: Type Dcls | Fn | Fn = num | Fn = lit | Fn = default | Fn = delete | using Name = Type | using Name = Type Abs | using Name | using namespace Name | using typename Name | typedef Type Dcls | cls Name | enum Name | ClsDef | ClsDef Dcls | typedef ClsDef Dcls | qual ClsDef Dcls | template lt TPars gt Decl | template lt gt Decl | template lt TPars gt requires Bin Decl | template Type | namespace id = Name | extern_c | friend_ | size pargs | qual Decl
ClsDef: cls ClsName classbody | cls ClsName : Bases classbody | cls classbody | enum enumbody | enum ClsName enumbody | enum cls ClsName enumbody | enum ClsName : Type enumbody | enum cls ClsName : Type enumbody
ClsName: Name | Name id | attr Name
Bases: Base | Base , Bases
Base: Name | acc Name | qual Base | acc qual Name | Base dots
TPars: TPar | TPar , TPars
TPar: cls | cls id | typename | typename id | cls id = Type | typename id = Type | cls dots id | typename dots id | typename dots | Type id | Type id = Un | Type | template lt TPars gt TPar
Item: FnDef | namespace nsbody | namespace Name nsbody | qual namespace Name nsbody | qual str nsbody | qual str Item | template lt TPars gt Item | template lt gt Item | template lt TPars gt requires Bin Item
Items: % | Item Items | ClsBare Items
ClsBare: namespace nsbody
Top: Items | Items Decl
TopEnd: Items
Comp: block | if pexpr Body | if pexpr Body else Body | if qual pexpr Body | if qual pexpr Body else Body | for pfor Body | while pexpr Body | switch pexpr block | try block Catches | case Tern : Body | case Tern : | default : Body | default : | id : Body | attr Comp
Catches: catch pparams block | catch pparams block Catches
Body: Comp | Simple ; | Simple | ; | else_
Comps: % | Comp Comps
Simple: Expr | Decl | return | return AsnOrInit | return Expr | jump | goto id | do Body while pexpr | co | using enum Name | Need
Need: init | init arrow Type | init noexcept | init noexcept arrow Type | typename Name | requires Bin
Stm: Comps | Comps Simple
StmEnd: Comps
Access: acc :
MemItem: Access | FnDef | template lt TPars gt FnDef | qual MemItem
Mems: % | MemItem Mems
Mem: Mems | Mems Decl
MemEnd: Mems
Concept: template lt TPars gt concept id = Expr | export Decl | export Item
Top20: Top | Items Concept
""")
    STATEMENTS = {"block": ("Stm", "StmEnd"), "classbody": ("Mem", "MemEnd"), "nsbody": ("Top20", "TopEnd")}
    TOP = ("Top", "TopEnd")

    def __init__(self):
        super().__init__()
        comma, lt = self.abc.of(","), self.abc.of("lt")
        self.lists = {
            "(": {"pargs": (comma, "Arg", False, lt), "pexpr": (None, "Cond", False, ""), "pparams": (comma, "Par", False, lt), "pfor": (None, "ForHead", False, ""), "pcast": (None, "TypeOnly", False, ""), "ptype": (None, "TypeOnly", False, ""), "pfn": (None, "FnPtr", False, "")},
            "[": {"index": (None, "Expr", False, ""), "arrsfx": (None, "Expr", False, ""), "caps": (comma, "Cap", False, "")}, "{": {"init": (comma, "Init", True, lt), "enumbody": (comma, "Enumerator", True, "")}}
        self.split = re.compile(f"{self.abc.of(';')}(?!{self.abc.of('else')})")
        self.tops = Memo(lambda p: self.grammar.accepted(("Top", "Top20"), self.repeated.sub(r"\1\1", p), self.abc.sets))

    def lexed(self, text):
        return "".join(map(self.tokens.__getitem__, (m.group() for m in self.token.finditer(text))))

    def is_list(self, content, separator, rule, open_end, whole):
        if content == "":
            return rule in ("Arg", "Par", "Cap", "Init", "Enumerator") or rule == "Expr" and separator is None
        if whole and whole in content and rule in ("Arg", "Par", "Init"):
            return self.angled(content, separator, rule, open_end)
        return super().is_list(content, separator, rule, open_end, "")

    def angled(self, content, comma, rule, open_end):
        """With a ``<`` in it a comma may belong to template arguments: pieces are joined until they parse."""
        parts, held = content.split(comma), ""
        if open_end and parts[-1] == "":
            parts.pop()
        for p in parts:
            held = held + comma + p if held else p
            if self.pieces[(rule, held)]:
                held = ""
        return held == ""

    def group(self, text):
        if text[0] == "[" and self.abc.sets.get(text[1:-1], frozenset()) >= {"attr0"}:
            return self.abc.of("attr", *super().derives("[", text[1:-1]))
        return super().group(text)

    def derives(self, bracket, content):
        names = super().derives(bracket, content)
        if bracket == "[":
            names.append("attr0")
        return names

    def classify(self, token):
        c, abc = token[0], self.abc
        if token[:2] in ("//", "/*") or "#" in token and token.lstrip()[0] == "#" and len(token.strip()) > 1:
            return ""
        if token in "()[]{}":
            return token
        if token[-1] == '"' and len(token) > 1:
            return abc.of("str")
        if token[-1] == "'" and len(token) > 2:
            return abc.of("chr")
        if c.isalpha() or c == "_":
            return abc.of("id")
        return abc.of("num") if c.isdigit() or c == "." and len(token) > 1 else abc.of(ERROR)

    def whole(self, text):
        closed, ended = self.parts_of(self.reduced(self.lexed(text)))
        found = frozenset.intersection(frozenset(["Top", "Top20"]), *(self.tops[p] for p in closed))
        if not found or not all(self.pieces[("TopEnd", p)] for p in ended):
            return ()
        return self.dialects if "Top" in found else self.dialects[1:]


class Julia(Language):
    dialects = ("julia1",)
    STRING = r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\$]|\\.|\$\((?:[^()"]|"(?:[^"\\]|\\.)*"|\((?:[^()"]|"(?:[^"\\]|\\.)*")*\))*\)|\$)*"|```.*?```|`(?:[^`\\]|\\.)*`'
    token = re.compile(
        r"(?:[^\W\d]\w*)?(?:" + STRING + r")\w*|#=.*?=#|#[^\n]*|\n|(?<![\w)\]}'.])'(?:\\[^'\n]*|[^\\'\n])'|:(?:[^\W\d]\w*!?)(?=\W)|@(?:[^\W\d][\w.]*!?|\+|\.)|(?:[^\W\d][\w]*!*(?!=))"
        r"|0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|(?:\d[\d_]*(?:\.(?!\.)[\d_]*)?|\.\d[\d_]*)(?:[eEf][+-]?\d+)?(?:[^\W\d]\w*)?"
        r"|\.\.\.?|::|->|=>|<:|>:|\|>|&&|\|\||[=!]==|\.=(?!=)|\.?(?:[-+*/÷\\%^&|<>=!⊻]=|//=?|>>>|<<|>>)|\.(?:[-+*/÷\\%^&|<>!]|==)|[^\s]", re.S)
    words = {
        **{w: ("fun", "open") for w in ("function", "macro")}, **{w: (w, "open") for w in "module struct begin quote let if for while try do".split()}, "baremodule": ("module", "open"), "abstract": ("id", "abstract"), "primitive": ("id", "primitive"), "type": ("id", "type"), "mutable": ("id", "mutable"),
        **{w: (w,) for w in "end else elseif catch finally where".split()}, **{w: ("jump",) for w in ("break", "continue")}, "return": ("return",), "in": ("in", "op"), "isa": ("op", "id"), "using": ("using",), "import": ("using",), "export": ("export",),
        "const": ("decl",), "global": ("decl",), "local": ("decl",), "outer": ("id",), "true": ("num",), "false": ("num",), "as": ("id", "as"),
        **{w: ("op",) for w in "== != === !== < > <= >= // << >> >>> => |> ÷ \\ / % ^ | ⊻ ∈ ∉ ≤ ≥ ≠ ⊆ .+ .- .* ./ .^ .== .< .> .<= .>= .!= .& .| .% .÷ && || -> >: .//".split()}, "<:": ("op", "sub"), "&": ("op", "pre"), "*": ("op",), "+": ("op", "pre"), "-": ("op", "pre"), "!": ("pre",), "~": ("pre", "op"), "√": ("pre",), ".!": ("pre",),
        "=": ("=",), **{w: ("aug",) for w in "+= -= *= /= ÷= %= ^= &= |= \\= //= .= .+= .-= .*= ./= .^= ⊻=".split()}, "..": ("op",), "...": ("dots",), "::": ("typed",), ".": ("dot",), "'": ("adj",), "$": ("pre",), **{w: (w,) for w in ", ; : ?".split()}}
    grammar = Grammar("""
Stmt: % | Tuple | Asn | return | return Tuple | return Asn | jump | using Mods | export Ids | decl Asn | decl Ids | decl Expr | Macro | block1 | str Stmt | Expr ; Stmt
Asn: Tuple = Rhs | Tuple aug Rhs | Sig = Rhs
Sig: Un where Un | Un typed Un | Un typed Un where Un
Rhs: Tuple | Asn | return | return Tuple | jump | decl Asn
Tuple: Item | Item , | Item , Tuple
Item: Expr | Expr dots
Expr: Tern | Macro
Tern: Bin | Bin ? ExprJ : ExprJ
ExprJ: Tern | Asn | return | return Tuple | jump
Bin: Un | Un Op Bin | Un Op return | Un Op return Tuple | Un Op jump | Un : | Un Op Asn | Un Op Macro
Op: op | : | in | where | pre2
Un: pre Un | Post | Post typed Post | typed Post | sub Post | Post typed Post where Post
Post: Prim Trails
Trails: % | Trail Trails
Trail: dot id | dot pargs | pargs | index | curly | adj | doblock | dot str | dot id2 | str | dots
Prim: id | num | str | sym | pexpr | vect | block | curlyv | : | op1 | end1 | atcall | dotty
atcall: at pargs
id2: end | open
Macro: at | at MArgs
MArgs: MArg | MArg MArgs | MArg , MArgs
MArg: Expr | Asn | using Mods | decl Asn | return | return Tuple | jump
Mods: Mod | Mod , Mods | Mod : Names
Mod: id | dot Mod | id dot Mod | id as id | op | dotsl Mod
Names: Name | Name , Names
Name: id | id as id | op | at | pre
Ids: id | id , Ids | at | at , Ids | op | id typed Un | id typed Un , Ids
Arg: Expr | Expr dots | id = Expr | Asn | Expr Gens | dots | id typed Un = Expr
ArgList: % | Arg | Arg , | Arg , ArgList
Gens: for Its | for Its if Expr | for Its Gens
Its: It | It , Its
It: Pat in Expr | Pat = Expr
Pat: Un | Pat , Pat
InPar: Stmt | Expr Gens | Arg
Row: % | Cells | Tuple
Cells: Expr | Expr Cells
VectList: Tuple | Expr Gens | Asn
FunHead: Call | Call where Un | Call typed Un | Call typed Un where Un | id | Call where Un where Un
Call: Fname pargs | Fname curly pargs | pargs | pexpr
Fname: id | Fname dot id | op | dot id | pre | sym | pexpr
StructHead: id | id curly | id sub Un | id curly sub Un
ModHead: id
LetHead: % | Binds
Binds: Bind | Bind , Binds
Bind: id | Asn
CondHead: Expr | Asn
ForHead: Its
DoHead: % | Tuple
""")
    OPENERS = "open"

    def __init__(self):
        super().__init__()
        abc = self.abc
        opens = "".join(abc.of(*t) for t in self.words.values() if "open" in t)
        self.opens, self.end, self.semi = opens, abc.of("end"), abc.of(";")
        self.mids = "".join(abc.of(w) for w in ("else", "elseif", "catch", "finally"))
        self.inner = re.compile(rf"\([^()\[\]{{}}]*\)|\[[^()\[\]{{}}]*\]|\{{[^()\[\]{{}}]*\}}|[{opens}][^{opens}()\[\]{{}}{self.end}]*{self.end}")
        joined = "".join(abc.of(*t) for w, t in self.words.items() if {"op", "=", "aug", ",", "?", "dot", "typed", "sub"} & set(t) and w not in (":",) and "id" not in t)
        self.joins = re.compile(f"(?<=[{re.escape(joined)}])\n+")
        self.abstract = re.compile(f"[{abc.of('id', 'abstract')}{abc.of('id', 'primitive')}]{abc.of('id', 'type')}([^\n{self.end}]*){self.end}")
        self.mutable = re.compile(f"{abc.of('id', 'mutable')}(?={abc.of('struct', 'open')})")
        self.separators = re.compile(f"\n|{self.semi}")

    def classify(self, token):
        c, abc = token[0], self.abc
        if c == "#":
            return NEWLINE if token.startswith("#=") and "\n" in token else ""
        if token == "\n":
            return NEWLINE
        if token in "()[]{}":
            return token
        if re.match(r"(?:[^\W\d]\w*)?[\"`]", token) and len(token) > 1 and re.search(r"[\"`]\w*$", token) and not re.fullmatch(r"\w*[\"`]", token):
            return abc.of("str")
        if c == "'" and len(token) > 2:
            return abc.of("num")
        if c == ":" and len(token) > 1:
            return abc.of("sym", "range")
        if c == "@" and len(token) > 1:
            return abc.of("at")
        if c.isalpha() or c == "_":
            return abc.of("id")
        return abc.of("num") if c.isdigit() or c == "." and len(token) > 1 and token[1].isdigit() else abc.of(ERROR)

    def lexed(self, text):
        s = "".join(map(self.tokens.__getitem__, (m.group() for m in self.token.finditer(text))))
        # a symbol after an operand is a range with a name at its end
        sym, operand = self.abc.of("sym", "range"), self.abc.of("id") + self.abc.of("num") + ")" + r"\]"
        s = re.sub(f"(?<=[{operand}]){sym}", self.abc.of(":") + self.abc.of("id"), s)
        return self.mutable.sub("", self.abstract.sub(r"\1", self.joins.sub("", s)))

    def ok(self, rule, content):
        return bool(self.pieces[(rule, content)])

    def statements(self, content):
        return all(self.ok("Stmt", p) for p in self.separators.split(content))

    def group(self, text):
        names = []
        if text[0] == "(":
            flat = text[1:-1].replace(NEWLINE, "")
            parts = flat.split(self.semi)
            if all(self.ok("ArgList", p) for p in parts):
                names.append("pargs")
            if flat == "" or all(self.ok("ArgList", p) for p in parts) or all(self.ok("InPar", p) for p in self.separators.split(text[1:-1])):
                names.append("pexpr")
        elif text[0] in "[{":
            body = text[1:-1]
            if self.end in body:
                body = body.replace(self.end, self.abc.of("num"))
            rows = self.separators.split(body.strip("\n"))
            flat = body.replace(NEWLINE, "")
            if flat == "" or self.ok("VectList", flat) or self.ok("ArgList", flat) or all(self.ok("Row", r) for r in rows):
                names += ["index", "vect"] if text[0] == "[" else ["curly", "curlyv"]
        else:
            names = self.blocks_of(self.abc.sets[text[0]], text[1:-1])
        if not names:
            raise Rejected
        return self.abc.of(*names)

    def blocks_of(self, kind, content):
        head, _, body = content.partition(NEWLINE)
        first = self.separators.search(content)
        head, body = (content[: first.start()], content[first.end():]) if first else (content, "")
        kind = next(k for k in kind if k != "open")
        rule = {"fun": "FunHead", "struct": "StructHead", "module": "ModHead", "let": "LetHead", "if": "CondHead", "while": "CondHead", "for": "ForHead", "do": "DoHead"}.get(kind)
        if rule is None:  # begin, quote, try: the body starts at once
            body, head = content, ""
        sections = re.split(f"([{self.mids}])", body)
        if kind not in ("if", "try") and len(sections) > 1:
            return []
        if rule and not self.ok(rule, head):
            # a one-line body without separator, as in: if x y end
            return []
        if not self.statements(sections[0]):
            return []
        for mid, part in zip(sections[1::2], sections[2::2]):
            (name,) = self.abc.sets[mid]
            if name not in (("else", "elseif") if kind == "if" else ("catch", "else", "finally")):
                return []
            if name in ("elseif", "catch"):
                head = self.separators.split(part, maxsplit=1)
                if name == "elseif" and not self.ok("CondHead", head[0]) or name == "catch" and not self.ok("Stmt", head[0]):
                    return []
                part = head[1] if len(head) > 1 else ""
            if not self.statements(part):
                return []
        return ["doblock"] if kind == "do" else ["block"]

    def whole(self, text):
        s, again = self.lexed(text), 1
        while again:
            s, again = self.inner.subn(lambda m: self.groups[m.group()], s)
            if again:
                s = self.joins.sub("", s)
        if any(c in s for c in "()[]{}") or self.end in s:
            raise Rejected
        return self.dialects if self.statements(s) else ()


def languages() -> dict[str, Language]:
    """The supported languages by name; one set per worker process."""
    global _LANGUAGES
    if _LANGUAGES is None:
        _LANGUAGES = {"json": Json(), "toml": Toml(), "python": Python(), "javascript": JavaScript(), "cpp": Cpp(), "julia": Julia()}
    return _LANGUAGES


_LANGUAGES: dict[str, Language] | None = None
