"""C++: a syntax checker without a compiler.

The text becomes a string with one letter per token. It is cut into statements
at the structural marks, and each distinct statement shape is parsed once by a
backtracking parser and remembered, so repeated shapes cost a dictionary look-up.
Names are not resolved; what cannot be told without them is taken as valid.
"""

from __future__ import annotations

import re

from corpusmill.parsers.depth import deep

_RAW = re.compile(r'(?:u8|[uUL])?R"([^()\s\\]{0,16})\(.*?\)\1"', re.S)
_PREFIX = re.compile(r"""\b(?:u8|[uUL])(?=["'])""")
_TOKEN = re.compile(
    r"""\s*+(?:(?://[^\n]*+|/\*.*?\*/)\s*+)*+
    ([A-Za-z_$\u0080-\ufefe\uff00-\U0010ffff][\w$]*+
    |[(){};,.](?![\d.])
    |::|->\*?|&&|\|\||\+\+|--|<<=?|>>=|<=>|[-+*/%&|^!=<>]=
    |\.?\d(?:[eEpP][+-]|'\w|[\w.])*+
    |"(?:[^"\\\n]|\\.)*+"(?:_\w+|s\b)?
    |'(?:[^'\\\n]|\\.)++'
    |\#(?:[^\n\\/]|\\\r?\n|\\.|/\*.*?\*/|/(?!\*))*+
    |\.\.\.|/\*|.|$)""",
    re.X | re.S,
)
# The words of the language, by the letter that stands for them.
_WORDS = {
    "T": "int double float bool char void auto unsigned signed long short wchar_t char8_t char16_t char32_t",
    "Q": "const volatile static inline virtual explicit constexpr consteval constinit extern mutable friend register thread_local typedef typename",
    "K": "class struct union",
    "e": "enum",
    "I": "if",
    "E": "else",
    "F": "for",
    "W": "while",
    "D": "do",
    "S": "switch",
    "C": "case",
    "X": "default",
    "B": "break continue",
    "R": "return co_return co_yield",
    "G": "goto",
    "Y": "try",
    "H": "catch",
    "O": "throw",
    "P": "namespace",
    "U": "using",
    "M": "template",
    "A": "public private protected",
    "o": "operator",
    "w": "new",
    "d": "delete",
    "z": "sizeof alignof decltype typeid noexcept alignas co_await",
    "k": "static_cast dynamic_cast reinterpret_cast const_cast",
    "n": "this nullptr true false",
}
# One letter for each mark of more than one character.
_MARKS = {"::": "∷", "->": "→", "->*": "↠", "...": "…", "<<=": "←", ">>=": "←", "<=>": "≤", "&&": "∧", "||": "∨", "++": "↑", "--": "↑", "+=": "←", "-=": "←", "*=": "←", "/=": "←", "%=": "←", "&=": "←", "|=": "←", "^=": "←", "!=": "≠", "==": "≠", "<=": "≤", ">=": "≤", "<<": "«"}
_CLASS = {w: letter for letter, words in _WORDS.items() for w in words.split()} | _MARKS | {c: c for c in "-{}()[];:,.?~!%^&*+=|<>/"}
_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F'.]+(?:[pP][+-]?\d+)?|0[bB][01']+|(?:\d[\d']*\.?[\d']*|\.\d[\d']*)(?:[eE][+-]?\d+)?)(?:[uUlLfFzZ]*|_\w+|[a-z]{1,3})\Z")
_MACRO = re.compile(r"[A-Z][A-Z0-9_]{2,}\Z")


def _classify(token: str) -> str:
    first = token[0]
    if first.isalpha() or first in "_$":
        if token[-1] == '"':
            return "s"
        return "m" if _MACRO.match(token) else "i"
    if first == '"':
        return "s" if len(token) > 1 else "\0"
    if first == "'":
        return "n" if len(token) > 2 else "\0"
    if first.isdigit() or (first == "." and len(token) > 1):
        return "n" if _NUMBER.match(token) else "\0"
    if first == "#":
        return "#"
    if token == "\\":
        return "\0"
    return "\0"


class _Classes(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:
            self.clear()
            self.update(_CLASS)
        self[token] = kind = _classify(token)
        return kind


_CLASS[""] = ""
_classes = _Classes(_CLASS)
_letter = _classes.__getitem__
_DIRECTIVE = re.compile(r"#[ \t]*(\w*)")
# The preprocessor's directives.
_PLAIN = frozenset("include define undef pragma error warning line include_next import ident".split()) | {""}


def _branches(tokens: list[str], pick: int) -> tuple[str | None, int]:
    """Class letters with one branch kept of every conditional, the pick-th or else the last, and the most branches that one has."""
    out: list[str] = []
    most = 1
    # for each open conditional: where it starts, the branches' ends so far, whether #else came
    stack: list[list] = []

    def close(group: list) -> None:
        nonlocal most
        cuts = [*group[1], len(out)]
        parts = [out[a:b] for a, b in zip([group[0], *cuts], cuts)]
        if group[3]:
            # what #if 0 takes out is no code
            parts = parts[1:] or [[]]
        most = max(most, len(parts))
        kept = parts[min(pick, len(parts) - 1)]
        del out[group[0] :]
        out.extend(kept)

    for token in tokens:
        kind = _classes[token] if token[0] != "#" else "#"
        if kind != "#":
            out.append(kind)
            continue
        word = _DIRECTIVE.match(token)[1]
        if word in ("if", "ifdef", "ifndef"):
            if not token[token.index(word) + len(word) :].strip():
                return None, 1
            zero = word == "if" and token.split(None, 1)[1:] == ["0"] or token.replace(" ", "") == "#if0"
            stack.append([len(out), [], False, zero])
        elif word in ("elif", "else", "elifdef", "elifndef"):
            if not stack or stack[-1][2]:
                return None, 1
            stack[-1][1].append(len(out))
            stack[-1][2] = word == "else"
        elif word == "endif":
            if not stack:
                return None, 1
            close(stack.pop())
        elif word not in _PLAIN:
            return None, 1
    return (None, 1) if stack else ("".join(out), most)


def _letters(text: str, pick: int = 0) -> tuple[str | None, int]:
    """The class letters, or None if the directives are broken, and the most branches of one conditional."""
    if 'R"' in text:
        text = _RAW.sub('""', text)
    if _PREFIX.search(text):
        text = _PREFIX.sub("", text)
    if text[:1] == "\ufeff":
        text = text[1:]
    tokens = _TOKEN.findall(text)
    while tokens and not tokens[-1]:
        tokens.pop()
    if "#" not in text:
        return "".join(map(_letter, tokens)), 1
    return _branches(tokens, pick)


# ---------------------------------------------------------------- shapes

_BINARY = frozenset("↠≤∧∨≠«*/%+-<>&^|.")
_UNARY = frozenset("-+!~*&↑∧")


class _Shape:
    """Parses one statement's letters. Every method takes a position and gives the one after, or -1."""

    def __init__(self, s: str):
        self.s = s + "\x01"
        self.memo: dict = {}

    def expr(self, i: int, comma: bool = True) -> int:
        key = ("e", i, comma)
        if key not in self.memo:
            self.memo[key] = -1
            self.memo[key] = self._expr(i, comma)
        return self.memo[key]

    def _expr(self, i: int, comma: bool) -> int:
        s = self.s
        if s[i] == "O":
            j = self.expr(i + 1, False)
            return j if j > 0 else i + 1
        i = self.unary(i)
        while i > 0:
            c = s[i]
            if c in _BINARY:
                if c == ">" and s[i + 1] == ">":
                    i += 1
                elif c == "." and s[i + 1] == "*":
                    i += 1
                elif c == ".":
                    return -1
                j = self.unary(i + 1)
                if j < 0:
                    return i if c == ">" else -1
                i = j
            elif c == "=" or c == "←":
                return self.expr(i + 1, comma)
            elif c == "?":
                j = self.expr(i + 1)
                if j < 0 or s[j] != ":":
                    return -1
                i = self.expr(j + 1, False)
            elif c == "," and comma:
                j = self.expr(i + 1, False)
                if j < 0:
                    return -1
                i = j
            else:
                return i
        return -1

    def unary(self, i: int) -> int:
        s = self.s
        while s[i] in _UNARY:
            i += 1
        c = s[i]
        if c == "z":
            i += 1
            if s[i] == "…":
                i += 1
            if s[i] == "(":
                for j in (self.type_id(i + 1), self.expr(i + 1)):
                    if j > 0 and s[j] == ")":
                        return self.postfix(j + 1)
                return -1
            return self.unary(i)
        if c == "w" or (c == "∷" and s[i + 1] == "w"):
            i += 1 + (c != "w")
            if s[i] == "(":
                j = self.arguments(i)
                if j > 0 and s[j] in "iTm∷Q":
                    i = j
            j = self.type_name(i)
            if j < 0:
                return -1
            while s[j] == "*":
                j += 1
            while s[j] == "[":
                j = self.expr(j + 1)
                if j < 0 or s[j] != "]":
                    return -1
                j += 1
            if s[j] == "(":
                return self.arguments(j)
            return j + 1 if s[j] == "b" else j
        if c == "d":
            i += 1
            if s[i : i + 2] == "[]":
                i += 2
            return self.unary(i)
        if c == "(":
            # a cast, else a parenthesis
            j = self.type_id(i + 1)
            if j > 0 and s[j] == ")" and (s[j + 1] in "insmTkz(b∷o~!d" or (s[j + 1] in "-*&+" and s[i + 1] in "TQ")):
                k = self.unary(j + 1)
                if k > 0:
                    return k
        return self.postfix(self.primary(i))

    def primary(self, i: int) -> int:
        s = self.s
        c = s[i]
        if c == "n" or c == "b":
            return i + 1
        if c == "s":
            while s[i] in "sm":
                i += 1
            return i
        if c == "(":
            if s[i + 1] == "…":
                j = i + 2
                if s[j] in _BINARY or s[j] == ",":
                    j = self.unary(j + 1)
                    return j + 1 if j > 0 and s[j] == ")" else -1
            j = self.expr(i + 1)
            if j > 0 and s[j] in "∧∨+*," and s[j + 1] == "…":
                j += 2
            return j + 1 if j > 0 and s[j] == ")" else -1
        if c == "[":
            return self.lambda_(i)
        if c == "k":
            if s[i + 1] != "<":
                return -1
            j = self.type_id(i + 2)
            if j < 0 or s[j] != ">":
                return -1
            return self.arguments(j + 1)
        if c == "T":
            while s[i] == "T":
                i += 1
            return i if s[i] in "(b" else -1
        if c == "Q":
            # typename T::x(...)
            j = self.type_name(i + 1)
            return j if j > 0 and s[j] in "(b" else -1
        return self.id_expr(i)

    def id_expr(self, i: int) -> int:
        s = self.s
        if s[i] == "∷":
            i += 1
        while True:
            if s[i] == "~":
                i += 1
            if s[i] == "M":
                i += 1
            if s[i] == "o":
                i = self.operator_name(i)
                return i
            if s[i] not in "im":
                return -1
            i += 1
            if s[i] == "<":
                j = self.template_args(i)
                if j > 0 and s[j] in "(∷b)}],;:\x01.":
                    i = j
            if s[i] == "∷" and s[i + 1] in "im~oM":
                i += 1
                continue
            return i

    def operator_name(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] in "([":
            return i + 2 if s[i : i + 2] in ("()", "[]") else -1
        if s[i] in "wd":
            i += 1
            return i + 2 if s[i : i + 2] == "[]" else i
        if s[i] == "s":
            return i + 2 if s[i + 1] in "im" else i + 1
        if s[i] in "iTmQ∷":
            j = self.type_name(i)
            while j > 0 and s[j] in "*&":
                j += 1
            return j
        if s[i] == ">" and s[i + 1] == ">":
            return i + 2
        if s[i] in "+-*/%^&|~!=<>,→↠←≤∧∨↑≠«":
            return i + 1
        return -1

    def postfix(self, i: int) -> int:
        s = self.s
        while i > 0:
            c = s[i]
            if c == "(":
                i = self.arguments(i)
            elif c == "[":
                j = i + 1 if s[i + 1] == "b" else i
                j = j + 1 if j > i else self.expr(i + 1)
                if j < 0 or s[j] != "]":
                    return -1
                i = j + 1
            elif c == "." or c == "→":
                i = self.id_expr(i + 1)
            elif c == "↑" or c == "…":
                i += 1
            elif c == "b":
                i += 1
            else:
                return i
        return -1

    def arguments(self, i: int) -> int:
        """'(' list of expressions or types ')'"""
        s = self.s
        if s[i] != "(":
            return -1
        i += 1
        if s[i] == ")":
            return i + 1
        while True:
            j = self.expr(i, False)
            if j < 0 or s[j] not in ",)":
                j = self.type_id(i)
            if j < 0:
                return -1
            if s[j] == "…":
                j += 1
            if s[j] == ")":
                return j + 1
            if s[j] != ",":
                return -1
            i = j + 1

    def lambda_(self, i: int) -> int:
        s = self.s
        j = s.find("]", i)
        if j < 0 or not re.fullmatch(r"(?:[=&*]?[inm]?(?:=.+?)?…?,?)*", s[i + 1 : j]):
            return -1
        i = j + 1
        if s[i] == "<":
            i = self.template_head(i)
            if i < 0:
                return -1
        if s[i] == "(":
            i = self.parameters(i)
            if i < 0:
                return -1
        while s[i] in "Qzi":
            i += 1
            if s[i - 1] == "z" and s[i] == "(":
                i = self.arguments(i)
                if i < 0:
                    return -1
        if s[i] == "→":
            i = self.type_id(i + 1)
            if i < 0:
                return -1
        return i + 1 if s[i] == "b" else -1

    def template_args(self, i: int) -> int:
        key = ("t", i)
        if key not in self.memo:
            self.memo[key] = -1
            self.memo[key] = self._template_args(i)
        return self.memo[key]

    def _template_args(self, i: int) -> int:
        s = self.s
        i += 1
        if s[i] == ">":
            return i + 1
        while True:
            best = -1
            for j in (self.type_id(i), self.template_value(i)):
                if j > 0 and s[j] == "…":
                    j += 1
                if j > 0 and s[j] in ",>" and j > best:
                    best = j
            if best < 0:
                return -1
            if s[best] == ">":
                return best + 1
            i = best + 1

    def template_value(self, i: int) -> int:
        s = self.s
        j = self.unary(i)
        while j > 0 and s[j] in "+-*/%&|^≠∧∨≤«":
            j = self.unary(j + 1)
        return j

    def type_name(self, i: int) -> int:
        """cv and one type's name, no declarator."""
        s = self.s
        named = False
        while True:
            c = s[i]
            if c == "Q":
                i += 1
            elif c == "T":
                named = True
                i += 1
            elif c in "Ke":
                i += 1
                if s[i] == "K":
                    i += 1
                if s[i] not in "im∷":
                    return -1
            elif c == "z" and s[i + 1] == "(" and not named:
                i = self.arguments(i + 1)
                if i < 0:
                    return -1
                named = True
            elif c in "im∷" and not named:
                named = True
                if c == "∷":
                    i += 1
                while True:
                    if s[i] == "M":
                        i += 1
                    if s[i] not in "im":
                        return -1
                    i += 1
                    if s[i] == "<":
                        j = self.template_args(i)
                        if j < 0:
                            return -1
                        i = j
                    if s[i] == "∷" and s[i + 1] in "imM":
                        i += 1
                        continue
                    break
            else:
                return i if named else -1

    def pointers(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] in "*&∧Q":
                i += 1
            elif s[i] == "i" and s[i + 1] == "∷" and s[i + 2] == "*":
                i += 3
            else:
                return i

    def type_id(self, i: int) -> int:
        key = ("y", i)
        if key not in self.memo:
            self.memo[key] = -1
            s = self.s
            j = self.type_name(i)
            if j > 0:
                j = self.pointers(j)
                if s[j] == "(":
                    # function types and pointers to functions
                    k = self.pointers(j + 1)
                    if s[k] == ")" and k > j + 1 and s[k + 1] == "(":
                        k = self.parameters(k + 1)
                    else:
                        k = self.parameters(j)
                    j = k if k > 0 else j
                while j > 0 and s[j] == "[":
                    k = j + 1 if s[j + 1] == "]" else self.expr(j + 1)
                    j = k + 1 if k > 0 and s[k] == "]" else -1
            self.memo[key] = j
        return self.memo[key]

    def template_head(self, i: int) -> int:
        """'<' parameters '>' after the word template."""
        s = self.s
        if s[i] != "<":
            return -1
        i += 1
        if s[i] == ">":
            return i + 1
        while True:
            if s[i] == "M":
                i = self.template_head(i + 1)
                if i < 0 or s[i] not in "KQ":
                    return -1
            if s[i] in "KQ" and (s[i + 1] in "im…=,>"):
                j = i + 1
                if s[j] == "…":
                    j += 1
                if s[j] in "im":
                    j += 1
                if s[j] == "=":
                    j = self.type_id(j + 1)
                if j > 0 and s[j] in ",>":
                    i = j
                else:
                    i = self.parameter(i)
            else:
                i = self.parameter(i, True)
            if i < 0:
                return -1
            if s[i] == ">":
                return i + 1
            if s[i] != ",":
                return -1
            i += 1

    def parameter(self, i: int, template: bool = False) -> int:
        s = self.s
        if s[i] == "…":
            return i + 1
        i = self.attributes(i)
        j = self.type_name(i)
        if j < 0:
            return -1
        j = self.pointers(j)
        if s[j] == "…":
            j += 1
        if s[j] == "(":
            k = self.pointers(j + 1)
            if s[k] in "im":
                k += 1
            while s[k] == "[":
                k = s.find("]", k) + 1
                if k == 0:
                    return -1
            if s[k] != ")":
                return -1
            j = k + 1
            if s[j] == "(":
                j = self.parameters(j)
                if j < 0:
                    return -1
        elif s[j] in "im":
            j += 1
        while s[j] == "[":
            k = j + 1 if s[j + 1] == "]" else self.expr(j + 1)
            if k < 0 or s[k] != "]":
                return -1
            j = k + 1
        if s[j] == "=":
            j = self.template_value(j + 1) if template else self.expr(j + 1, False)
        return j

    def parameters(self, i: int) -> int:
        s = self.s
        if s[i] != "(":
            return -1
        i += 1
        if s[i] == ")":
            return i + 1
        if s[i] == "T" and s[i + 1] == ")":
            return i + 2
        while True:
            i = self.parameter(i)
            if i < 0:
                return -1
            if s[i] == "…":
                i += 1
            if s[i] == ")":
                return i + 1
            if s[i] != ",":
                return -1
            i += 1

    def attributes(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] == "[" and s[i + 1] == "[":
                j = s.find("]]", i)
                if j < 0:
                    return i
                i = j + 2
            elif s[i] == "z" and s[i + 1] == "(":  # alignas(...)
                j = self.arguments(i + 1)
                if j < 0 or s[j] in "\x01;=":
                    return i
                i = j
            else:
                return i

    def declarator(self, i: int) -> int:
        """A name with pointers before and its array or function parts after."""
        s = self.s
        i = self.pointers(i)
        if s[i] == "…":
            i += 1
        if s[i] == "(":
            j = self.pointers(i + 1)
            if j == i + 1 and s[j] not in "i":
                return -1
            j = self.declarator(j)
            if j < 0 or s[j] != ")":
                return -1
            i = j + 1
        elif s[i] == "[":
            j = s.find("]", i)  # structured binding
            return j + 1 if j > 0 and re.fullmatch(r"[im](?:,[im])*", s[i + 1 : j]) else -1
        else:
            i = self.id_expr(i)
            if i < 0:
                return -1
        while True:
            if s[i] == "[":
                j = i + 1 if s[i + 1] == "]" else self.expr(i + 1)
                if j < 0 or s[j] != "]":
                    return -1
                i = j + 1
            elif s[i] == "(":
                j = self.parameters(i)
                if j > 0:
                    i = self.function_tail(j)
                else:
                    i = self.arguments(i)
                if i < 0:
                    return -1
            else:
                return self.attributes(i)

    def function_tail(self, i: int) -> int:
        s = self.s
        while True:
            if s[i] in "Q&∧":
                i += 1
            elif s[i] == "i" and s[i + 1] in "i;=b\x01→m:":
                i += 1  # override, final
            elif s[i] == "m" and s[i + 1] in ";\x01":
                i += 1
            elif s[i] in "zO":
                i += 1
                if s[i] == "(":
                    i = self.arguments(i)
                    if i < 0:
                        return -1
            elif s[i] == "→":
                return self.type_id(i + 1)
            else:
                return i

    def declaration(self, i: int) -> int:
        """Without the final ';'."""
        s = self.s
        i = self.attributes(i)
        while s[i] == "M":
            if s[i + 1] == "<":
                i = self.template_head(i + 1)
                if i < 0:
                    return -1
                if s[i] == "i" and s[i + 1] == "<":  # requires-like words
                    break
            else:
                i += 1
        if s[i] == "Q" and s[i + 1] == "s":
            i += 2
        start = i
        while s[i] in "Q":
            i += 1
        # constructors, destructors and conversions have no type
        j = self.id_expr(i) if s[i] in "im~o∷" else -1
        if j > 0 and s[j] == "(":
            k = self.parameters(j)
            if k > 0:
                k = self.function_tail(k)
                if k > 0:
                    k = self.initialiser(k)
                    if k > 0 and s[k] == "\x01":
                        return k
        j = self.type_name(start)
        if j < 0:
            return -1
        if s[j] == "\x01":
            return j if s[start] in "KeQM" or s[start:j].find("K") >= 0 or "e" in s[start:j] else -1
        if s[j] == "b":  # enum or class body, then perhaps names
            j += 1
            if s[j] == "\x01":
                return j
        elif s[j] == ":" and "e" in s[start:j]:
            j = self.type_id(j + 1)
            return j if j > 0 and s[j] in "\x01" else -1
        while True:
            if s[j] == ":":  # an unnamed bit field
                k = j
            else:
                k = self.declarator(j)
            if k < 0:
                return -1
            k = self.initialiser(k)
            if k < 0:
                return -1
            if s[k] != ",":
                return k
            j = k + 1

    def initialiser(self, i: int) -> int:
        s = self.s
        if s[i] == ":" and s[i + 1] != ":":
            i = self.expr(i + 1, False)
            if i < 0:
                return -1
        if s[i] == "=":
            if s[i + 1] in "Xd":
                return i + 2
            return self.expr(i + 1, False)
        if s[i] == "b":
            return i + 1
        return i

    def using(self, i: int) -> bool:
        s = self.s
        if s[i] == "P":
            j = self.id_expr(i + 1)
            return j > 0 and s[j] == "\x01"
        if s[i] in "im" and s[i + 1] == "=":
            j = self.type_id(i + 2)
            return j > 0 and s[j] == "\x01"
        while True:
            if s[i] == "Q":
                i += 1
            j = self.id_expr(i)
            if j < 0:
                return False
            if s[j] == "…":
                j += 1
            if s[j] == "\x01":
                return True
            if s[j] != ",":
                return False
            i = j + 1

    def condition(self, i: int) -> int:
        """'(' expression or declaration ')'; gives the place after."""
        s = self.s
        if s[i] != "(":
            return -1
        depth, j = 0, i
        while True:
            if s[j] == "(":
                depth += 1
            elif s[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            elif s[j] == "\x01":
                return -1
            j += 1
        inner = s[i + 1 : j]
        return j + 1 if inner and all(_simple(x) for x in inner.split(";")) else -1


_MEMO: dict[tuple[str, str], bool] = {}


def _remember(kind: str, shape: str, value: bool) -> bool:
    if len(_MEMO) > 200_000:
        _MEMO.clear()
    _MEMO[kind, shape] = value
    return value


def _simple(shape: str) -> bool:
    """An expression or a declaration."""
    known = _MEMO.get(("x", shape))
    if known is None:
        p = _Shape(shape)
        i = p.expr(0)
        known = i > 0 and p.s[i] == "\x01"
        if not known:
            p = _Shape(shape)
            i = p.declaration(0)
            known = i > 0 and p.s[i] == "\x01"
        if not known:
            # macros that stand for specifiers
            bare = shape.lstrip("m")
            known = bool(bare) and bare != shape and not bare.startswith("(") and _simple(bare)
        if not known and shape.startswith("m("):
            j = _closing(shape, 1)
            known = j > 0 and j + 1 < len(shape) and _simple(shape[j + 1 :])
        _remember("x", shape, known)
    return known


def _closing(shape: str, i: int) -> int:
    depth = 0
    for j in range(i, len(shape)):
        if shape[j] == "(":
            depth += 1
        elif shape[j] == ")":
            depth -= 1
            if depth == 0:
                return j
    return -1


def _for_head(inner: str) -> bool:
    parts = inner.split(";")
    if len(parts) == 3:
        return all(not x or _simple(x) for x in parts)
    if len(parts) > 2:
        return False
    if len(parts) == 2 and not _simple(parts[0]):
        return False
    p = _Shape(parts[-1])
    i = p.type_name(0)
    if i < 0:
        return False
    i = p.declarator(i)
    if i < 0 or p.s[i] != ":":
        return False
    i = p.expr(i + 1)
    return i > 0 and p.s[i] == "\x01"


def _control(shape: str) -> int:
    """The place after 'if (...)' and the like at the start of the shape, 0 if none, -1 if broken."""
    c = shape[0]
    if c in "IWSH":
        i = 1
        if c == "I" and shape[1:2] == "Q":
            i = 2
        if shape[i : i + 1] != "(":
            return -1
        j = _closing(shape, i)
        if j < 0:
            return -1
        inner = shape[i + 1 : j]
        if c == "H":
            return j + 1 if inner == "…" or _Shape(inner).parameter(0) == len(inner) else -1
        parts = inner.split(";")
        return j + 1 if len(parts) < 3 and all(_simple(x) for x in parts) else -1
    if c == "F":
        j = _closing(shape, 1) if shape[1:2] == "(" else -1
        return j + 1 if j > 0 and _for_head(shape[2:j]) else -1
    if c in "ED":
        return 1
    return 0


def _statement(shape: str) -> bool:
    """One statement of a function body, without its ';'."""
    known = _MEMO.get(("s", shape))
    if known is None:
        known = _remember("s", shape, _statement_(shape))
    return known


def _statement_(shape: str) -> bool:
    if not shape:
        return True
    c = shape[0]
    if c in "IWSFED":
        i = _control(shape)
        return i > 0 and (_statement(shape[i:]))
    if c == "R":
        return len(shape) == 1 or _expression(shape[1:])
    if c == "B":
        return len(shape) == 1
    if c == "G":
        return shape == "Gi"
    if c == "U":
        return _Shape(shape).using(1)
    if c == "P":
        return re.fullmatch(r"P[im]=∷?[im](?:∷[im])*", shape) is not None
    return _simple(shape)


def _expression(shape: str) -> bool:
    known = _MEMO.get(("v", shape))
    if known is None:
        p = _Shape(shape)
        i = p.expr(0)
        known = _remember("v", shape, i > 0 and p.s[i] == "\x01")
    return known


def _member(shape: str) -> bool:
    """One declaration outside a function, without its ';'."""
    known = _MEMO.get(("m", shape))
    if known is None:
        if not shape:
            known = True
        elif shape[0] == "U":
            known = _Shape(shape).using(1)
        elif shape[0] == "P":
            known = re.fullmatch(r"P[im]=∷?[im](?:∷[im])*", shape) is not None
        elif re.fullmatch(r"[im]\([^()]*\)", shape):
            known = _simple(shape)
        else:
            p = _Shape(shape)
            i = p.declaration(0)
            known = i > 0 and p.s[i] == "\x01"
            if not known and shape[0] == "i" and shape[1:2] == "(":  # static_assert and other calls
                known = _expression(shape)
            if not known and shape[0] == "M":
                j = p.template_head(1)
                known = j > 0 and shape[j] == "U" and _Shape(shape[j:]).using(1)
            if not known:
                bare = re.sub(r"^(?:m(?:\([^()]*\))?)+", "", shape)
                known = bare != shape and (not bare or _member(bare))
        _remember("m", shape, known)
    return known


_CLASS_HEAD = re.compile(r"(?:M<[^{}()]*>)*[QUi]*?K(?:\[\[[^\]]*\]\])?(?:m(?=[im]))?(?:[im](?:<.*>)?(?:∷[im](?:<.*>)?)*)?i?(?::[^:].*)?\Z")
_ENUM_HEAD = re.compile(r"Q*eK?(?:[im](?:∷[im])*)?(?::[QTim∷]+)?\Z")
_NAMESPACE_HEAD = re.compile(r"Q?P(?:[im](?:∷Q?[im])*)?\Z")
_LAMBDA_TAIL = re.compile(r"\[[^\[\]]*\](?:<[^<>]*>)?(?:\(.*\))?[Qzi]*(?:→[^()=]*)?\Z")
_BASES = re.compile(r":(?:[AQ]*∷?[im](?:<.*?>)?(?:∷[im](?:<.*?>)?)*…?(?:,(?=.)|\Z))+\Z")
_STRUCTURE = re.compile(r"[;{}()\[\]]")


def _head_kind(shape: str, inside: str) -> str:
    """What a '{' after this shape opens: block, class, namespace, enum, init, or '' for an error."""
    known = _MEMO.get((inside, shape))
    if known is None:
        known = _head_kind_(shape, inside)
        _remember(inside, shape, known)  # type: ignore[arg-type]
    return known  # type: ignore[return-value]


def _head_kind_(shape: str, inside: str) -> str:
    if not shape:
        return "block" if inside == "f" else ""
    c = shape[0]
    if inside == "f":
        rest = shape
        while rest and rest[0] in "IWSFHED":
            i = _control(rest)
            if i <= 0:
                # a lambda or list inside the parentheses is not reached here
                return ""
            rest = rest[i:]
        if not rest or rest == "Y":
            return "block"
        if rest != shape:
            shape, c = rest, rest[0]
        if shape[-1] in "RC":
            return "init"
    if c in "PQ" and _NAMESPACE_HEAD.match(shape):
        return "" if inside == "f" else "namespace"
    if shape == "Qs" or shape == "Ys":
        return "namespace"
    if _ENUM_HEAD.match(shape):
        return "enum"
    if "K" in shape and _CLASS_HEAD.match(shape):
        base = re.search(r"(?<!:):(?!:).*", shape)
        if base is None or _BASES.match(base.group()):
            return "class"
        return ""
    if inside != "f" or c in "QT" or "(" in shape:
        body = re.sub(r"^(?:m(?:\([^()]*\))?)+(?=[^(∷<*&])", "", shape) if inside != "f" else shape
        for s in dict.fromkeys((shape, body)):
            if _function_head(s):
                return "block" if inside != "f" or not _LAMBDA_TAIL.search(shape) else "lambda"
    if _LAMBDA_TAIL.search(shape):
        return "lambda"
    if inside == "f" and re.fullmatch(r"[im]\(.*\)", shape) and _closing(shape, 1) == len(shape) - 1 and shape[0] == "m":
        return "block"
    if shape[-1] in "=imb>,(?:]←RT" or shape[-1] == "∷":
        return "init"
    return ""


def _function_head(shape: str) -> bool:
    """type name(parameters) tail, perhaps with constructor initialisers."""
    p = _Shape(shape)
    s = p.s
    i = p.attributes(0)
    while s[i] == "M":
        if s[i + 1] != "<":
            return False
        i = p.template_head(i + 1)
        if i < 0:
            return False
    starts = [i]
    j = i
    while s[j] == "Q":
        j += 1
    options = []
    if s[j] in "im~o∷":
        options.append(j)
    t = p.type_name(starts[0])
    if t > 0:
        options.append(p.pointers(t))
    for k in options:
        n = p.id_expr(k)
        if n < 0 or s[n] != "(":
            continue
        e = p.parameters(n)
        if e < 0:
            continue
        e = p.function_tail(e)
        if e < 0:
            continue
        if s[e] == "i" and s[e + 1] == "\x01":
            e += 1
        if s[e] == "Y":
            e += 1
        if s[e] == "\x01":
            return True
        if s[e] == ":":
            e += 1
            while True:
                e = p.id_expr(e)
                if e < 0:
                    break
                if s[e] == "<":
                    e = p.template_args(e)
                    if e < 0:
                        break
                if s[e] == "(":
                    e = p.arguments(e)
                elif s[e] == "b":
                    e += 1
                else:
                    e = -1
                if e < 0:
                    break
                if s[e] == "…":
                    e += 1
                if s[e] == "\x01":
                    return True
                if s[e] != ",":
                    break
                e += 1
    return False


class _Bad(Exception):
    pass


class _Blocks:
    def __init__(self, letters: str):
        self.s = letters
        self.n = len(letters)
        self.end_definition = False

    def sequence(self, i: int, inside: str, depth: int, whole: bool = True) -> int:
        """Statements up to '}' or the end; gives the place of that mark."""
        s, n = self.s, self.n
        previous = ""
        while i < n:
            c = s[i]
            if c == "}":
                return i
            if c == ";":
                i += 1
                previous = ""
                continue
            if inside == "c" and c == "A":
                j = i + 1
                while j < n and s[j] in "im":
                    j += 1
                if s[j : j + 1] != ":":
                    raise _Bad
                i = j + 1
                continue
            if inside == "f":
                if c == "C":
                    j = self.label(i + 1)
                    if not _expression(s[i + 1 : j]):
                        raise _Bad
                    i = j + 1
                    continue
                if c == "X" and s[i + 1 : i + 2] == ":":
                    i += 2
                    continue
                if c in "im" and s[i + 1 : i + 2] == ":":
                    i += 2
                    continue
                if c == "E" and previous != "I":
                    raise _Bad
                if c == "H" and previous not in ("Y", "H"):
                    raise _Bad
            previous = c if c != "E" or s[i + 1 : i + 2] != "I" else "I"
            i = self.statement(i, inside, depth, whole)
        return i

    def label(self, i: int) -> int:
        s = self.s
        depth = 0
        while i < self.n:
            c = s[i]
            if c == "(":
                depth += 1
            elif c == ")":
                depth -= 1
            elif c == ":" and depth == 0:
                return i
            elif c in ";{}":
                break
            i += 1
        raise _Bad

    def statement(self, i: int, inside: str, depth: int, whole: bool) -> int:
        s, n = self.s, self.n
        shape = ""
        start = i
        level: list[str] = []
        while True:
            m = _STRUCTURE.search(s, i)
            if m is None:
                shape += s[start:n]
                if level:
                    raise _Bad
                return self.finish(shape, inside, whole, n)
            i = m.start()
            c = s[i]
            if c in "([":
                level.append(")" if c == "(" else "]")
                i += 1
            elif c in ")]":
                if not level or level.pop() != c:
                    raise _Bad
                i += 1
            elif c == ";":
                i += 1
                if level:
                    continue
                shape += s[start : i - 1]
                if not (_statement(shape) if inside == "f" else _member(shape)):
                    raise _Bad
                return i
            elif c == "}":
                if level:
                    raise _Bad
                shape += s[start:i]
                # only a macro can stand without a ';'
                if re.fullmatch(r"(?:m(?:\([^()]*\))?)+", shape):
                    return i
                raise _Bad
            else:
                shape += s[start:i]
                kind = ("lambda" if _LAMBDA_TAIL.search(shape) else "init") if level else _head_kind(shape, inside)
                if not kind:
                    raise _Bad
                if kind in ("block", "namespace"):
                    j = self.sequence(i + 1, "f" if kind == "block" else "n", depth + 1)
                    if j >= n:
                        raise _Bad
                    return j + 1
                if kind == "lambda":
                    j = self.sequence(i + 1, "f", depth + 1)
                elif kind == "class":
                    j = self.sequence(i + 1, "c", depth + 1)
                else:
                    j = self.listing(i + 1, kind == "enum", depth + 1)
                if j >= n:
                    raise _Bad
                if kind == "class":
                    # what follows declares names of that class
                    if j + 1 >= n:
                        if whole:
                            raise _Bad
                        return n
                    shape, start, i = "Ki", j + 1, j + 1
                    continue
                shape += "b"
                start = i = j + 1

    def finish(self, shape: str, inside: str, whole: bool, n: int) -> int:
        """The text ends without a ';'."""
        if re.fullmatch(r"(?:m(?:\([^()]*\))?)+", shape) or not shape:
            return n
        if not whole and inside == "n" and shape[-1] == "b" and _member(shape):
            return n
        if not whole and re.fullmatch(r"(?:M<.*>)?Q*[Ke]K?[im]", shape):
            return n
        raise _Bad

    def listing(self, i: int, enum: bool, depth: int) -> int:
        """The elements of '{...}'; gives the place of the '}'."""
        s, n = self.s, self.n
        shape, start, level = "", i, []
        elements = set()
        while True:
            while i < n and s[i] not in ";{}()[],":
                i += 1
            if i >= n:
                raise _Bad
            c = s[i]
            if c in "([":
                level.append(")" if c == "(" else "]")
                i += 1
            elif c in ")]":
                if not level or level.pop() != c:
                    raise _Bad
                i += 1
            elif c == ";":
                raise _Bad
            elif c == "{":
                shape += s[start:i]
                if _LAMBDA_TAIL.search(shape):
                    j = self.sequence(i + 1, "f", depth + 1)
                else:
                    j = self.listing(i + 1, False, depth + 1)
                if j >= n:
                    raise _Bad
                shape += "b"
                start = i = j + 1
            elif level:
                if c == "}":
                    raise _Bad
                i += 1
            elif c == ",":
                elements.add(shape + s[start:i])
                i += 1
                shape, start = "", i
            else:
                last = shape + s[start:i]
                if last:
                    elements.add(last)
                break
        for e in elements:
            if enum:
                if not re.fullmatch(r"[im](?:\[\[.*\]\])?(?:=(.+))?", e) or ("=" in e and not _expression(e.split("=", 1)[1])):
                    raise _Bad
            elif not (_expression(e) or (e[:1] == "." and re.match(r"\.[im][=b]", e) and (e[2] == "b" or _expression(e[3:])))):
                # a template argument list may have been cut at its comma
                joined = re.search("<", "".join(elements))
                if not joined:
                    raise _Bad
        return i


def validate(text: str, whole: bool = True) -> bool:
    """Whether the text is a C++ file or, if not whole, one definition (a class without its last semicolon)."""
    letters, branches = _letters(text)
    if not _check(letters, whole):
        return False
    # every branch of every conditional is read once
    return all(_check(_letters(text, k)[0], whole) for k in range(1, branches))


def _check(letters: str | None, whole: bool) -> bool:
    if letters is None or "\0" in letters:
        return False
    if not letters:
        return whole
    try:
        with deep(len(letters)):
            return _Blocks(letters).sequence(0, "n", 0, whole) == len(letters)
    except (_Bad, IndexError):
        return False
