"""Symbols, imports, calls and type references of languages whose blocks are in braces.

TypeScript, JavaScript, Go, Java and Rust are cut into tokens first: a stack of modes
tells code from templates and the code nested in them, a regular expression from a
division by the token before, a lifetime from a character.  One pass over the tokens
then follows brackets and recognises declarations by their words.  Code that does not
balance gives what could be read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass, field

_STRING = r'"(?:\\.|[^"\\\n])*"?'
_QUOTED = r"'(?:\\.|[^'\\\n])*'?"
#: What is text in a language, long forms first.
_TEXTS = {
    "js": rf"{_STRING}|{_QUOTED}",
    "go": rf"{_STRING}|{_QUOTED}|`[^`]*`?",
    "java": rf'"""(?:\\.|[^\\])*?(?:"""|\Z)|{_STRING}|{_QUOTED}',
    "rs": r'b?r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)|b?"(?:\\.|[^"\\])*"?|b?\'(?:\\.[^\']*|[^\'\\\n])\'',
}
_LEXERS = {
    k: re.compile(rf"(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>{v})|(?P<mark>'\w+)|(?P<name>#?(?:[^\W\d]|\$)[\w$]*)|(?P<number>\d\w*(?:\.\d\w*)?)|(?P<sign>=>|->|::|\?\.(?!\d)|\.\.\.|.)", re.S)
    for k, v in _TEXTS.items()
}
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(`|\$\{|\Z)", re.S)
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_LANGUAGES = {"ts": "js", "tsx": "js", "jsx": "js", "mjs": "js", "cjs": "js", "js": "js", "go": "go", "java": "java", "rs": "rs"}
_CLOSERS = {")": "(", "]": "[", "}": "{"}

#: Words that are neither called nor operands.
_KEYWORDS = set(
    "if for while switch catch return function func fn new await async typeof else do try with in of instanceof synchronized"
    " class interface enum struct trait impl import export throw yield delete void case finally default extends implements const let var".split()
).union("static public private protected abstract final readonly override declare get set".split())
_OWN_KEYWORDS = {"js": set(), "java": {"throws", "record"}, "go": {"go", "select", "defer", "range", "type", "map", "chan"}, "rs": {"match", "loop", "unsafe", "where", "use", "mod", "pub", "mut", "ref", "move", "dyn", "as"}}
#: Names that only lead a chain, and words that may end an operand.
_SELVES = {"this", "super", "self", "Self", "crate"}
#: Words after which a new statement has begun.
_STARTS = {"function", "class", "const", "let", "var", "export", "import", "interface", "func", "fn", "impl", "enum", "struct", "trait"}
_TYPES = {"js": {"class", "interface", "enum"}, "java": {"class", "interface", "enum", "record"}, "rs": {"struct", "enum", "trait", "union"}, "go": set()}


def tokens(text: str, language: str) -> list[tuple[str, str, int]]:
    """(kind, text, start) of the tokens: name, number, text, mark (a lifetime) or sign; no comments.

    The code in a template comes in brackets between its texts.
    """
    lexer, out, at, depth = _LEXERS[language], [], 0, 0
    holes: list[int] = []  # depth of braces at which the code in a template ends
    control: list[bool] = []  # whether a bracket belongs to if, for, while or with
    after_control = False

    def template(at: int) -> int:
        m = _TEMPLATE.match(text, at)
        out.append(("text", m[0], at))
        if m[1] == "${":
            holes.append(depth)
            out.append(("sign", "(", m.end() - 1))
        return m.end()

    while at < len(text):
        m = lexer.match(text, at)
        kind, word, start, at = m.lastgroup, m[0], at, m.end()
        if kind == "hash":
            kind = "text"
        if kind == "blank":
            if language == "rs" and word.startswith("/*"):  # comments nest
                level = 0
                for x in re.compile(r"/\*|\*/").finditer(text, start):
                    level += 1 if x[0] == "/*" else -1
                    at = x.end()
                    if not level:
                        break
                else:
                    at = len(text)
            continue
        if kind == "sign" and language == "js":
            last = out[-1] if out else ("", "", 0)
            operand = last[0] in ("number", "text") or (last[0] == "name" and last[1] not in _KEYWORDS) or last[1] == "]" or (last[1] == ")" and not after_control)
            if word == "`":
                at = template(at)
                continue
            if word == "/" and not operand and (m := _PATTERN.match(text, start)):
                out.append(("text", m[0], start))
                at = m.end()
                continue
            if word == "(":
                control.append(last[1] in ("if", "for", "while", "with"))
            elif word == ")":
                after_control = control.pop() if control else False
            elif word == "}" and holes and holes[-1] == depth:
                holes.pop()
                out.append(("sign", ")", start))
                at = template(at)
                continue
        depth += (word == "{") - (word == "}") if kind == "sign" else 0
        out.append((kind, word, start))
    return out


def pair(found: list[tuple[str, str, int]]) -> dict[int, int]:
    """Token numbers of opening brackets and of what closes them; unbalanced ones are left out."""
    out, held = {}, []
    for i, (kind, word, _) in enumerate(found):
        if kind == "sign" and word in "([{":
            held.append(i)
        elif kind == "sign" and word in _CLOSERS:
            while word == "}" and held and found[held[-1]][1] != "{":
                held.pop()  # a stray bracket takes no block with it
            if held and found[held[-1]][1] == _CLOSERS[word]:
                out[held.pop()] = i
    return out


@dataclass
class _Scope:
    """Up to which token it reaches, what stands in it, the names around, and the symbol it belongs to."""

    end: int
    mode: str
    around: list[str] = field(default_factory=list)
    owner: str = ""
    inside: bool = False  # in a function


class _Reader:
    """One pass over the tokens of a file."""

    def __init__(self, content: str, language: str):
        self.content, self.language = content, language
        self.t = tokens(content, language)
        self.pairs, self.n = pair(self.t), len(self.t)
        self.breaks = [m.start() for m in re.finditer("\n", content)]
        self.lines, self.rows = content.split("\n"), []
        self.keywords = _KEYWORDS | _OWN_KEYWORDS[language]
        self.scopes, self.opens = [_Scope(self.n, "code")], {}

    def w(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < self.n and self.t[i][0] != "text" else ""

    def name(self, i: int) -> bool:
        return 0 <= i < self.n and self.t[i][0] == "name"

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.breaks, self.t[i][2]) + 1

    def past(self, i: int) -> int:
        """The token after the bracket that opens at ``i``."""
        return self.pairs.get(i, i) + 1

    def generics(self, i: int) -> int:
        """The token after a list of types in angles that opens at ``i``; ``i`` if none does."""
        at, level = i, 0
        while self.w(i) == "<" and at < self.n and at - i < 400:
            word = self.w(at)
            if word == "<":
                level += 1
            elif word == ">":
                level -= 1
                if not level:
                    return at + 1
            elif word in "([{" and word:
                if at not in self.pairs:
                    return i
                at = self.pairs[at]
            elif word in (";", ")", "]", "}", "+", "/", "%", "!"):
                return i
            at += 1
        return i

    def body(self, i: int) -> int | None:
        """The brace that opens the body of a declaration whose head goes on at ``i``."""
        while i < self.n:
            word, before = self.w(i), self.w(i - 1)
            if word == "{":
                if before in (":", "|", "&", "interface", "struct") and i in self.pairs:
                    i = self.past(i)  # a type
                    continue
                return i if i in self.pairs else None
            if word in (";", "}", ")", "]", "=") or (word in _STARTS and word not in ("interface", "struct", "fn", "impl", "func")):
                return None
            i = self.past(i) if word in ("(", "[") else i + 1
        return None

    def value(self, i: int) -> tuple[int, int, bool] | None:
        """(first token of its head, end, whether in braces) of a function that is a value at ``i``."""
        i += self.w(i) == "async"
        if self.w(i) == "function":
            i += 1 + (self.w(i + 1) == "*")
            i += self.name(i)
            brace = self.body(self.past(self.generics(i)))
            return (i, self.pairs[brace], True) if brace is not None else None
        head, i = i, self.generics(i) if self.w(i) == "<" else i
        if self.w(i) == "(" and i in self.pairs:
            i = self.past(i)
            if self.w(i) == ":":  # up to the arrow, which no statement's end comes before
                while i < self.n and self.w(i) not in ("=>", ";", "=", ",", ")", "}"):
                    i = self.past(i) if self.w(i) in ("(", "[", "{") else self.generics(i) if self.w(i) == "<" and self.generics(i) > i else i + 1
        elif self.name(i) and self.w(i) not in self.keywords:
            i += 1
        else:
            return None
        if self.w(i) != "=>":
            return None
        i += 1
        if self.w(i) == "{" and i in self.pairs:
            return head, self.pairs[i], True
        while i < self.n and self.w(i) not in (",", ";", ")", "]", "}"):
            i = self.past(i)
            if self.name(i) and self.t[i - 1][0] != "sign" and self.line(i) > self.line(i - 1):
                break
            if self.name(i) and self.w(i - 1) in (")", "]", "}") and self.line(i) > self.line(i - 1):
                break
        return head, i - 1, False

    def symbol(self, first: int, last: int, kind: str, name: str, receiver: str | None = None) -> _Scope:
        """Notes a symbol from token ``first`` to ``last`` and enters its head."""
        s = self.scopes[-1]
        if kind == "function" and s.mode in ("class", "impl", "object"):
            kind = "method"
        qualified = ".".join([receiver, name] if receiver else [*s.around, name])
        a, b = self.line(first), self.line(min(last, self.n - 1))
        text = "".join("".join(self.lines[a - 1 : b]).split())
        self.rows.append({"row": "symbol", "kind": kind, "name": name, "qualified_name": qualified, "line": a, "end_line": b, "hash": hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest(), "closure": kind == "function" and s.inside})
        around = [receiver, name] if receiver else [*s.around, name]
        scope = _Scope(last, "head", around, qualified, s.inside or kind in ("function", "method"))
        self.scopes.append(scope)
        return scope

    def enter(self, brace: int | None, scope: _Scope, mode: str) -> None:
        """What is in the braces that open at ``brace`` has that mode."""
        if brace is not None:
            self.opens[brace] = _Scope(self.pairs[brace], mode, scope.around, scope.owner, scope.inside)

    def note(self, row: str, i: int, name: str, kind: str | None = None) -> None:
        self.rows.append({"row": row, "name": name, "line": self.line(i), **({"kind": kind} if kind else {"qualified_name": self.scopes[-1].owner})})

    def read(self) -> list[dict]:
        i = 0
        while i < self.n:
            while self.scopes[-1].end < i:
                self.scopes.pop()
            if i in self.opens:
                self.scopes.append(self.opens.pop(i))
                i += 1
            elif self.t[i][0] == "name":
                i = self.declared(i) or self.called(i)
            else:
                self.braces_or_type(i)
                i += 1
        return self.rows

    def braces_or_type(self, i: int) -> None:
        word, s = self.w(i), self.scopes[-1]
        if word == "{" and i in self.pairs and self.language == "js" and s.mode != "iface":
            before = self.w(i - 1)
            literal = before in ("(", ",", "=", "[", "?", "&", "|", "return", ":", "...")
            if before == ":":
                tail = [self.w(k) for k in range(max(0, i - 8), i)]
                for k in reversed(tail):
                    if k in ("case", "default"):
                        literal = False
                    if k in ("{", "}", ";", "case", "default"):
                        break
            if literal:
                given = [self.w(i - 2)] if before in ("=", ":") and self.name(i - 2) else []
                self.opens[i] = _Scope(self.pairs[i], "object", [*s.around, *given], s.owner, s.inside)
                self.scopes.append(self.opens.pop(i))
            elif s.mode == "object":
                self.scopes.append(_Scope(self.pairs[i], "code", s.around, s.owner, s.inside))
        elif word == "{" and i in self.pairs and s.mode in ("class", "impl", "object"):
            self.scopes.append(_Scope(self.pairs[i], "code", s.around, s.owner, s.inside))
        elif word == ":" and self.name(i + 1) and self.w(i + 1)[:1].isupper():
            self.note("type_ref", i + 1, self.w(i + 1))

    def declared(self, i: int) -> int | None:
        """Reads the declaration or import that begins at name ``i``; the token to go on with, if there is one."""
        word, lang, s = self.w(i), self.language, self.scopes[-1]
        if self.w(i - 1) in (".", "?.", "::"):
            return None
        if word in ("import", "export", "require", "use"):
            self.imported(i)
        if word in _TYPES[lang] and self.name(i + 1) or (word == "class" and lang == "js" and self.w(i + 1) in ("{", "extends")):
            named = self.name(i + 1) and self.w(i + 1) != "extends"
            default = self.w(i - 1) == "default"
            if named or default:
                return self.type_body(i, i + 1 + named if named else i + 1, word, self.w(i + 1) if named else "default")
            brace = self.body(i + 1)
            self.enter(brace, s, "class")
            return None
        if lang == "go" and (word == "type" or s.mode == "types") and (self.w(i + 1) == "(" and word == "type"):
            self.opens[i + 1] = _Scope(self.pairs.get(i + 1, i + 1), "types", s.around, s.owner, s.inside)
            return i + 1
        if lang == "go" and (word == "type" or s.mode == "types"):
            at = i + (word == "type")
            after = self.past(at + 1) if self.w(at + 1) == "[" and self.w(self.past(at + 1)) in ("struct", "interface") else at + 1
            if self.name(at) and self.w(after) in ("struct", "interface"):
                return self.type_body(i, after + 1, self.w(after), self.w(at))
            if self.name(at) and (word == "type" or self.w(at + 1) == "="):
                end = at + 1 + (self.w(at + 1) == "=")
                self.symbol(i, end, "type", self.w(at))
                return end + 1
        if word == "type" and self.name(i + 1) and lang in ("js", "rs"):
            at = self.generics(i + 2) if self.w(i + 2) == "<" else i + 2
            if self.w(at) == "=":
                self.symbol(i, at, "type", self.w(i + 1))
                return at + 1
        if word == "impl" and lang == "rs":
            return self.implementation(i)
        if (word == "function" and lang == "js") or (word == "fn" and lang == "rs"):
            at = i + 1 + (self.w(i + 1) == "*")
            default = self.w(i - 1) == "default" and self.w(at) == "("
            if self.name(at) or default:
                head = self.past(self.generics(at + (not default)))
                return self.function(i, at, head, "default" if default else self.w(at))
        if word == "func" and lang == "go":
            at, receiver = i + 1, None
            if at in self.pairs and self.w(at) == "(" and self.name(self.past(at)) and self.w(self.past(at) + 1) in ("(", "["):
                inner = range(at + 1, self.pairs[at])
                stop = next((k for k in inner if self.w(k) == "["), self.pairs[at])
                receiver = next((self.w(k) for k in range(stop - 1, at, -1) if self.name(k)), None)
                at = self.past(at)
            if self.name(at):
                head = self.past(at + 1) if self.w(at + 1) == "[" else at + 1
                return self.function(i, at, self.past(head), self.w(at), receiver)
        if lang == "js" and word in ("const", "let", "var") and self.name(i + 1):
            at = i + 2
            while at < self.n and at - i < 200 and self.w(at) not in ("=", ";", ",", "of", "in", "}", ")") and self.w(at) not in _STARTS:
                at = self.past(at) if self.w(at) in ("(", "[", "{") else at + 1
            return self.valued(i, i + 1, at)
        if lang == "js" and word == "default" and self.w(i - 1) == "export":
            return self.valued(i, i, i)
        if s.mode in ("class", "object") and word not in _STARTS - {"default"}:
            return self.member(i)
        return None

    def type_body(self, first: int, at: int, word: str, name: str) -> int:
        """A declared type whose head goes on at ``at``; what it extends is referred to."""
        head = self.generics(at)
        brace = at if self.w(at) == "{" and at in self.pairs else self.body(self.past(head) if self.w(head) == "(" else head)
        semi = next((k for k in range(at, min(at + 200, self.n)) if self.w(k) == ";"), at)
        end = self.pairs[brace] if brace is not None else semi if self.language == "rs" else at
        kind = {"record": "class", "enum": "type", "union": "struct"}.get(word, word)
        scope = self.symbol(first, end, kind, name)
        self.enter(brace, scope, {"interface": "class" if self.language == "java" else "iface", "trait": "impl", "struct": "iface" if self.language in ("go", "rs") else "class"}.get(word, "class" if self.language != "rs" else "iface"))
        taken, k = False, at
        while k < (brace if brace is not None else end):
            if self.w(k) in ("extends", "implements"):
                taken = True
            elif taken and self.name(k) and self.w(k - 1) in ("extends", "implements", ","):
                self.note("type_ref", k, self.w(k))
            k = self.generics(k) if self.w(k) == "<" and self.generics(k) > k else k + 1
        return brace if brace is not None else at

    def implementation(self, i: int) -> int | None:
        brace = self.body(i + 1)
        if brace is None:
            return None
        at, target, trait = self.generics(i + 1), None, None
        while at < brace and self.w(at) != "where":
            if self.w(at) == "for":
                target, trait = None, target
            elif self.name(at) and self.w(at) not in ("dyn", "mut"):
                target = self.w(at)
            at = self.generics(at) if self.w(at) == "<" and self.generics(at) > at else at + 1
        if trait:
            self.note("type_ref", i, trait)
        s = self.scopes[-1]
        self.opens[brace] = _Scope(self.pairs[brace], "impl", [*s.around, target] if target else s.around, s.owner, s.inside)
        return brace

    def function(self, first: int, name_at: int, head: int, name: str, receiver: str | None = None) -> int:
        """A function whose parameters end before ``head``; a mere signature is none, unless in a trait."""
        brace = self.body(head)
        if brace is None and not (self.language == "go" or self.w(head) == ";"):
            return name_at + 1
        scope = self.symbol(first, self.pairs[brace] if brace is not None else head - 1, "method" if receiver else "function", name, receiver)
        self.enter(brace, scope, "code")
        return name_at + 1

    def valued(self, first: int, name_at: int, at: int) -> int | None:
        """A name that is given a function; ``at`` is the sign before the value."""
        found = self.value(at + 1) if self.w(at) == "=" or at == name_at else None
        if not found:
            return None
        head, end, braces = found
        scope = self.symbol(first, end, "function", self.w(name_at))
        if braces:
            self.enter(next(k for k in range(end, head - 1, -1) if self.pairs.get(k) == end), scope, "code")
        return head

    def member(self, i: int) -> int | None:
        """A method, or a field that is given a function, in a class or an object."""
        at = self.generics(i + 1) if self.w(i + 1) == "<" else i + 1
        before = self.w(i - 1)
        if self.w(at) == "(" and at in self.pairs and before not in ("new", "=", "@", "return", "await", "?", "=>", "(", "+") and self.w(i) not in ("if", "for", "while", "switch", "catch", "function"):
            after = self.past(at)
            if self.w(after) == "{" or (self.w(after) == ":" and self.language == "js" and self.scopes[-1].mode == "class") or self.w(after) == "throws":
                brace = self.body(after)
                if brace is not None:
                    scope = self.symbol(i, self.pairs[brace], "method", self.w(i))
                    self.enter(brace, scope, "code")
                return at
        if self.language == "js" and self.scopes[-1].mode == "class" and self.w(i + 1) in ("=", ":", "?", "!"):
            at = i + 1
            while at < self.n and at - i < 200 and self.w(at) not in ("=", ";", "}", ","):
                at = self.past(at) if self.w(at) in ("(", "[", "{") else at + 1
            if self.w(at) == "=":
                return self.valued(i, i, at) if self.value(at + 1) else None
        return None

    def called(self, i: int) -> int:
        """Notes the call that begins at name ``i``, by its chain of names; the token to go on with."""
        chain, at = [self.w(i)], i + 1
        if self.w(i - 1) in (".", "?.", "::"):
            chain.insert(0, "()")  # a member of what a call gave
        while self.w(at) in (".", "?.", "::") and self.name(at + 1):
            chain.append(self.w(at + 1))
            at += 2
        after = at + (self.w(at) == "?.") if self.language == "js" else at
        if self.w(after) == "::" and self.w(after + 1) == "<":
            after = self.generics(after + 1)
        elif self.w(after) == "<":
            after = self.generics(after)
        elif self.language == "go" and self.w(after) == "[" and after in self.pairs and all(self.name(k) or self.w(k) in (".", ",", "*", "[", "]") for k in range(after, self.pairs[after])):
            after = self.past(after)
        elif self.language == "rs" and self.w(after) == "!" and self.w(after + 1) in ("(", "[", "{"):
            after += 1
        single = len(chain) == 1
        if self.w(after) not in ("(",) and not (self.language == "rs" and self.w(after - 1) == "!" and after > at):
            return at
        declared = self.language == "java" and single and (self.name(i - 1) and self.w(i - 1) not in self.keywords - {"void"} or self.w(i - 1) in (">", "]", "@"))
        if (single and (chain[0] in self.keywords or chain[0] in _SELVES or (chain[0] == "require" and self.language == "js"))) or declared or self.w(i - 1) == "@" or self.scopes[-1].mode in ("iface", "types"):
            return at
        self.note("call", i, ".".join(chain))
        if self.language == "java" and self.w(i - 1) == "new" and self.w(self.past(after)) == "{":
            self.enter(self.past(after) if self.past(after) in self.pairs else None, self.scopes[-1], "class")
        return at

    def imported(self, i: int) -> None:
        word, lang = self.w(i), self.language
        text = lambda k: self.t[k][1][1:-1] if k < self.n and self.t[k][0] == "text" and len(self.t[k][1]) > 1 else None

        def add(k: int, name: str) -> None:
            local = name.startswith(".") if lang == "js" else lang == "rs" and name.split("::")[0] in ("crate", "self", "super")
            if name:
                self.note("import", k, name, "relative" if local else "package")

        if lang == "js" and word != "use":
            at = i + 1 + (self.w(i + 1) == "(")
            if word == "require" and self.w(i + 1) != "(":
                return
            while word != "require" and at < self.n and self.t[at][0] != "text" and at - i < 2000:
                if self.w(at) in (";", "=", "(") or (at > i and self.w(at) in _STARTS | {"default"}) or (word == "export" and at == i + 1 and self.w(at) not in ("{", "*", "type")):
                    return
                at = self.past(at) if self.w(at) == "{" else at + 1
            if text(at) is not None and (self.w(at - 1) in ("from", "(") or at == i + 1):
                add(i, text(at))
        elif lang == "go" and word == "import":
            span = range(i + 2, self.pairs[i + 1]) if self.w(i + 1) == "(" and i + 1 in self.pairs else range(i + 1, min(i + 3, self.n))
            for k in span:
                if text(k) is not None:
                    add(k, text(k))
                    if self.w(i + 1) != "(":
                        break
        elif lang == "java" and word == "import":
            at = i + 1 + (self.w(i + 1) == "static")
            end = next((k for k in range(at, min(at + 100, self.n)) if self.w(k) == ";"), None)
            if end:
                add(i, "".join(self.w(k) for k in range(at, end)))
        elif lang == "rs" and word == "use":
            heads, path, k = [""], "", i + 1
            while k < self.n and self.w(k) != ";" and k - i < 2000:
                w = self.w(k)
                if w == "{":
                    heads.append(path)
                elif w in (",", "}"):
                    if path and path != heads[-1]:
                        add(i, path)
                    heads = heads[:-1] or [""] if w == "}" else heads
                    path = "" if w == "}" else heads[-1]
                elif w == "as":
                    k += 1
                else:
                    path += w
                k += 1
            if path:
                add(i, path)


def parse_braces(path: str, content: str) -> list[dict]:
    """Rows of symbols, imports, calls and type references, as SRC-2 gives them.

    A symbol's name is qualified by those around it, or by the receiver; a function in a
    function is a closure; a call belongs to the innermost symbol that holds it and is
    the chain of its names, with dots; ``()`` stands for what a call before gave.
    """
    return _Reader(content, _LANGUAGES.get(path.rsplit(".", 1)[-1], "js")).read()
