"""Find function definitions in one C or C++ text. A small pure helper used inside Spark tasks.

Supported: definitions at file, namespace, class, ``extern "C"`` and block level; comments, strings, raw strings and
preprocessor lines are ignored. Captured names are a plain identifier directly under the function declarator and, for
C++, the identifier of a one-level qualified name and names behind a reference declarator. Pointer-returning,
operator, conversion, destructor, template-name and multi-level qualified declarators are not captured, nor are
definitions with old-style parameter declarations. Text between functions is skipped.
"""

from __future__ import annotations

import re

# Everything that can hide braces. It starts with one character class, so the engine skips plain code quickly, and the
# look-behinds pick the case. A hash outside of literals always starts a preprocessor line. Numbers are here for their
# digit separators.
_HIDING = re.compile(
    r"""[/"'\#0-9](?:
        (?<=/)(?:/[^\\\n]*(?:\\.[^\\\n]*)* | \*.*?(?:\*/|\Z))
      | (?:(?<=\bR")|(?<=\b[uUL]R")|(?<=\bu8R"))(?P<delim>[^()\\\s]{0,16})\(.*?(?:\)(?P=delim)"|\Z)
      | (?<=")(?P<str>[^"\\\n]*(?:\\.[^"\\\n]*)*)(?:"|(?=\n)|\Z)
      | (?<=')[^'\\\n]*(?:\\.[^'\\\n]*)*(?:'|(?=\n)|\Z)
      | (?<=\#)(?:[^\n\\/]+|\\.|/\*.*?(?:\*/|\Z)|/)*
      | (?<=[0-9])(?<!\w[0-9])(?P<num>(?:'?[\w.])*))""",
    re.S | re.X,
)
_TOKEN = re.compile(r"[(){};]")
_VISIBLE = re.compile(r"\S")
_CODE = re.compile(r"[^\n]")
_PAIRS = {"(": re.compile(r"[()]"), "<": re.compile(r"[<>]"), "{": re.compile(r"[{}]")}
_CATCH = re.compile(r"\s*catch\s*\(")
_TRY = re.compile(r"\)[^(){}]*\btry\b")
_COLON = re.compile(r"(?<!:):(?!:)")
_NAME_END = re.compile(r"[\w>]\s*\Z")

# Words that precede "(" without naming a function.
_NOT_NAMES = frozenset(
    """if for while switch return catch sizeof do else case default goto new delete throw alignof alignas decltype typeof
    __typeof__ __attribute__ __declspec _Alignas noexcept explicit requires static_assert _Static_assert co_await
    co_return co_yield asm __asm__ defined typedef operator void char short int long float double signed unsigned bool
    _Bool const volatile auto static inline extern struct union enum class""".split()
)
_LEAD = re.compile(
    r"""\s*(?:(?:public|private|protected)\s*:(?!:)   # access labels
      | extern\s*"\s*"                                # linkage of one declaration
      | [A-Za-z_]\w*\s*:(?!:) )""",                   # labels inside a body
    re.X,
)
_TEMPLATE = re.compile(r"\s*template\s*<")
_SCOPE = re.compile(r"\s*(?:typedef\s+|inline\s+)?(namespace|class|struct|union|enum|extern)\b")
_NAME = re.compile(r"(?P<scope>(?:::\s*)?(?:[A-Za-z_]\w*\s*(?:<[^()]*>)?\s*::\s*)*)(?P<name>[A-Za-z_]\w*)\s*\Z")
_WRAPPER = re.compile(r"(?:__attribute__|__declspec|alignas|_Alignas|decltype|typeof|__typeof__|explicit)\s*\Z")
_AFTER_C = re.compile(r"\s*(?:__attribute__\b.*|__asm__\b.*)?\Z", re.S)
_AFTER_CPP = re.compile(
    r"\s*(?:(?:const|volatile|noexcept|override|final|throw|try|requires|__attribute__|[A-Z_][A-Z0-9_]*)\b.*"
    r"|&{1,2}.*|->.*|:(?!:).*|\[\[.*)?\Z",
    re.S,
)
_NO_BODY = re.compile(r"=\s*(?:default|delete)\s*\Z")


def _hide(match: re.Match) -> str:
    kind = match.lastgroup
    text = match.group()
    if kind == "num":
        return text
    if kind == "str" and len(text) > 1:
        # Quotes stay, so that linkage strings remain visible.
        return '"' + _blank(text[1:-1]) + ('"' if text[-1] == '"' else " ")
    return _blank(text)


def _blank(text: str) -> str:
    return _CODE.sub(" ", text) if "\n" in text else " " * len(text)


def _closing(text: str, at: int, opening: str, closing: str) -> int:
    depth = 0
    for m in _PAIRS[opening].finditer(text, at):
        depth += 1 if m.group() == opening else -1
        if depth == 0:
            return m.start()
    return -1


def _skip_lead(head: str) -> int:
    at = 0
    while True:
        m = _TEMPLATE.match(head, at)
        if m:
            end = _closing(head, m.end() - 1, "<", ">")
            if end < 0:
                return at
            at = end + 1
            continue
        m = _LEAD.match(head, at)
        if not m:
            break
        at = m.end()
    m = _VISIBLE.search(head, at)
    return m.start() if m else len(head)


def _declarator(head: str, cpp: bool, in_body: bool) -> tuple[str, int] | None:
    """Name of the function a head declares and where its text starts, or None."""
    start = _skip_lead(head)
    paren = head.find("(", start)
    while paren >= 0 and _WRAPPER.search(head, start, paren):
        end = _closing(head, paren, "(", ")")
        if end < 0:
            return None
        paren = head.find("(", end)
    if paren < 0 or "=" in head[start:paren]:
        return None
    m = _NAME.search(head, start, paren)
    if not m or m.group("name") in _NOT_NAMES:
        return None
    before = head[start:m.start()].rstrip()
    levels = m.group("scope").count("::") - (1 if m.group("scope").startswith("::") else 0)
    if before.endswith(("*", "~", "operator")) or re.search(r"\boperator\b", before) or levels > 1:
        return None
    if not cpp and (m.group("scope") or not before or before.endswith("&")):
        return None
    if not before and in_body:
        return None  # a macro call followed by a block
    if before.split()[-1:] and before.split()[-1] in ("return", "else", "new", "goto", "case", "throw"):
        return None
    end = _closing(head, paren, "(", ")")
    if end < 0 or not (_AFTER_CPP if cpp else _AFTER_C).match(head, end + 1):
        return None
    return m.group("name"), start


def scan_functions(text: str, cpp: bool) -> tuple[list[tuple[str, str]], str | None]:
    """(name, text) of every function definition by start, and the reason the text is not well formed, if any."""
    clean = _HIDING.sub(_hide, text)
    found: list[tuple[int, int, str]] = []
    stack: list[tuple[str, int, int, int, str]] = []  # kind, parens outside, statement to resume, start, name
    problem = None
    statement, parens = 0, 0
    bodies: list[int] = []  # where the bodies of the open functions begin
    for m in _TOKEN.finditer(clean):
        token, at = m.group(), m.start()
        if token == "(":
            parens += 1
        elif token == ")":
            parens = max(0, parens - 1)
        elif token == ";":
            if parens == 0:
                if cpp and _NO_BODY.search(clean, statement, at):
                    head = _NO_BODY.sub("", clean[statement:at])
                    declared = _declarator(head, cpp, False)
                    if declared:
                        found.append((statement + declared[1], at + 1, declared[0]))
                statement = at + 1
        elif token == "{" and stack and stack[-1][0] == "values":
            # Inside an initializer's list every brace opens another list: no head is cut out of the text before it.
            stack.append(("values", parens, -2, -1, ""))
            parens = 0
        elif token == "{" and parens:
            # Inside an argument list: nothing is declared, and the text before is looked at once the list has ended.
            stack.append(("function" if stack and stack[-1][0] == "function" else "block", parens, statement, -1, ""))
            statement, parens = at + 1, 0
        elif token == "{":
            head = clean[statement:at]
            in_body = any(frame[0] == "function" for frame in stack[-1:])
            declared = _declarator(head, cpp, in_body)
            if declared and cpp and _opens_initializer(head):
                declared, resume = None, statement
            elif head.rstrip().endswith(("=", "return")):
                resume = statement
            else:
                resume = -1
            if declared:
                stack.append(("function", parens, -1, statement + declared[1], declared[0]))
                if cpp:
                    bodies.append(at)
            else:
                kind = "scope" if _SCOPE.match(head, _skip_lead(head)) else "block"
                if kind == "block" and head.rstrip().endswith("="):
                    kind = "values"
                elif kind == "block" and in_body:
                    kind = "function"  # still inside a body
                stack.append((kind, parens, resume, -1, ""))
            statement, parens = at + 1, 0
        elif not stack:
            problem = "unbalanced_braces"
            statement, parens = at + 1, 0
        else:
            _, parens, resume, start, name = stack.pop()
            if start >= 0:
                tried = cpp and _TRY.search(clean, start, bodies.pop())
                found.append((start, _handlers_end(clean, at + 1) if tried else at + 1, name))
            if resume != -2:
                statement = resume if resume >= 0 else at + 1
    if stack:
        problem = "unbalanced_braces"
    found.sort()
    return [(name, text[start:end]) for start, end, name in found], problem


def _handlers_end(text: str, at: int) -> int:
    """End of the ``catch`` handlers that follow a function whose body is a try block, or ``at``."""
    while m := _CATCH.match(text, at):
        closed = _closing(text, m.end() - 1, "(", ")")
        opened = _VISIBLE.search(text, closed + 1) if closed >= 0 else None
        if not opened or opened.group() != "{":
            break
        end = _closing(text, opened.start(), "{", "}")
        if end < 0:
            break
        at = end + 1
    return at


def _opens_initializer(head: str) -> bool:
    """Whether a brace after ``head`` initialises a member in a constructor's list rather than opening the body."""
    paren = _closing(head, head.find("("), "(", ")")
    colon = _COLON.search(head, paren)
    return bool(colon) and bool(_NAME_END.search(head, colon.end()))
