"""Regex dialect helpers, run once per rule on the driver.

Rules are written in the linear-time dialect (no look-around, no back-references).
The JVM matcher reads a few constructs differently, so every rule is rewritten once
to a form that gives the same matches; and the literals a match must contain are
derived here, to be used as the keyword screen of a scan.
"""

from __future__ import annotations

import re
from itertools import product

try:
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # Python < 3.11
    import sre_constants as sre
    import sre_parse

# Whitespace and word members of the linear-time dialect (ASCII only).
SPACE_MEMBERS = r"\t\n\f\r "
ASCII_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
ASCII_NOT_BOUNDARY = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": "0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}
MAX_REPEAT_COUNT = 1000

MAX_ALTERNATIVES = 32
MIN_SCREEN_LENGTH = 3


class UnsupportedRegex(ValueError):
    """The rule uses something the linear-time dialect does not have."""


_CLASS = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", re.S)
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")


def _class_to_java(body: str) -> str:
    """Rewrite the inside of one bracket expression."""
    negated = body.startswith("^")
    rest = body[1:] if negated else body
    if "\\s" in rest and "\\S" in rest:
        return "[" + body + "]"
    out = []
    i = 0
    while i < len(rest):
        posix = re.match(r"\[:(\^?)(\w+):\]", rest[i:])
        if posix:
            if posix.group(1) or posix.group(2) not in POSIX_CLASSES:
                raise UnsupportedRegex(f"character class {posix.group(0)}")
            out.append(POSIX_CLASSES[posix.group(2)])
            i += posix.end()
        elif rest[i] == "\\" and i + 1 < len(rest):
            pair = rest[i : i + 2]
            out.append(SPACE_MEMBERS if pair == "\\s" else f"[^{SPACE_MEMBERS}]" if pair == "\\S" else pair)
            i += 2
        elif rest[i] in "[&" or (rest[i] == "]" and i == 0):
            out.append("\\" + rest[i])
            i += 1
        else:
            out.append(rest[i])
            i += 1
    return "[" + ("^" if negated else "") + "".join(out) + "]"


_LONG_ESCAPE = re.compile(r"\\Q.*?(?:\\E|$)|\\x\{[0-9A-Fa-f]+\}|\\[pP]\{\^?\w+\}", re.S)
_WORD = re.compile(r"[0-9A-Za-z_]+")
_COUNT = re.compile(r"\{(\d+)(,(\d*))?\}|[*+?]")


def _word_opening(rest: str) -> tuple[str, int]:
    """A boundary and what follows it, with the boundary looked at after the first characters.

    The matcher tries every position of a text; looking behind first would cost it at each of them. Returns
    the text to emit and how much of ``rest`` it covers, or nothing when ``rest`` starts otherwise.
    """
    literal = _WORD.match(rest)
    if literal:
        end = literal.end()
        if _COUNT.match(rest, end):  # the last character is repeated and not part of the fixed text
            end -= 1
        if end:
            return f"{rest[:end]}(?<!\\w{rest[:end]})", end
        return "", 0
    found = _CLASS.match(rest)
    if not found:
        return "", 0
    atom = _class_to_java(found.group(0)[1:-1])
    count = _COUNT.match(rest, found.end())
    if count and (count.group(0) in "*?" or count.group(1) in ("0", "1")):
        return "", 0
    # Inside a word, outside of words, or a first character that is no word character: no boundary.
    check = r"(?<!\w\w)(?<!\W\W)(?<!\A\W)"
    if not count:
        return atom + check, found.end()
    if count.group(0) == "+":
        return f"{atom}{check}{atom}*", count.end()
    low, high = int(count.group(1)) - 1, count.group(3)
    if int(high or 0) > MAX_REPEAT_COUNT or low >= MAX_REPEAT_COUNT:
        raise UnsupportedRegex("repeat count above 1000")
    if rest[count.end() : count.end() + 1] == "+":
        raise UnsupportedRegex("possessive repeat")
    more = "" if count.group(2) is None else "," + (str(int(high) - 1) if high else "")
    return f"{atom}{check}{atom}{{{low}{more}}}", count.end()


def to_java(regex: str, loops: bool = False) -> str:
    """The same rule for ``java.util.regex``, with ASCII ``\\b`` and ``\\s`` and ``\\n``-only line ends.

    ``loops`` takes the possessive repeats that :func:`possessive_loops` makes; rules themselves have none.
    """
    out = ["(?d)"]
    multiline = False
    i = 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            pair = regex[i : i + 2]
            if len(pair) < 2:
                raise UnsupportedRegex("trailing backslash")
            if pair[1] in "123456789":
                raise UnsupportedRegex("back-reference")
            if pair[1] in "CZG":
                raise UnsupportedRegex(f"escape {pair}")
            whole = _LONG_ESCAPE.match(regex, i)
            if whole:
                out.append(whole.group(0))
                i = whole.end()
                continue
            if pair == "\\b":
                opening, length = _word_opening(regex[i + 2 :])
                if opening:
                    out.append(opening)
                    i += 2 + length
                    continue
            out.append(
                {
                    "\\b": ASCII_BOUNDARY,
                    "\\B": ASCII_NOT_BOUNDARY,
                    "\\s": f"[{SPACE_MEMBERS}]",
                    "\\S": f"[^{SPACE_MEMBERS}]",
                    "\\v": r"\x0B",
                }.get(pair, pair)
            )
            i += 2
        elif c == "[":
            found = _CLASS.match(regex, i)
            if not found:
                raise UnsupportedRegex("unclosed character class")
            out.append(_class_to_java(found.group(0)[1:-1]))
            i = found.end()
        elif c == "$":
            out.append("$" if multiline else r"\z")
            i += 1
        elif c == "(" and regex.startswith("(?P<", i):
            out.append("(?<")
            i += 4
        elif c == "(" and re.match(r"\(\?(?:[=!]|<[=!]|>)", regex[i:]):
            raise UnsupportedRegex("look-around")
        elif c == "(" and re.match(r"\(\?[a-zA-Z-]+[:)]", regex[i:]):
            flags = re.match(r"\(\?([a-zA-Z-]+)[:)]", regex[i:])
            if set(flags.group(1)) - set("ims-"):
                raise UnsupportedRegex(f"flag group {flags.group(0)}")
            multiline = multiline or "m" in flags.group(1).split("-")[0]
            out.append(flags.group(0))
            i += flags.end()
        elif c == "{":
            found = _REPEAT.match(regex, i)
            if found:
                if max(int(n) for n in found.groups() if n) > MAX_REPEAT_COUNT:
                    raise UnsupportedRegex("repeat count above 1000")
                out.append(found.group(0))
                i = found.end()
                if regex[i : i + 1] == "+" and not loops:
                    raise UnsupportedRegex("possessive repeat")
            else:
                out.append(r"\{")
                i += 1
        elif c in "*+?" and regex[i + 1 : i + 2] == "+" and not loops:
            raise UnsupportedRegex("possessive repeat")
        else:
            out.append(r"\}" if c == "}" else c)
            i += 1
    return "".join(out)


def _for_parser(regex: str) -> str:
    """The rule with the constructs that Python's own parser spells differently."""
    regex = re.sub(r"\\Q(.*?)(?:\\E|$)", lambda m: re.escape(m.group(1)), regex, flags=re.S)
    regex = re.sub(r"\\x\{([0-9A-Fa-f]{1,8})\}", lambda m: f"\\U{int(m.group(1), 16):08x}", regex)
    regex = re.sub(r"\[:(\w+):\]", lambda m: POSIX_CLASSES.get(m.group(1), m.group(0)), regex)
    return re.sub(r"\(\?<(?=\w)", "(?P<", regex).replace(r"\z", r"\Z")


def parse(regex: str):
    """(case-insensitive?, parse tree); raises ``re.error`` when it does not compile."""
    flags = 0
    lead = re.match(r"\(\?([ims]+)\)", regex)
    if lead:
        regex = regex[lead.end() :]
        for letter in lead.group(1):
            flags |= {"i": re.I, "m": re.M, "s": re.S}[letter]
    return bool(flags & re.I), sre_parse.parse(_for_parser(regex), flags)


def _is_repeat(op) -> bool:
    return op in (sre.MAX_REPEAT, sre.MIN_REPEAT)


_TOKEN = re.compile(
    r"(?P<skip>\\.|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\])"
    r"|(?P<open>\()(?:\?(?:P?<\w+>|[a-zA-Z-]*:))?|(?P<close>\))|(?P<either>\|)|(?P<count>(?:\{\d+(?:,\d*)?\}|[*+?])\+?)|.",
    re.S,
)


def overflows_stack(regex: str) -> bool:
    """True for an unbounded repeat over a group that has alternatives or repeats of varying length.

    The JVM matcher recurses once per round of such a repeat, so one long cell could
    end the executor; the loader rejects these rules and says so.
    """
    varying = [False]  # per open group
    closed = None  # what the group that ended just before this token was like
    for token in _TOKEN.finditer(regex):
        kind, text = token.lastgroup, token.group(0)
        after, closed = closed, None
        if kind == "open":
            varying.append(False)
        elif kind == "close" and len(varying) > 1:
            closed = varying.pop()
            varying[-1] = varying[-1] or closed
        elif kind == "either":
            varying[-1] = True
        elif kind == "count":
            # A possessive repeat is run in a loop.
            looped, text = len(text) > 1 and text.endswith("+"), text[0] if text[0] in "*+?" else text.rstrip("+")
            if after and not looped and (text in "*+" or text.endswith(",}")):
                return True
            low, _, high = text.strip("{}").partition(",")
            varying[-1] = varying[-1] or text in "*+?" or ("," in text and low != high)
    return False


# ---------------------------------------------------------------- repeats that need no way back

_INLINE_FLAGS = re.compile(r"\(\?([a-zA-Z-]+)\)")


def scoped_flags(regex: str) -> str:
    """The rule with flags that are set in its middle, ``a(?i)b``, as groups of their own, ``a(?i:b)``, up to the end of the group they stand in.

    They also hold for the alternatives that follow, so a group is closed before a bar and opened again behind it.
    """
    lead = re.match(r"\(\?[ims]+\)", regex)
    if not _INLINE_FLAGS.search(regex, lead.end() if lead else 0):
        return regex
    out, at = [lead.group(0)] if lead else [], lead.end() if lead else 0
    levels: list[list[str]] = [[]]
    while at < len(regex):
        flags = _INLINE_FLAGS.match(regex, at)
        if flags:
            levels[-1].append(f"(?{flags.group(1)}:")
            out.append(levels[-1][-1])
            at = flags.end()
            continue
        token = _LONG_ESCAPE.match(regex, at) or _TOKEN.match(regex, at)
        kind, text = token.lastgroup if token.re is _TOKEN else "skip", token.group(0)
        if kind == "open":
            levels.append([])
        elif kind == "close":
            out.append(")" * len(levels[-1]))
            if len(levels) > 1:
                levels.pop()
        elif kind == "either":
            text = ")" * len(levels[-1]) + "|" + "".join(levels[-1])
        out.append(text)
        at = token.end()
    return "".join(out) + ")" * sum(map(len, levels))


_EVERY = frozenset(range(129))  # ASCII, and one number for all beyond it
_CATEGORIES = {
    sre.CATEGORY_DIGIT: frozenset(b"0123456789"),
    sre.CATEGORY_SPACE: frozenset(b"\t\n\x0b\f\r "),
    sre.CATEGORY_WORD: frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"),
}
_NEGATED = {sre.CATEGORY_NOT_DIGIT: sre.CATEGORY_DIGIT, sre.CATEGORY_NOT_SPACE: sre.CATEGORY_SPACE, sre.CATEGORY_NOT_WORD: sre.CATEGORY_WORD}


def _class_members(av) -> frozenset:
    found, negated = set(), False
    for kind, value in av:
        if kind is sre.NEGATE:
            negated = True
        elif kind is sre.LITERAL:
            found.add(min(value, 128))
        elif kind is sre.RANGE:
            found.update(range(min(value[0], 128), min(value[1], 128) + 1))
        elif kind is sre.CATEGORY:
            found |= _CATEGORIES[value] if value in _CATEGORIES else _EVERY - _CATEGORIES[_NEGATED[value]]
    # A class that leaves out some characters beyond ASCII still has others.
    return _EVERY - (found - {128}) if negated else frozenset(found)


def _either_case(members: frozenset) -> frozenset:
    return members | {ord(c) for m in members if m < 128 for c in (chr(m).lower(), chr(m).upper())}


def _first(items) -> tuple[frozenset, bool]:
    """Characters that a sequence may begin with, and whether it may be empty. Case is never told apart, which is only wider."""
    out: frozenset = frozenset()
    for op, av in items:
        if op is sre.LITERAL:
            own, empty = frozenset([min(av, 128)]), False
        elif op is sre.NOT_LITERAL:
            own, empty = _EVERY, False
        elif op is sre.ANY:
            own, empty = _EVERY, False
        elif op is sre.IN:
            own, empty = _class_members(av), False
        elif op is sre.SUBPATTERN:
            own, empty = _first(av[3])
        elif op is sre.BRANCH:
            parts = [_first(b) for b in av[1]]
            own, empty = frozenset().union(*(p for p, _ in parts)), any(e for _, e in parts)
        elif _is_repeat(op):
            own, empty = _first(av[2])
            empty = empty or av[0] == 0
        else:  # a place between characters
            own, empty = frozenset(), True
        out |= _either_case(own)
        if not empty:
            return out, False
    return out, True


def _decided(items, after: frozenset) -> bool:
    """Whether the next character alone decides how a sequence goes on, at every place of it."""
    for k, (op, av) in enumerate(items):
        rest, empty = _first(items[k + 1 :])
        rest = rest | after if empty else rest
        if op is sre.SUBPATTERN:
            if not _decided(av[3], rest):
                return False
        elif op is sre.BRANCH:
            parts = [_first(b) for b in av[1]]
            if any(e for _, e in parts) or sum(len(p) for p, _ in parts) != len(frozenset().union(*(p for p, _ in parts))):
                return False
            if not all(_decided(b, rest) for b in av[1]):
                return False
        elif _is_repeat(op):
            own, empty = _first(av[2])
            if empty or (av[0] != av[1] and (op is sre.MIN_REPEAT or own & rest)) or not _decided(av[2], own | rest):
                return False
    return True


def possessive_loops(regex: str) -> str | None:
    """The rule with its repeated groups made possessive, where this can't change a match; None if some repeat may have to give back.

    It can't where the next character alone decides between another round and what follows, and between the ways through the group. The
    JVM matcher runs such a repeat in a loop and doesn't recurse. Only groups of the outermost level are looked at.
    """
    lead = re.match(r"(?:\(\?[ims]+\))?", regex).group(0)

    def first_of(text):
        return parse(lead + text)[1]

    out, depth, begun, ended = [], 0, 0, False
    for token in _TOKEN.finditer(regex, len(lead)):
        kind, text = token.lastgroup, token.group(0)
        if kind == "either" and depth == 0:
            return None
        if kind == "open" and depth == 0:
            begun = token.start()
        depth += (kind == "open") - (kind == "close")
        if kind == "count" and ended:
            try:
                body, rest = first_of(regex[begun : token.start()]), first_of(regex[token.end() :])
            except (re.error, OverflowError):  # a lazy repeat, for one
                return None
            own, empty = _first(body)
            if not empty and not own & _first(rest)[0] and _decided(body, own | _first(rest)[0]):
                text += "+"
        ended = kind == "close" and depth == 0
        out.append(text)
    safe = lead + "".join(out)
    return None if overflows_stack(safe) else safe


# ---------------------------------------------------------------- keyword (one literal)


def rule_keyword(regex: str) -> str:
    """Longest literal every match must contain; empty when there is none.

    Literals count through concatenation (the first one wins a tie), captures, ``+`` and
    ``{n,}`` with n > 0; alternatives and optional parts give none. A case-insensitive rule's keyword is in
    upper case.
    """
    try:
        ignore_case, tree = parse(regex)
    except (re.error, OverflowError):
        return ""
    found = max(_literal_runs(tree), key=lambda s: len(s.encode()), default="")
    return found.upper() if ignore_case else found


def _literal_runs(items):
    run = ""
    for op, av in items:
        if op is sre.LITERAL:
            run += chr(av)
            continue
        if op is sre.IN and len(av) == 1 and av[0][0] is sre.LITERAL:
            run += chr(av[0][1])
            continue
        if run:
            yield run
            run = ""
        if op is sre.SUBPATTERN:
            yield max(_literal_runs(av[3]), key=lambda s: len(s.encode()), default="")
        elif _is_repeat(op) and av[0] > 0:
            yield max(_literal_runs(av[2]), key=lambda s: len(s.encode()), default="")
    if run:
        yield run


# ---------------------------------------------------------------- screen (sets of literals)


def needed_literals(regex: str) -> list[list[str]]:
    """Sets of lower-case ASCII literals; every match contains at least one literal of every set.

    It looks through alternatives, so it also covers most rules that have no keyword.
    Empty when nothing is known.
    """
    try:
        _, tree = parse(regex)
    except (re.error, OverflowError):
        return []
    unique = {tuple(sorted(s)): None for s in _needed(tree)}
    return [list(s) for s in sorted(unique, key=lambda s: -min(map(len, s)))]


def _exact(op, av):
    """All strings an item can match, when they are few; otherwise None."""
    if op is sre.LITERAL:
        return {chr(av).lower()} if av < 128 else None
    if op is sre.IN:
        if len(av) <= 4 and all(o is sre.LITERAL and a < 128 for o, a in av):
            return {chr(a).lower() for _, a in av}
        return None
    if op is sre.SUBPATTERN:
        return _exact_sequence(av[3])
    if op is sre.BRANCH:
        parts = [_exact_sequence(b) for b in av[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.AT:
        return {""}
    if _is_repeat(op) and av[1] == 1:
        inner = _exact_sequence(av[2])
        return None if inner is None else inner | ({""} if av[0] == 0 else set())
    return None


def _exact_sequence(items):
    strings = {""}
    for op, av in items:
        more = _exact(op, av)
        if more is None or len(strings) * len(more) > MAX_ALTERNATIVES:
            return None
        strings = {a + b for a, b in product(strings, more)}
    return strings


def _needed(items):
    """Literal sets of a sequence, each long enough to be worth looking for."""
    found, run = [], {""}

    def close(strings):
        if min(map(len, strings)) >= MIN_SCREEN_LENGTH:
            found.append(strings)

    for op, av in items:
        more = _exact(op, av)
        if more is not None and len(run) * len(more) <= MAX_ALTERNATIVES:
            run = {a + b for a, b in product(run, more)}
            continue
        close(run)
        run = {""} if more is None else more
        if more is not None:
            continue
        if op is sre.SUBPATTERN:
            found += _needed(av[3])
        elif op is sre.BRANCH:
            parts = [max(_needed(b), key=lambda s: min(map(len, s)), default=None) for b in av[1]]
            if all(parts) and sum(map(len, parts)) <= MAX_ALTERNATIVES:
                found.append(set().union(*parts))
        elif _is_repeat(op) and av[0] > 0:
            found += _needed(av[2])
    close(run)
    return found


# A value format without any literal still needs one long run of these characters.
MIN_RUN_LENGTH = 12
RUN_CHARACTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")


def needed_run(regex: str) -> int:
    """Every match holds a run of at least this many word characters; 0 when that says little."""
    try:
        _, tree = parse(regex)
    except (re.error, OverflowError):
        return 0
    length = _longest_run(tree)
    return length if length >= MIN_RUN_LENGTH else 0


def _members(op, av):
    """Code points an item can match, or None when they are not plain ASCII."""
    if op is sre.LITERAL:
        return {av}
    if op is not sre.IN:
        return None
    found = set()
    for kind, value in av:
        if kind is sre.LITERAL:
            found.add(value)
        elif kind is sre.RANGE and value[1] < 128:
            found.update(range(value[0], value[1] + 1))
        elif kind is sre.CATEGORY and value is sre.CATEGORY_DIGIT:
            found.update(b"0123456789")
        else:
            return None
    return found


def _run_part(op, av):
    """(fewest characters, only run characters?) of one item."""
    members = _members(op, av)
    if members is not None:
        return 1, members <= RUN_CHARACTERS
    if op is sre.AT:
        return 0, True
    if op is sre.SUBPATTERN:
        return _run_whole(av[3])
    if op is sre.BRANCH:
        parts = [_run_whole(b) for b in av[1]]
        return min(n for n, _ in parts), all(ok for _, ok in parts)
    if _is_repeat(op):
        n, ok = _run_whole(av[2])
        return n * av[0], ok
    return 0, False


def _run_whole(items):
    parts = [_run_part(op, av) for op, av in items]
    return sum(n for n, _ in parts), all(ok for _, ok in parts)


def _longest_run(items) -> int:
    best = run = 0
    for op, av in items:
        n, ok = _run_part(op, av)
        run = run + n if ok else 0
        if not ok and op is sre.SUBPATTERN:
            best = max(best, _longest_run(av[3]))
        best = max(best, run)
    return best
