"""Column functions on file paths and a translation of glob patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The last dot and what follows it, if something stands before the dot and after it.
SUFFIX_REGEX = r"^.+(\.[^.]+)$"
HIDDEN_REGEX = r"(^|/)\."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def suffix(name: Column | str) -> Column:
    """'.py' of 'a.py'; '' for no dot, a leading dot or a trailing dot."""
    return F.regexp_extract(_col(name), SUFFIX_REGEX, 1)


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def parent(path: Column | str) -> Column:
    """The directory of a relative path; '' for the root."""
    return F.regexp_replace(_col(path), r"/?[^/]*$", "")


def relative(path: Column | str, root: str, separator: str = "/") -> Column:
    """The path below root, always with '/'."""
    start = len(root.rstrip(separator)) + 2
    rel = F.substring(_col(path), start, 1 << 30)
    return rel if separator == "/" else F.replace(rel, F.lit(separator), F.lit("/"))


def is_hidden(rel_path: Column | str) -> Column:
    """A component below the root starts with a dot ('_' names are not hidden)."""
    return _col(rel_path).rlike(HIDDEN_REGEX)


def in_folder(directory: Column | str, folder: str) -> Column:
    """A component of the directory has this name."""
    return F.array_contains(F.split(_col(directory), "/"), folder)


def glob_regex(pattern: str, any_char: str = ".") -> str:
    """One shell pattern as a regular expression without anchors.

    any_char is what '*' and '?' stand for: '.' lets them cross '/', '[^/]' does not.
    """
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            if not out or out[-1] != any_char + "*":
                out.append(any_char + "*")
        elif c == "?":
            out.append(any_char)
        elif c == "[":
            # A ']' right after '[' or '[!' belongs to the set.
            first = i + 1 if pattern[i : i + 1] == "!" else i
            close = pattern.find("]", first + 1)
            if close < 0:
                out.append(r"\[")
            else:
                out.append(_set_regex(pattern[i:close]))
                i = close + 1
        else:
            out.append(_quote(c))
    return "".join(out)


def _quote(c: str) -> str:
    return "\\" + c if re.match(r"[^\w\s/]", c, re.ASCII) and ord(c) < 128 else c


def _set_regex(body: str) -> str:
    negated = body.startswith("!")
    body = body[1:] if negated else body
    items, i = [], 0
    while i < len(body):
        if i + 2 < len(body) and body[i + 1] == "-":
            low, high = body[i], body[i + 2]
            if low <= high:
                items.append(f"{_quote(low)}-{_quote(high)}")
            i += 3
        else:
            items.append(_quote(body[i]))
            i += 1
    if not items:
        # Only empty ranges: nothing can match, or with '!' anything.
        return r"[\s\S]" if negated else r"[^\s\S]"
    return f"[{'^' if negated else ''}{''.join(items)}]"
