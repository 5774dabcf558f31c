"""Programming-language labels of texts from weighted patterns.

A language scores the sum of the weights of its patterns that occur in the text.
The best score wins, ties go to the first name in alphabetical order, and a text
without any hit is 'unknown'.  All of it is one expression per row: no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"

Rule = tuple[str, tuple[str, ...], str, int]

# (language, literals, pattern, weight).  Every match holds one of the literals: texts
# without any are told apart by a plain byte search.  ASCII classes only, no look-around,
# and no pattern whose search can run over a long text more than once: runs of any length are
# possessive (they give nothing back) and end before the next place a match can start.
RULES: tuple[Rule, ...] = (
    ("bash", ("#!",), r"^#![ \t]*/[^\n ]*(/|env )(ba|z|k)?sh\b", 8),
    ("bash", ("fi", "done", "esac"), r"\n[ \t]*(fi|done|esac)[ \t]*\n", 3),
    ("c", ("#include",), r"#include <[a-z_/]+\.h>", 4),
    ("c", ("malloc", "printf", "sizeof"), r"\b(malloc|printf|sizeof) ?\(", 2),
    ("c++", ("#include",), r"#include <[a-z_]+>", 4),
    ("c++", ("std::", "template"), r"\bstd::\w|\btemplate ?<", 4),
    ("css", ("{",), r"\{\s*+[a-z-]++: ?[^;{}\n]++;", 3),
    ("go", ("package ",), r"(^|\n)package [a-z]\w*\n", 4),
    ("go", ("\nfunc ",), r"\nfunc [\w(]", 4),
    ("html", ("<!",), r"<!(doctype|DOCTYPE) html", 8),
    ("html", ("<",), r"</?(html|head|body|div|span|table)[ >]", 3),
    ("java", ("public ",), r"\bpublic (static |final |abstract )*(class|interface|void|enum)\b", 4),
    ("java", ("import ",), r"(^|\n)import (static )?[a-z]+\.[\w.]+;", 4),
    ("javascript", ("function",), r"\bfunction ?\w* ?\([\w, ]*\) ?\{", 3),
    ("javascript", ("const ", "let ", "=> {", "console.log("),
     r"\b(const|let) \w+ =|=> \{|\bconsole\.log\(", 3),
    ("json", ("{", "["), r"^\s*[{\[]\s*\"\w+\" ?[:,]", 4),
    ("python", ("def ",), r"(^|\n)[ \t]*def \w+ ?\(", 4),
    ("python", ("import ",), r"(^|\n)(import \w+\n|from [\w.]+ import )", 3),
    ("python", ("class ", "elif ", "except"),
     r"\n[ \t]*(class \w++[^:;{}\n]*+:|elif |except\b)", 3),
    ("python", ("__name__",), r"\nif __name__ ==", 6),
    ("rust", ("fn ",), r"\bfn \w+ ?[<(]", 4),
    ("rust", ("let mut ", "impl ", "println!"), r"\blet mut |\bimpl \w+ for |\bprintln!\(", 3),
    ("sql", ("select ", "SELECT "),
     r"\b(select|SELECT) [\w.*]++(, ?[\w.*]++)*+\s(from|FROM) \w", 4),
    ("sql", ("create ", "CREATE "), r"\b(create|CREATE) (table|view|TABLE|VIEW) ", 4),
    ("xml", ("<?xml ",), r"^\s*<\?xml ", 8),
)


def language_label(
    text: Column | str, rules: Sequence[Rule] = RULES
) -> Column:
    """The lower-case name of the best scoring language."""
    text = F.col(text) if isinstance(text, str) else text
    names = sorted({rule[0].lower() for rule in rules}, reverse=True)
    scored = []
    for place, name in enumerate(names):
        hits = [
            F.when(_holds(text, literals) & text.rlike(pattern), weight).otherwise(0)
            for lang, literals, pattern, weight in rules
            if lang.lower() == name
        ]
        total = hits[0]
        for hit in hits[1:]:
            total = total + hit
        # Names are numbered backwards: the larger place is the earlier name.
        scored.append(F.struct(total.alias("score"), F.lit(place).alias("place"),
                               F.lit(name).alias("name")))
    # Ahead of all names without a hit, behind every name with one.
    scored.append(F.struct(F.lit(0).alias("score"), F.lit(len(names)).alias("place"),
                           F.lit(UNKNOWN).alias("name")))
    return F.array_max(F.array(*scored))["name"]


def _holds(text: Column, literals: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(s)) for s in literals])
