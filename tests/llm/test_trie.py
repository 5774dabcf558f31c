"""The conversation trie against a plain Python trie, on tables with nulls, ties and repeats."""

import hashlib
import re
import zlib

from corpusmith.llm import trie


def _brute(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t if t is not None else 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    rebuilt = {c: own.get(c - c % 20, [])[: zlib.crc32(str(c).encode()) % 4] + own[c][zlib.crc32(str(c).encode()) % 4:] for c in own}
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def words(u):
        return len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) if u else 0

    out = []
    for k, m in nodes.items():
        sub = [u for u in nodes if u[: len(k)] == k]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(rebuilt[c]) == len(k)))
        out.append((
            min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids.get(k, [])),
            sum(1 for u in sub if not kids.get(u)), sum((len(nodes[u]) - 1) * words(u) for u in sub),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def _key(row):
    return tuple((v is None, v) for v in row)


SCHEMA = "conv_id long, turn long, role string, text string, key string, d int, s1 string"


def test_trie_against_brute_force(spark):
    rows = []
    for c in range(0, 63):
        n = c % 6
        for t in range(n):
            text = f"hello world {t}" if c % 3 else f"say {c % 4} now {t}"
            rows.append((c, t, ("user", "assistant")[t % 2], text))
    rows += [
        (5, None, None, None), (5, 2, "user", "tie b"), (5, 2, "user", "tie a"), (7, 1, "user", "x  y\tz"),
        (7, 1, "user", "x  y\tz"), (None, 1, "user", "no id"), (100, 0, "user", ""), (101, 0, None, "long " * 5000),
        (-3, 0, "user", "negative"), (40, 0, "user", "say 0 now 0"),
    ]
    df = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA).repartition(4)
    got = sorted((tuple(r) for r in trie.trie(df).collect()), key=_key)
    assert got == sorted(_brute(rows), key=_key)


def test_trie_empty_and_turnless(spark):
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # Conversation 1 borrows from an absent base and keeps no turn of its own: it is turnless.
    h = zlib.crc32(b"1") % 4
    rows = [(1, t, "user", f"t{t}") for t in range(h)] + [(2, 0, "user", "a")]
    df = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], SCHEMA)
    assert sorted(map(tuple, trie.trie(df).collect()), key=_key) == sorted(_brute(rows), key=_key)
