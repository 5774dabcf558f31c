"""Each operator on a small table with nulls, empty and repeated rows, against brute force."""

import hashlib
import random
import zlib
from collections import Counter
from math import log2, log10

import pytest
from pyspark.sql import functions as F

from corpusmith.llm import chat, decontam, jaccard, lines, lm, mix, phrases, quality, shards, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 long, token string"


def _words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base, passage = _words(rng, 120), _words(rng, 40)
    out = [None, "", "  \n ", "one", "Two words", "a b c d", "A B\tc d", "x " * 200, "Été über ñandú 日本"]
    out += [base] * 4 + [base + " end", base.replace("alpha", "ALPHA"), "start " + base]
    for i in range(12):
        w = base.split()
        for _ in range(2 * (i % 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    out += [f"{_words(rng, 30)} {passage} {_words(rng, 10 * i)}" for i in range(6)]
    out += [_words(rng, rng.randrange(1, 90)) for _ in range(40)]
    out.append("\n".join([_words(rng, 12)] * 9 + [_words(rng, 5)]))
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Ids with a null and a repeated one; columns whose names the operators use themselves."""
    rows = [(i, t, ("en", "fr", None)[i % 3], (None, "s1", "s2", "hot", "hot")[i % 5], 1, 2, "t") for i, t in enumerate(texts)]
    rows += [(None, "null id " + texts[9], "en", "s1", 1, 2, "t"), rows[9], rows[9], (3, "same id, other text", "xx", "s2", 1, 2, "t")]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _split(text):
    return (text or "").encode().split()


def _key(row):
    return tuple((v is not None, v) for v in row)


def _sorted(rows):
    return sorted(map(tuple, rows), key=_key)


def test_phrases(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    for window in (35, 5):
        seen = Counter(tuple(w[i:i + window]) for r in rows for w in [_split(r.text)] for i in range(len(w) - window + 1))
        want = []
        for r in rows:
            w = _split(r.text)
            stay = [True] * len(w)
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i:i + window])] > 1:
                    stay[i:i + window] = [False] * window
            kept = b" ".join(x for x, s in zip(w, stay) if s)
            want.append((r.doc_id, len(w), len(w) - sum(stay), hashlib.sha256(kept).hexdigest()))
        assert _sorted(phrases.with_digest(docs, window=window).collect()) == _sorted(want)
    # Small shards and every anchor hot give the same.
    a = phrases.kept_texts(docs, window=5, hot=1, shard_words=10).collect()
    assert _sorted(a) == _sorted(phrases.kept_texts(docs, window=5).collect())
    assert phrases.with_digest(empty).count() == 0


def test_phrases_long_windows(spark):
    """Run lengths and counts above a byte: two texts sharing 700 words lose them at any window."""
    rng = random.Random(11)
    shared = _words(rng, 700)
    rows = [(1, f"{_words(rng, 50)} {shared} {_words(rng, 20)}"), (2, f"{_words(rng, 10)} {shared}"), (3, _words(rng, 400))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (35, 140, 200, 300):
        got = {r.doc_id: r.n_removed for r in phrases.with_digest(df, window=window).collect()}
        assert got == {1: 700, 2: 700, 3: 0}, window


def test_jaccard(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = [x.lower() for x in _split(r.text)]
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    names = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            names[find(i)] = min(names.get(find(i), r.doc_id), r.doc_id)
    want = [(r.doc_id, len(sets[i]), names.get(find(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows)]
    assert _sorted(jaccard.similar_documents(docs).collect()) == _sorted(want)
    assert jaccard.similar_documents(empty).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    _check_one_of_each(rows, sets, kept.select("doc_id", "text").collect())


def _check_one_of_each(rows, sets, kept):
    """Brute force: one row stays of each group of rows, the one of the smallest id (null last)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append((r.doc_id is None, r.doc_id if r.doc_id is not None else 0, r.text))
    best = [min(g)[:2] for g in groups.values()]
    assert len(kept) == len(groups)
    got = Counter((r.doc_id is None, r.doc_id if r.doc_id is not None else 0) for r in kept)
    assert got == Counter(best)
    # Every kept row is one of the input, and each group lends exactly one.
    assert all((r.doc_id, r.text) in {(x.doc_id, x.text) for x in rows} for r in kept)


def test_one_of_each_rows_not_ids(spark):
    """Ids repeated with unlike texts, null ids, clashing private names: no text is lost."""
    rng = random.Random(9)
    a, b, c = _words(rng, 60), _words(rng, 60), _words(rng, 60)
    data = [(1, a), (2, a), (2, b), (3, c), (3, b + " x"), (None, c), (None, _words(rng, 40)), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame(
        [(i, t, 5, "clash", 1.0, 2) for i, t in data], "doc_id long, text string, __row int, r string, c double, k int"
    ).repartition(3)
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.text) for r in kept.collect())
    want = sorted(((i is None, i or 0), t) for i, t in [(1, a), (2, b), (3, c), (None, data[6][1]), (7, None), (8, ""), (8, "")])
    assert got == want
    assert all(r["__row"] == 5 and r.r == "clash" for r in kept.collect())
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_language_model(docs, empty):
    rows = docs.select("doc_id", "text").collect()

    def fold(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10

    tokens = [[w.lower() for w in _split(r.text)] + [None] for r in rows]
    count = Counter(t for r, ts in zip(rows, tokens) if fold(r.doc_id) for t in ts)
    n, v = sum(count.values()), len(count)
    want = _sorted((
        r.doc_id, fold(r.doc_id) == 0, len(ts), sum(count[t] > 0 for t in ts), n,
        round(sum(log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), 6),
    ) for r, ts in zip(rows, tokens))
    # A high share leaves most words to the lookup, a low one to the broadcast: equal results.
    few, many = (lm.score_documents(docs, frequent=f).collect() for f in (0.02, 1e-6))
    for got in (few, many):
        assert _sorted((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in many)
    held = [r for r in many if r.held_out and r.n_known < r.n_tokens]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm.score_documents(empty).count() == 0


def test_language_model_against_counts(docs):
    """Scores are those of all counted pairs and the learned weights, whatever the size of blocks."""
    rows = docs.select("doc_id", "text").collect()
    fold = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 10 for r in rows]
    tokens = [[w.lower() for w in _split(r.text)] + [None] for r in rows]

    def counts(folds):
        word, pair = Counter(), Counter()
        for f, ts in zip(fold, tokens):
            if f in folds:
                word.update(ts)
                pair.update(zip([None] + ts[:-1], ts))
        return word, pair

    def bucket(c):
        return c.bit_length()

    def level(p):
        return min(round(-log2(p) * lm.STEPS_PER_BIT), lm.LEVELS - 1) if p else lm.LEVELS

    word, pair = counts(range(1, 10))
    left, left_pair = counts(range(2, 10))
    n, v, n_left = sum(word.values()), len(word), sum(left.values())
    cells = Counter()
    for f, ts in zip(fold, tokens):
        for h, w in zip([None] + ts[:-1], ts) if f == 1 else ():
            two = level(left_pair[h, w] / left[h] if left[h] else 0)
            cells[(bucket(left[h]) * (lm.LEVELS + 1) + two) * (lm.LEVELS + 1) + level(left[w] / n_left)] += 1
    a = lm.usable_weights(lm.learn_weights(sorted(cells.items()), v), n)
    assert abs(a.sum(axis=1) - 1).max() < 1e-9 and a[0, 0] == 0

    def score(ts):
        out = 0.0
        for h, w in zip([None] + ts[:-1], ts):
            w2, w1, w0 = a[bucket(word[h])]
            out += log10(w2 * pair[h, w] / max(word[h], 1) + w1 * word[w] / n + w0 / (v + 1))
        return out

    want = _sorted((r.doc_id, len(ts), round(score(ts), 6)) for r, ts in zip(rows, tokens))
    assert any(x == 1 for x in pair.values())
    for size in (lm.BLOCK_TOKENS, 50):
        got = lm.score_documents(docs, block_tokens=size).collect()
        assert _sorted((r.doc_id, r.n_tokens, round(r.score, 6)) for r in got) == want


def test_language_model_without_training(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    got = lm.score_documents(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) and all(r.score == 0 and r.base_score == 0 and r.train_tokens == 0 for r in got)


def test_repeated_ids_are_scored_each(spark):
    """Rows with one id are scored one by one, and no probability is above one."""
    known = ["aa", "bb", "cc", "dd"]
    rows = [(i, " ".join(known[(i + j) % 4] for j in range(i % 7))) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    asked = [(held, "aa"), (held, "")] + [(held, f"aa {w}") for w in known + ["unknown"]]
    out = lm.score_documents(train.unionByName(spark.createDataFrame(asked, "doc_id long, text string"))).filter(F.col("doc_id") == held)
    assert out.count() == len(asked) and out.filter("score > 0").count() == 0


def test_mix(docs, empty):
    got = mix.mix_sources(docs).collect()
    size = Counter()
    for r in got:
        size[r.source] += r["size"]
    assert Counter(r["size"] for r in got) == Counter(len(_split(r.text)) for r in docs.collect())
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        for s in over or open_:
            target[s] = 3.0 * size[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source]
        assert r.taken in [k * r["size"] for k in range(4)]
    for s in names:
        near = max(Counter((r.h) for r in got if r.source == s).values()) * max(r["size"] for r in got if r.source == s)
        assert abs(sum(r.taken for r in got if r.source == s) - target[s]) <= near
    assert _sorted(mix.mix_sources(docs).collect()) == _sorted(got)
    assert mix.mix_sources(empty).count() == 0 and mix.repeat_rows(empty).count() == 0
    repeated = mix.repeat_rows(docs)
    assert repeated.columns == docs.columns
    assert repeated.count() == sum(r.copies for r in got)


def test_cuts():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 12))]
        k = rng.randrange(1, 6)
        cuts = shards.minimax_cuts(sizes, k)
        best = {0: 0}
        for _ in range(k):  # cost of the best partition of each prefix
            best = {e: min([max(c, sum(sizes[s:e])) for s, c in best.items() if s <= e]) for e in range(len(sizes) + 1)}
        edges = [0, *cuts]
        assert len(cuts) <= k and cuts[-1] == len(sizes)
        assert max(sum(sizes[a:b]) for a, b in zip(edges, edges[1:])) == best[len(sizes)]


def test_shards(docs, empty):
    for part_rows in (shards.PART_ROWS, 2):
        got = shards.assign_shards(docs, shards=7, keep=["doc_id", "text", "token"], part_rows=part_rows).collect()
        assert len(got) == docs.count()
        places, of = {}, {}
        for r in got:
            raw = None if r.text is None else r.text.encode()
            assert r["size"] == len(raw or b"") + 16
            assert r.text_crc32 == (None if raw is None else zlib.crc32(raw))
            places.setdefault(r.shard, []).append(r.slot)
            assert of.setdefault(r.text or "", r.shard) == r.shard
        for slots in places.values():
            assert sorted(slots) == list(range(len(slots)))
    assert shards.assign_shards(empty).count() == 0


def test_decontamination(docs, empty, spark, texts):
    passage = texts[9].split()
    items = [(1, " ".join(passage[20:45]).upper()), (2, "TWO, words!"), (10, None), (11, ""), (None, texts[30]), (1, "one"), (12, "été über ñandú")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")

    windows = {}
    for i, t in items:
        w = [x for x in words(t) if x]
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j:j + 10]), set()).add("" if i is None else str(i))
    got = {}
    for r in decontam.find_overlap(docs, bench).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, tuple(r.item_ids)))
        assert (r.n_hit > 0) == bool(r.hit_spans)
    want = {}
    for r in docs.collect():
        w = [x for x in words(r.text) if x]
        hit, who = [False] * len(w), set()
        for pattern, ids in windows.items():
            n = len(pattern)
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) == pattern:
                    hit[j:j + n] = [True] * n
                    who |= ids
        want.setdefault(r.doc_id, []).append((len(w), sum(hit), tuple(sorted(who))))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    clean = decontam.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(h == 0 for v in want.values() for _, h, _ in v)
    nothing = bench.limit(0)
    assert decontam.find_overlap(docs, nothing).filter("n_hit > 0").count() == 0
    assert decontam.find_overlap(empty, bench).count() == 0
    with pytest.raises(ValueError):
        decontam.find_overlap(docs, bench, max_words=3)


def test_decontamination_in_blocks(docs, spark, texts):
    """A benchmark cut into blocks gives the rows of one in a single block; none is refused by its size."""
    passage = texts[9].split()
    items = [(i, " ".join(passage[5 * i:5 * i + 18 + i])) for i in range(12)]
    items += [(3, " ".join(passage)), (20, "TWO, words!"), (21, None), (22, ""), (None, texts[30]), (23, texts[-1]), (24, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(2)

    def rows(n):
        got = decontam.find_overlap(docs, bench, block_words=n).collect()
        return _sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), tuple(map(tuple, r.hit_spans))) for r in got)

    whole, clean = rows(10_000), _sorted(decontam.drop_contaminated(docs, bench).collect())
    assert any(len(r[3]) > 2 for r in whole) and 0 < len(clean) < docs.count()
    n = 115
    blocks = list(decontam._blocks(bench, "item_id", "text", 10, n))
    assert len(blocks) > 2 and all(sum(len(decontam.normal_words(t)) for _, t in b) <= n for b in blocks)
    assert rows(n) == whole
    assert _sorted(decontam.drop_contaminated(docs, bench, block_words=n).collect()) == clean


def test_quality(docs, empty):
    got = quality.quality(docs)
    want = []
    for r in docs.collect():
        w = _split(r.text)
        seen = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = [False] * len(w)
        for i in range(len(w) - 7):
            if seen[tuple(w[i:i + 8])] > 1:
                again[i:i + 8] = [True] * 8
        text = r.text or ""
        full = [s for s in text.split("\n") if s.encode().split()]
        failed = len(w) < 20 or 100 * sum(again) > 30 * len(w)
        want.append((r.doc_id, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), sum(again), failed))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert _sorted(got.select(names).collect()) == _sorted(want)
    assert got.filter("base_failed and kept").count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == got.filter("kept").count()
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_js_distance(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 3.0]), ([2.0, 2.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "p array<double>, q array<double>")
    assert [r[0] for r in df.select(quality.js_distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0, None]


def test_urls(spark):
    rows = [(None, None), (1, ""), (2, "no scheme"), (3, "http://"), (4, "HTTP://A.Example.ORG"), (5, "x://example.org/es/1?q#f"),
            (6, "http://sub.example.org/en/1"), (7, "http://badexample.org/es/"), (8, "http://org/"), (9, "ftp://a://b/c")]
    rows += [(100 + i, f"https://{h}.{d}/{p}/{i}.html") for i in range(400) for h, d, p in [("abc"[i % 3] * 3, ("site.com", "site.net", "site.org")[i % 3], ("fr", "de")[i // 3 % 2])]]
    rows += rows[20:23]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert urls.judge_urls(pages).count() == len(rows)
    assert (got[None].host, got[None].path, got[None].rule) == ("", "", None)
    assert (got[4].host, got[4].path, got[4].rule) == ("a.example.org", "", None)
    assert (got[5].path, got[5].rule, got[5].verdict) == ("/es/1", "example.org/es/", "block")
    assert (got[6].rule, got[6].verdict) == ("example.org/en/1", "block")
    assert (got[7].rule, got[7].verdict, got[8].rule) == ("org/", "allow", "org/")
    assert (got[9].host, got[9].path) == ("a:", "//b/c")
    free = [r for r in got.values() if r.page_id and r.page_id >= 100 and r.rule is None]
    right = sum(r.verdict == ("allow" if "/fr/" in r.path else "block") for r in free)
    assert free and right > 0.9 * len(free)
    only = pages.filter("page_id < 5")
    assert {r.verdict for r in urls.judge_urls(only).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_markov_adds_up():
    model = urls.Markov(list(Counter(t[i:i + n] for t in ["abcab", "abd"] for n in (1, 2, 3) for i in range(len(t) - n + 1)).items()))
    from math import exp
    symbols = [chr(33 + i) for i in range(94)] + ["\x7f", "\x80"]
    for context in ("", "a", "ab", "zz", "ca"):
        assert abs(sum(exp(model.score(context, c)) for c in symbols) - 1) < 1e-9


def test_chat(spark):
    rows = [(1, 1, "bob", "hi"), (1, 0, "ann", "hello <|assistant|>"), (1, None, "bob", None), (1, 2, None, "?"), (1, 600, "ann", "late"),
            (1, 0, "system", "be kind"), (None, 0, "ann", "alone"), (2, 0, "system", "only"), (1, 1, "bob", "hi")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(turns).collect()}
    assert set(got) == {(1, p, k) for p in ("ann", "bob") for k in (-1, 0, 1)} | {(None, "ann", 0)}
    r = got[1, "bob", 0]
    assert r.rendered == (
        "<|user name=ann|>\nhello < |assistant|><|end|>\n<|system|>\nbe kind<|end|>\n"
        "<|assistant|>\nhi<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\n?<|end|>\n"
    )
    assert [r.rendered[m.start:m.end] for m in r.mask] == ["hi<|end|>\n"] * 2
    assert [x.rendered[m.start:m.end] for x in [got[1, "ann", 1]] for m in x.mask] == ["late<|end|>\n"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_lines(spark):
    def page(i, *ls):
        return (i, f"http://Site.org/{i}", "<html><script>x</script><p>" + "</p><p>".join(ls) + "</p>")

    rows = [page(i, "menu", f"body {i}", "menu", "<b>half</b>" if i < 3 else "rare") for i in range(6)]
    rows += [(6, None, "<p>menu</p>"), (7, "http://other.org", None), (8, "http://other.org", ""), page(5, "menu", "body 5", "menu", "rare")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = _sorted(lines.drop_boilerplate(pages).collect())
    assert got[0] == (0, "site.org", 4, 2, "body 0\nhalf")
    assert got[4] == (4, "site.org", 4, 3, "body 4")
    assert got[7:] == [(6, None, 1, 0, "menu"), (7, "other.org", 0, 0, ""), (8, "other.org", 0, 0, "")]
    assert lines.drop_boilerplate(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_chat_rotation", "op8_site_lines", "op9_benchmark_overlap"])
def test_sql_gives_the_same(spark, name):
    from compare import connect, difference

    from corpusmith.llm.queries import QUERIES, SQL

    folder = "/root/testdata/sf0.001"
    assert difference(QUERIES[name](spark, folder), connect(folder), SQL[name]) is None


def test_clashing_names_in_shards_and_decontamination(spark):
    rows = [(i, f"text {i} " * (i % 5), 7, "x", i * 2, -1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, shard string, decontam_row long, slot int")
    out = shards.assign_shards(df, shards=4, keep=df.columns)
    assert len(out.columns) == len(set(out.columns))
    got = out.collect()
    assert {r.size_input for r in got} == {7} and {r.shard_input for r in got} == {"x"} and {r.slot_input for r in got} == {-1}
    assert sorted(r.decontam_row for r in got) == [i * 2 for i in range(30)]
    bench = spark.createDataFrame([("q1", "text 3 text 3 text 3"), ("q2", "text 4 text 4 text 4 text 4")], "item_id string, text string")
    kept = decontam.drop_contaminated(df, bench, window=3, block_words=4)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.decontam_row) for r in kept.collect()) == sorted(
        (i, i * 2) for i in range(30) if i not in (3, 4)
    )
