"""Substring, exact, near-duplicate and line deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import exact, fmindex, lines, minhash, substring, textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(None, None), (None, "word " * 30), (5, None), (5, None), (6, ""), (7, " \t\n\x0b\x0c\r "), (8, "one"), (8, "one"), (9, "é" * 3), (10, "x" * 50_000 + " y"), (11, "a b " * 20_000)]


def corpus(seed=3, n=40):
    """Random texts with shared passages, copies, near copies and periodic parts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 9)))
    shared = [[word() for _ in range(45)] for _ in range(3)]
    docs = []
    for i in range(n):
        w = [word() for _ in range(r.randint(0, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(w))
            w[at:at] = shared[i % 2][r.randint(0, 10) :]
        if i % 7 == 0:
            w += ["la", "li"] * 25
        text = "".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w)
        if i % 5 == 4 and docs:
            text = docs[-1][1]
        if i % 11 == 5 and docs:
            t = docs[-1][1].split(" ")
            t[len(t) // 2 : len(t) // 2 + 1] = [word()]
            text = " ".join(t)
        docs.append((i, text))
    return docs


def brute_windows(docs, window=20):
    first, out = {}, {}
    for d, t in sorted(docs):
        w, drop = WORD.findall(t), set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if first.setdefault(key, (d, s)) != (d, s):
                drop |= set(range(s, s + window))
        out[d] = (len(w), len(drop), " ".join(x for i, x in enumerate(w) if i not in drop))
    return out


@pytest.mark.parametrize("hot", [5000, 2])
def test_substring_against_brute_force(make, hot):
    docs = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.substring_dedup(make(docs), hot=hot).collect()}
    assert got == brute_windows(docs)
    assert sum(v[1] for v in got.values()) > 100


def test_substring_odd_rows(make, spark):
    rows = sorted(((r.doc_id, r.n_words, r.n_removed) for r in substring.substring_dedup(make(ODD)).collect()), key=str)
    assert len(rows) == len(ODD)
    found = {r[0]: r for r in rows if r[0] is not None}
    assert found[5] == (5, 0, 0) and found[8] == (8, 1, 0) and found[10] == (10, 2, 0)
    assert found[11] == (11, 40_000, 39_998)  # the first two windows are new, all others repeat them
    assert (None, 30, 29) in rows  # windows from the second on repeat the first
    assert substring.substring_dedup(make(ODD).limit(0)).count() == 0


def test_matching_statistics_against_brute_force():
    rng = np.random.default_rng(5)
    depth = 6
    seqs = [rng.integers(1, 4, size=rng.integers(1, 20)) for _ in range(30)]
    text = np.concatenate([np.append(s, 0) for s in seqs])
    index = fmindex.FMIndex(text, 4, depth)
    held = [tuple(s.tolist()) for s in seqs]
    occurs = {p: sum(h[i : i + len(p)] == p for h in held for i in range(len(h))) for h in held for i in range(len(h)) for j in range(i + 1, min(len(h), i + depth) + 1) for p in [h[i:j]]}
    foreign = [rng.integers(-1, 4, size=rng.integers(0, 25)) for _ in range(40)]
    foreign = [np.where(s == 0, 1, s) for s in foreign]  # separators are no symbols of a stream
    stream = [*seqs, *foreign]
    first = np.concatenate([[0], np.cumsum([len(s) for s in stream])])
    lengths, lows, highs = index.matching_statistics(np.concatenate(stream), first)
    shrinks, group = 0, {}
    for s, a in zip(stream, first):
        s = tuple(s.tolist())
        for i in range(len(s)):
            want = max((k for k in range(1, min(depth, len(s) - i) + 1) if s[i : i + k] in occurs), default=0)
            assert lengths[a + i] == want
            assert highs[a + i] - lows[a + i] == (occurs[s[i : i + want]] if want else len(text))
            shrinks += 0 < want < min(depth, len(s) - i)
            if want == depth:
                assert group.setdefault(s[i : i + depth], lows[a + i]) == lows[a + i]
    assert shrinks > 20 and len(set(group.values())) == len(group) > 50
    values = rng.integers(0, 9, 500)
    matrix = fmindex.WaveletMatrix(values, 9)
    at, symbol = rng.integers(0, 501, 200), rng.integers(0, 9, 200)
    assert (matrix.rank(symbol, at) == [(values[:i] == s).sum() for s, i in zip(symbol, at)]).all()


def test_exact_against_brute_force(make):
    docs = [*corpus(), (100, "a b"), (101, "a  b"), (102, "ab"), (103, "a b"), (104, "a  b")]
    groups = defaultdict(list)
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    for d, t in docs:
        groups[squeeze(t)].append((-len(t), d))
    want = {d: (min(groups[squeeze(t)])[1], len(groups[squeeze(t)]), hashlib.sha256(squeeze(t).encode()).hexdigest()) for d, t in docs}
    for size in (exact.TRIE_BYTES, 3000):  # the second spills
        got = {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact.exact_dedup(make(docs), trie_bytes=size).collect()}
        assert got == want
    assert {r.doc_id for r in exact.exact_dedup(make(docs)).where("kept").collect()} == {w[0] for w in want.values()}


def test_exact_odd_rows(make):
    rows = exact.exact_dedup(make(ODD)).collect()
    assert len(rows) == len(ODD)
    blank = [r for r in rows if r.group_size == 5]
    assert len(blank) == 5 and {r.keep_id for r in blank} == {7}  # the longest original of the empty text
    assert [r.kept for r in rows if r.doc_id == 8] == [True, True]
    assert exact.exact_dedup(make(ODD).limit(0)).count() == 0


def test_trie_spills_and_restores():
    r = random.Random(2)
    keys = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(400)]
    trie, want = exact.PatriciaTrie(1500), {}
    for i, k in enumerate(keys):
        e = (r.randint(0, 3), r.choice([i, None]), 1)
        trie.insert(k, e)
        want[k] = exact.better(want[k], e) if k in want else e
    got = list(trie.items())
    assert len(got) == len(dict(got)) and dict(got) == want


def sets_of(docs, size):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    out = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        out[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def brute_components(docs, size, percent=80):
    sets = sets_of(docs, size)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def near_corpus(seed, bases=12, copies=12):
    """Groups of variants, each a few edits from its base, so that many pairs lie close to the threshold."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    docs, n = [], 0
    for _ in range(bases):
        base = [word() for _ in range(r.randint(30, 120))]
        for c in range(r.randint(1, copies)):
            w = base[:]
            for _ in range(r.randint(0, max(1, len(w) // 25)) if c else 0):
                w[r.randrange(len(w))] = word().upper()
            docs.append((n, " ".join(w)))
            n += 1
    return docs


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_against_brute_force(make, size):
    docs = near_corpus(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_dedup(make(docs), size=size).collect()}
    assert got == brute_components(docs, size)


def test_large_cluster_is_cut_into_cells(make):
    docs = near_corpus(9, bases=1, copies=60) + [(1000 + d, t) for d, t in near_corpus(10, bases=2, copies=30)]
    want = {d: c for d, (_, c) in brute_components(docs, 4).items()}
    for bound in ({"cell": 7}, {"cell_shingles": 500}):
        found = minhash.near_duplicates(make(docs), size=4, **bound)
        assert {r.k: r.component for r in found.collect()} == want


def test_recall_in_a_crowded_family(spark):
    """20,000 pages of one template, 1,000 pairs of them just above 80 percent, the rest below 60: at least 99 % of the links, no other."""
    r = random.Random(11)
    template = [f"t{i}" for i in range(75)]
    rows = []
    for d in range(20_000):
        if d < 2000 and d % 2:  # nine of a hundred shingles differ from the row before
            own = [*own[:-9], *(f"w{r.random()}" for _ in range(9))]
        else:
            own = [f"w{r.random()}" for _ in range(28)]
        rows.append((d, " ".join(template + own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {x.doc_id: x.component_id for x in minhash.near_dedup(docs, size=4).collect()}
    assert all(c == d or (c == d - 1 and d < 2000 and d % 2) for d, c in found.items())
    assert sum(c != d for d, c in found.items()) >= 990


def test_near_odd_rows(make):
    rows = minhash.near_dedup(make(ODD), size=4).collect()
    assert len(rows) == len(ODD)
    assert all(r.kept and r.component_id == r.doc_id for r in rows)
    assert minhash.near_dedup(make(ODD).limit(0)).count() == 0


def test_exact_links_finds_every_link():
    r = random.Random(4)
    sets = [np.array(sorted(r.sample(range(60), r.randint(5, 50))), np.uint64) for _ in range(80)]
    sets += [np.sort(np.append(s[1:], np.uint64(100 + i))) for i, s in enumerate(sets[:20])]
    root = minhash.exact_links(sets, 80)
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))]
    want = minhash.components_of(len(sets), *np.array(links).T)
    assert (root == want).all()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutated(r, a, edits):
    b = bytearray(a)
    for _ in range(edits):
        at = r.randint(0, len(b))
        kind = r.randrange(3)
        if kind == 0:
            b.insert(at, r.choice(b"abc"))
        elif at < len(b):
            b[at : at + 1] = b"" if kind == 1 else bytes([r.choice(b"abc")])
    return bytes(b)


@pytest.mark.parametrize("threshold", [0, 1, 2, 3, 4])
def test_banded_automaton_and_sketch(threshold):
    r = random.Random(threshold)
    a = [bytes(r.choice(b"abc") for _ in range(r.randint(0, 14))) for _ in range(600)]
    b = [mutated(r, x, r.randint(0, 5)) for x in a]
    want = np.array([min(distance(x, y), threshold + 1) for x, y in zip(a, b)])
    asarray = lambda v: [np.frombuffer(x, np.uint8).astype(np.uint64) for x in v]
    assert (lines.distances(asarray(a), asarray(b), threshold) == want).all()
    for kind in (np.uint8, np.uint64):
        raw, offs = textkit.utf8(pa.array(a + b, pa.binary()))
        sketch = textkit.Ranges(raw.astype(kind)).sketches(offs[:-1], offs[1:])
        assert textkit.may_be_within(sketch[:600], sketch[600:], threshold)[want <= threshold].all()


def lines_near(x, y):
    """The two rules, stated anew: x and y are stripped lines."""
    a, b = WORD.findall(x), WORD.findall(y)
    allowed = min(min(len(a), len(b)) // 10, 4)
    if allowed and abs(len(a) - len(b)) <= allowed and distance(a, b) <= allowed:
        return True
    return max(len(a), len(b)) < 20 and min(len(x), len(y)) >= 24 and abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2


def brute_lines(docs):
    first, every = {}, []
    for d, t in sorted(docs):
        for n, line in enumerate(t.split("\n")):
            if x := line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(x, (d, n))
                every.append((d, n, x))
    near = {x for x in first for y in first if first[y] < first[x] and lines_near(x, y)}
    gone = defaultdict(set)
    for d, n, x in every:
        if first[x] != (d, n) or x in near:
            gone[d].add(n)
    return {d: ("\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[d]), len(gone[d])) for d, t in docs}


def line_corpus(r, n=40):
    """Lines of all lengths with up to six edits of characters or words, some in other scripts."""
    word = lambda: "".join(r.choice("abcdé中") for _ in range(r.randint(1, 5)))
    bases = [[word() for _ in range(r.choice([1, 4, 9, 10, 11, 19, 20, 21, 30, 42, 60]))] for _ in range(24)]
    solid = ["".join(r.choice("中文字节é") for _ in range(30)) for _ in range(3)]

    def line():
        if r.random() < 0.15:
            return "".join(c if r.random() > 0.05 else r.choice("中文") for c in r.choice(solid))
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 5, 6])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [word()], [w[at], word()]]) if r.random() < 0.7 else [w[at] + "x"]
            w = w or ["a"]
        return r.choice([" ", "  "]).join(w)

    return [(i, "\n".join(r.choice(["", "  "]) + line() + r.choice(["", "\r"]) for _ in range(r.randint(0, 9)))) for i in range(n)]


@pytest.mark.parametrize(("seed", "run"), [(1, lines.RUN), (2, lines.RUN), (3, 2)])
def test_lines_against_brute_force(make, seed, run):
    """As registered, and with every shared key a cell of several blocks."""
    docs = line_corpus(random.Random(seed))
    options = {} if run == lines.RUN else {"run": 1, "cell_lines": 3}
    got = {x.doc_id: (x.text, x.n_removed) for x in lines.line_dedup(make(docs), **options).collect()}
    want = brute_lines(docs)
    assert got == want
    assert sum(n for _, n in want.values()) > 40


def test_keys_meet_in_small_steps():
    """Buckets that are sorted early give the pairs and cells of buckets that are sorted once."""
    r = np.random.default_rng(4)
    entries = np.zeros(3000, lines._PACKED)
    entries["key"] = r.integers(0, 300, 3000) | np.where(r.random(3000) < 0.3, 3 << 30, 1 << 30)
    entries["key"][:900] = 7 | 3 << 30
    entries["line"] = r.integers(1, 1 << 40, 3000)
    rows = [pa.RecordBatch.from_arrays([pa.array([1, 1, 5]), pa.array([entries[a : a + 500].tobytes(), entries[a + 500 : a + 1000].tobytes(), entries[a : a + 9].tobytes()], pa.binary())], names=["bucket", "packed"]) for a in (0, 1000, 2000)]
    rows = [b.slice(0, 2) for b in rows] + [b.slice(2) for b in rows]
    found = [sorted({tuple(x.values()) for b in lines._meet(iter(rows), 20, 8, limit) for x in b.to_pylist()}, key=str) for limit in (1 << 20, 64)]
    pairs, cells = ([sorted({x if x[0] is None else x[:2] for x in f if (x[0] is None) == null}) for f in found] for null in (True, False))
    assert pairs[0] and pairs[0] == pairs[1] and cells[0] and set(cells[0]) <= set(cells[1])
    assert len({x[1] for x in found[0] if x[0] == (1 << 30 | 7)}) >= 900
    assert {x[2] for x in found[0] if x[0] == (1 << 30 | 7)} == {-(-len({x[1] for x in found[0] if x[0] == (1 << 30 | 7)}) // 8)}
    assert 0 in {x[2] for x in found[1] if x[0] == (1 << 30 | 7)}


def test_template_lines_make_linear_work(make):
    """Variants of one template that are not near each other make a cell and no pairs, and stay."""
    r = random.Random(6)
    shared = " ".join(f"shared{i}" for i in range(30))
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    docs = [(i, f"{shared} {word()} {word()} {word()} {word()} {word()} {word()}") for i in range(600)]
    assert sum(x.n_removed for x in lines.line_dedup(make(docs)).collect()) == 0
    docs = [(i, f"{shared} {word()} the end of it") for i in range(600)]
    assert sum(x.n_removed for x in lines.line_dedup(make(docs)).collect()) == 599


def test_lines_odd_rows(make):
    rows = lines.line_dedup(make(ODD)).collect()
    assert len(rows) == len(ODD) and {r.doc_id: r.n_removed for r in rows if r.doc_id is not None} == {5: 0, 6: 0, 7: 0, 8: 0, 9: 0, 10: 0, 11: 0}
    assert lines.line_dedup(make(ODD).limit(0)).count() == 0
    copies = {r.doc_id: r.text for r in lines.line_dedup(make([(1, "a line that is long enough to count\nb"), (2, "b\n a line that is long enough to count \n")])).collect()}
    assert copies == {1: "a line that is long enough to count\nb", 2: ""}
    long = "\n".join(" ".join(f"{i % 977}x{j * i % 1013}" for j in range(8)) for i in range(30_000))
    got = {r.doc_id: r for r in lines.line_dedup(make([(1, "y" * 3_000_000), (2, long), (3, long + "\nnew"), (4, "y" * 3_000_000)])).collect()}
    assert got[3].text == "new" and got[4].text == "" and got[1].n_removed == 0 and got[2].n_removed < 30_000 - 977


def test_words_and_hashes():
    texts = ["a b\x0bc", "", "ab\tcd ", "é x", "abcdefgh abcdefghi"]
    raw, offs = textkit.utf8(pa.array(texts))
    words = textkit.Words(raw, offs)
    got = [[raw[s:e].tobytes().decode() for s, e in zip(words.start[a:b], words.end[a:b])] for a, b in zip(words.first[:-1], words.first[1:])]
    assert got == [WORD.findall(t) for t in texts]
    spelled = [w for t in texts for w in WORD.findall(t)]
    assert len(set(words.hashes().tolist())) == len(set(spelled))
    assert sum(b - a for a, b, _, _ in textkit.blocks(pa.array(texts), 4)) == 5


def test_exact_repeats_of_short_lines(spark, tmp_path):
    from tessera.llm import queries

    long = "a line that is long enough for the edit join"
    docs = [(1, f"b\nMenu\n{long}\n中文\n\0\n\n \t"), (2, f" Menu \nMenus\nb\n\n{long}x\n中文\n\0\0\n "), (3, "Menus\nb\nb\nMenu\n\0"), (4, "\n\n"), (5, "c")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.text, x.n_removed) for x in queries.op9_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("Menus\n\n\0\0\n ", 4), 3: ("", 5), 4: ("\n\n", 0), 5: ("c", 0)}
