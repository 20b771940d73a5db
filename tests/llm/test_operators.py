"""Each operator against a brute-force version on odd rows: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from askframe.llm import bpe, decontaminate, language_id, license_scan, line_dedup, mtree, queries, simhash, suffix_dedup, toxicity, trie, url_filter
from askframe.llm.common import words_of
from askframe.llm.components import components

DOCS = "doc_id long, text string, lang string, key string, blob string, bucket int, n_lines int, score double"
RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeéß") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


PASSAGE = prose(60, 1)
LINE = "Subscribe to our Newsletter"
TEXTS = [
    (0, PASSAGE),
    (1, prose(40, 2) + "\n" + PASSAGE + "\n" + LINE),
    (2, None),
    (3, ""),
    (4, "\n\n  \n"),
    (5, PASSAGE + " " + PASSAGE),
    (6, "a" * 5000),
    (7, ("ab " * 800) + prose(3000, 9)),
    (8, "Ωμέγα 漢字 ½ ²x \u3000 don't  stop\t\tnow 12345"),
    (9, PASSAGE.replace(" ", "  ", 3)),
    (10, "Released under the MIT License. mit license; GNU General Public License CC BY cc-by"),
    (10, prose(30, 77)),
    (11, "dup row"),
    (11, "dup row"),
    (None, "no id " + PASSAGE),
    *((100 + i, prose(20, 100 + i) + f"\n {LINE.upper()} \n" + prose(25, 200 + i)) for i in range(12)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de")[n % 2], "k", "b", 1, 5, 0.5) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def distinct_rows():
    return list(dict.fromkeys(TEXTS))


# --- suffix dedup ---


def removed_by_force(rows):
    """(doc, text) -> kept bytes and spans; rows in the operator's order."""
    seen, out = set(), {}
    order = sorted({(-1 << 63 if i is None else i, t) for i, t in rows}, key=lambda r: (r[0], np.uint32(xxhash.xxh32_intdigest((r[1] or "").encode())).view(np.int32)))
    for i, t in order:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for a in range(len(b) - 99):
            w = b[a : a + 100]
            if w in seen:
                mask[a : a + 100] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(int), [0])))).reshape(-1, 2)
        out[None if i == -1 << 63 else i, t] = (bytes(np.frombuffer(b, np.uint8)[~mask]), [tuple(x) for x in edge.tolist()])
    return out


def test_suffix_dedup(spark, docs, none):
    expected = removed_by_force(TEXTS)
    got = Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == Counter((i, len((t or "").encode()), tuple(expected[i, t][1]), expected[i, t][0]) for i, t in TEXTS)
    assert suffix_dedup.remove_repeats(none).collect() == []


@pytest.mark.parametrize("cut", [512, 1])
def test_suffix_dedup_stages(monkeypatch, cut):
    """The stages without Spark; cut 1 sends every shared minimizer through stripes."""
    monkeypatch.setattr(suffix_dedup, "CUT_ABOVE", cut)
    monkeypatch.setattr(suffix_dedup, "PIECE", 2048)
    rows = [(i, prose(8, i) + PASSAGE[i : 300 - i] + prose(6, 3 * i) + PASSAGE[40:200] * (i % 3)) for i in range(40)] + [(50, "x" * 4000), (51, "xy" * 900), (52, prose(2000, 4) + PASSAGE)]
    n = 3

    def group(stream, kinds):
        out = defaultdict(list)
        for b, k, blob in stream:
            if k in kinds:
                out[b].append(blob)
        return out

    batches = [([i for i, _ in part], [t.encode() for _, t in part]) for part in (rows[:20], rows[20:])]
    found = list(suffix_dedup._find(batches, n))
    matched = [x for b, blobs in group(found, {suffix_dedup.SEGMENTS}).items() for x in suffix_dedup._match(blobs, n)]
    texts, wanted = group(suffix_dedup._texts(batches, n), {suffix_dedup.TEXTS}), group(matched, {suffix_dedup.WANTED})
    cut_ = [x for b in texts for x in suffix_dedup._cut(wanted[b], iter(texts[b]), n)]
    ranges = [x for blobs in group(cut_, {suffix_dedup.CUTS}).values() for x in suffix_dedup._sort(blobs, n)]
    all_ = group([*found, *matched, *ranges], {suffix_dedup.RANGES})
    got = {d: (kept, spans) for b in texts for d, _, spans, kept in suffix_dedup._strip(all_[b], iter(texts[b]))}
    expected = removed_by_force(rows)
    assert got == {i: expected[i, t] for i, t in rows}


def test_blind_trie_sorts():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(12)) for _ in range(300)]
    t = suffix_dedup.BlindTrie(12)
    for i, s in enumerate(strings):
        t.insert(int.from_bytes(s), i)
    classes = [[strings[i] for i in c] for c in t.classes()]
    assert [c[0] for c in classes] == sorted(set(strings)) and all(len(set(c)) == 1 for c in classes)


def test_windows_are_sorted():
    buf = np.frombuffer(("abc" * 200 + PASSAGE * 3).encode(), np.uint8)
    start = np.arange(len(buf) - 99)
    order, group = suffix_dedup.sort_windows(buf, start)
    w = [bytes(buf[i : i + 100]) for i in start[order]]
    assert w == sorted(w) and all((a == b) == (g == h) for a, b, g, h in zip(w, w[1:], group, group[1:]))


# --- url filter ---

URLS = [None, "", "no scheme.com/en/1", "http://A.Example.COM/en/77?q#f", "http://example.com", "http://notexample.com/en/7", "http://com/en/x", "http://x.net/de/8", "http://example.net/de/81", "http://user@www.example.net:80/de/8", "http://example.org?x=/es/", "ftp://a.org/es/", "http://a.org./es/", "http://com-x/en/", "http://é.com/en/\n9", "a://b://c.com/en/"]


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_filter(spark):
    rows = [(i, u, "x", 1) for i, u in enumerate(URLS * 3 + ["http://hot.example.com/en/7"] * 200)] + [(None, URLS[3], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, cell int")
    rules = spark.createDataFrame([*queries.RULES, (None, "/", "block"), ("", "/", "block")], "rule_host string, rule_path string, action string")
    got = Counter(tuple(r) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == Counter((i, *judge(u, queries.RULES)) for i, u, *_ in rows)
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


# --- decontamination ---


def similarity_by_force(text, item):
    w, v = words_of(text), words_of(item)
    a, b = ([b" ".join(x[i : i + 5]) for i in range(len(x) - 4)] for x in (w, v))
    if not a or not b:
        return 0.0
    best = 0.0
    for s in range(max(1, len(a) - len(b) + 1)):
        c, d = Counter(a[s : s + len(b)]), Counter(b)
        shared = sum((c & d).values())
        best = max(best, shared / (sum(c.values()) + len(b) - shared))
    return best


def test_decontamination(spark, docs, none):
    items = [(1, PASSAGE), (1, PASSAGE), (2, prose(12, 300)), (3, "too short here"), (4, None), (5, "a b c d e " * 6), (None, PASSAGE), (6, PASSAGE.replace(PASSAGE.split()[30], "zzz", 1))]
    extra = [(900, "so " + "".join(c.upper() if c.isascii() else c for c in items[2][1]) + " end"), (901, "a b c d e " * 40), (902, " ".join(PASSAGE.split()[:-3]))]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, p int")
    rows = TEXTS + extra
    frame = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, m int")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(frame, bench).collect()}
    expected = defaultdict(float)
    for i, t in rows:
        for k, item in items:
            if k is not None and (s := similarity_by_force(t, item)) >= 0.8:
                expected[i, k] = max(expected[i, k], round(s, 9))
    assert got == dict(expected) and {(900, 2), (901, 5), (902, 1)} <= set(got)
    kept = {r.doc_id for r in decontaminate.drop_leaks(frame, bench).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in expected}
    assert decontaminate.find_leaks(none, bench).collect() == [] == decontaminate.find_leaks(docs, bench.limit(0)).collect()


def test_decontamination_at_every_start(spark):
    """Items whose parts are swapped, amid other text: no window at 0.8 starts where a shingle lines up with the item."""
    items = [(n, prose(54, 700 + n)) for n in range(4)] + [(9, "one two three four five six seven eight")]
    rows = []
    for n, item in items[:4]:
        w = item.split()
        cut = (27, 20, 40, 30)[n]
        rows.append((n, " ".join([prose(200, 800 + n), *w[cut:], *w[:cut], prose(200, 900 + n)])))
    rows += [(20, prose(30, 1) + " one two three four five six seven eight"), (21, "one two three four five six seven eight"), (22, "")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = {(i, k): round(s, 9) for i, t in rows for k, item in items if (s := similarity_by_force(t, item)) >= 0.8}
    assert {(n, n) for n in range(4)} <= set(expected)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(frame, bench).collect()} == expected


# --- line dedup ---


def lines_by_force(rows, least, keep_first=False):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))

    n, first = Counter(), {}
    for i, t in rows:
        n.update({key(x) for x in (t or "").split("\n")})
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for k in {key(x) for x in (t or "").split("\n")}:
            first.setdefault(k, i)
    out = []
    for i, t in rows:
        lines, seen, kept = (t or "").split("\n"), set(), []
        for x in lines:
            k = key(x)
            if k and n[k] >= least and not (keep_first and first[k] == i and k not in seen):
                continue
            seen.add(k)
            kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return Counter(out)


@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, none, keep_first):
    got = line_dedup.dedup_lines(docs, 10, keep_first)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == lines_by_force(TEXTS, 10, keep_first)
    assert {"key", "blob", "bucket", "score"} <= set(got.columns)
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString() + decontaminate.find_leaks(docs, docs.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


# --- language ---


def test_language_id(spark, sf_dir, docs, none):
    whole = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = language_id.learn_profiles(whole)
    said = {r.doc_id: r for r in language_id.identify_languages(whole, profiles).collect()}
    truth = {r.doc_id: r.lang for r in whole.select("doc_id", "lang").collect()}
    held = [i for i, r in said.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in said.items())
    assert sum(said[i].lang_pred == truth[i] for i in held) >= 0.95 * len(held)
    odd = language_id.identify_languages(docs, profiles).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert {r.lang_pred for r in odd if r.doc_id in (2, 3, 4)} == {"und"}
    assert language_id.identify_languages(none).collect() == []
    assert {r.lang_pred for r in language_id.identify_languages(docs, language_id.Profiles({})).collect()} == {"und"}


def test_grams_by_force():
    text = "Ab, é ab\n12 Ωa"
    words = [f" {w} " for w in re.findall(r"[^\W\d_]+", text.lower())]
    expected = Counter(c for w in words for c in w.strip())
    padded = " " + " ".join(w.strip() for w in words) + " "
    expected.update(padded[i : i + 2] for i in range(len(padded) - 1))
    expected.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")

    def code(g):
        x = 0
        for c in g:
            x = x << 21 | ord(c)
        return x

    assert dict(zip(*(x.tolist() for x in language_id.grams(text)))) == {code(g): n for g, n in expected.items()}


# --- top k ---


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(400)] + [(500 + i, [0.5] * 8) for i in range(300)]
    rows += [(800, None), (850, [float("nan")] * 8), (900, [1.0, None] + [0.0] * 6), (950, [float("inf")] + [0.0] * 7), (1000, [0.0] * 8), (1050, [1.0] * 3), (1051, [2.0] * 3), (None, [1.0] * 8)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, b int, s int")
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    expected = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted(((-int(q @ x), j) for j, x in good if j != i and len(x) == len(q)))[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in mtree.top_k(frame).collect()) == sorted(expected)
    assert mtree.top_k(frame.limit(0)).collect() == []


def test_top_k_of_repeated_queries(spark):
    """Rows of one id that score best with themselves fill no other row's place; pairs count as in the query's SQL."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1, 50)] + [(100, [9.0, 9.0, 9.0, 9.0])] * 10 + [(150, [8.0, 0.0, 1.0, 0.0])]
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows]
    expected = []
    for own in (100, 150):
        best = sorted((-int(q @ x), j) for i, q in good if i == own for j, x in good if j != own)[:5]
        expected += [(own, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(tuple(r) for r in mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == sorted(expected)
    best = mtree.Best(1, 2)
    best.add(np.array([0]), np.array([7] * 6 + [1, 2, 3]), np.array([[9.0] * 6 + [1.0, 2.0, 3.0]]), np.array([7]))
    assert sorted(best.rows(np.array([7]))) == [(7, 2, 2), (7, 3, 3)]


# --- simhash ---


def fingerprint_by_force(text, k):
    w = words_of(text)
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)), {*h}


def groups_by_force(items, linked):
    label = list(range(len(items)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(items))]


@pytest.mark.parametrize("k, radius, similarity", [(3, 3, None), (5, 18, 0.8)])
def test_near_duplicates(spark, docs, none, k, radius, similarity):
    base = prose(200, 42).split()
    near = [(300 + i, " ".join(base[: 10 * i] + ["new"] + base[10 * i :])) for i in range(6)]
    rows = TEXTS + near
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    made = [fingerprint_by_force(t, k) for _, t in rows]

    def linked(a, b):
        if similarity is None:
            return bin(a[0] ^ b[0]).count("1") <= radius
        return len(a[1] & b[1]) >= similarity * len(a[1] | b[1])

    group = groups_by_force(made, linked)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    got = Counter(tuple(r) for r in simhash.near_duplicates(frame, k, radius, similarity).collect())
    assert got == Counter((rows[i][0], f"{made[i][0]:016x}", least[group[i]]) for i in range(len(rows)))
    assert simhash.near_duplicates(none, k, radius, similarity).collect() == []


def components_found(spark, rows, *how):
    got = defaultdict(set)
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), *how).collect():
        got[r.component_id].add(r.doc_id)
    return {frozenset(x) for x in got.values()}


def test_near_copies_in_a_family(spark, monkeypatch):
    """Pages that share most of their words with hundreds of others, at less than the similarity; some have a near copy, no nearer by its bits."""
    monkeypatch.setattr(simhash, "PART", 150, raising=False)
    shared = [f"s{i}" for i in range(165)]
    pages = [shared + [f"p{n}x{i}" for i in range(22)] for n in range(400)]
    copies = [p[:173] + [f"c{n}x{i}" for i in range(14)] for n, p in enumerate(pages[:100])]
    rows = [(i, " ".join(p)) for i, p in enumerate(pages + copies)]
    assert components_found(spark, rows, 1, 18, 0.8) == {frozenset((i, 400 + i)) if i < 100 else frozenset((i,)) for i in range(400)}


def test_same_fingerprint_is_no_link(spark):
    """A filler that makes over half of the shingles is the fingerprint; each text may have copies of its own."""
    rest = [[f"r{n}x{i}" for i in range(60)] for n in range(4)]
    rows = [(n, " ".join(["ab"] * 100 + x)) for n, x in enumerate(rest)] + [(10 + n, " ".join(x)) for n, x in enumerate(rest)]
    prints = {fingerprint_by_force(t, 1)[0] for _, t in rows[:4]}
    assert len(prints) == 1
    assert components_found(spark, rows, 1, 18, 0.8) == {frozenset((n, 10 + n)) for n in range(4)}


def test_repeats_are_no_difference(spark):
    """Texts of one shingle set, or nearly, in which a passage is repeated: further apart than the radius by their bits."""
    base = [[f"b{n}x{i}" for i in range(80)] for n in range(6)]
    rows = [(n, " ".join(x)) for n, x in enumerate(base)] + [(10 + n, " ".join(x[:4] * 60 + x + ["new"])) for n, x in enumerate(base)]
    far = [fingerprint_by_force(rows[n][1], 1)[0] ^ fingerprint_by_force(rows[6 + n][1], 1)[0] for n in range(6)]
    assert any(x.bit_count() > 18 for x in far)
    assert components_found(spark, rows, 1, 18, 0.8) == {frozenset((n, 10 + n)) for n in range(6)}


def test_keep_one(docs):
    kept = simhash.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(11) == 1 and 0 in ids and 9 not in ids and None in ids and {2, 3, 4} & set(ids) == {2}


@pytest.mark.parametrize("radius", [0, 1, 3, 12])
def test_trie_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 30).astype(np.uint64)) for _ in range(8)]))
    groups = rng.integers(0, 2, len(fps))
    order = np.lexsort((fps, groups))
    fps, groups = fps[order], groups[order]
    pairs = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if groups[a] == groups[b] and bin(int(fps[a] ^ fps[b])).count("1") <= radius}
    assert set(zip(*(x.tolist() for x in trie.trie_links(fps, groups, radius, 10**9)))) == pairs
    some = set(zip(*(x.tolist() for x in trie.trie_links(fps, groups, radius))))
    numbered = list(range(len(fps)))
    assert some <= pairs and groups_by_force(numbered, lambda a, b: (b, a) in some) == groups_by_force(numbered, lambda a, b: (b, a) in pairs)


def test_hot_block_is_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CUT_ABOVE", 3)
    rng = np.random.default_rng(4)
    fps = [0x1234 << 48 | int(x) for x in rng.integers(0, 2**40, 60)]
    fps += [f ^ 1 << int(b) ^ 1 << int(c) for f, b, c in zip(fps, rng.integers(0, 64, 60), rng.integers(0, 64, 60))]
    fps = list(dict.fromkeys(fps))
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = simhash.join_groups(simhash.block_groups(frame, 3), 3)
    got = {frozenset(int(np.int64(x).view(np.uint64)) for x in r) for r in links.collect()}
    assert groups_by_force(fps, lambda a, b: frozenset((a, b)) in got) == groups_by_force(fps, lambda a, b: bin(a ^ b).count("1") <= 3)


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 8), (8, 7)] + [(i, i + 1) for i in range(100, 160)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 7: 7, 8: 7} | {i: 100 for i in range(100, 161)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- toxicity ---


def test_toxicity(spark, docs, none):
    r = random.Random(1)
    rows = [(i, prose(60, i) + (" " + " ".join(r.choice(["grolfen", "grolft", "zworp"]) for _ in range(3)) if i % 5 == 0 else "")) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), 1) for i in range(0, 600, 2)] + [(None, 1, 1), (1, None, 1)], "doc_id long, toxic int, quality int")
    got = {x.doc_id: x for x in toxicity.score_toxicity(frame, labels).collect()}
    held = [x for x in got.values() if x.held_out]
    assert sum(x.predicted == (x.doc_id % 5 == 0) for x in held) >= 0.97 * len(held)
    assert all(x.predicted == (x.score >= 0.7) and 0 <= x.score <= 1 for x in got.values())
    odd = toxicity.score_toxicity(docs, labels.limit(0)).collect()
    assert len(odd) == len(TEXTS) and not any(x.predicted for x in odd)
    assert toxicity.score_toxicity(none, labels).collect() == []
    model = toxicity.learn_toxicity(frame, labels)
    kept = toxicity.drop_toxic(docs, model=model)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS)


def test_risk_is_never_negative():
    """Unlabelled documents that are all positive must not push the positives' scores down without bound."""
    x = [np.array([1], np.uint32)] * 50
    model = toxicity.fit(x, x, 0.9)
    assert np.isfinite(model.bias) and np.isfinite(model.weights).all()


# --- BPE ---


def test_bpe(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = bpe.load_ranks(f)
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = Counter(tuple(r) for r in bpe.digests(bpe.tokenize(docs, path, public_tokenizers.PATTERN)).collect())
    expected = Counter()
    for i, t in TEXTS:
        ids = exact.encode_ordinary(t or "")
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == expected
    assert bpe.tokenize(none, path, public_tokenizers.PATTERN).collect() == []


def test_bpe_small_cache(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 5)
    monkeypatch.setattr(bpe, "ROUNDS", 2)
    encoder = bpe._encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = [prose(10, 1), prose(10, 2), None]
    cache = bpe.Cache()
    for _ in range(3):
        got = bpe.encode_texts(texts, regex.compile(public_tokenizers.PATTERN).findall, encoder, cache)
        assert [d.decode() for _, d in got] == [t or "" for t in texts]


# --- licences ---


def test_license_scan(docs, none):
    word = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    expected = Counter()
    for i, t in TEXTS:
        w = word.findall((t or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
        hits = [(p, label) for phrase, label in license_scan.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.encode().split()]
        expected[i, len(w), len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))] += 1
    got = license_scan.scan_licenses(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == expected
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert license_scan.scan_licenses(none).collect() == []


@pytest.mark.parametrize("text, label", [(license_scan.NOTICES[0][0].upper(), "mit"), ("x " + license_scan.NOTICES[1][0].replace("source", "Source,"), "bsd"), ("nothing here", None)])
def test_notices(text, label):
    _, _, more, score = license_scan.RareTokenIndex().scan(license_scan.words_of(text))
    assert more == ({label} if label else set()) and (score > 0) == bool(label)


# --- registered queries ---


def test_sql_agrees(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def rows(names, records):
        at = sorted(range(len(names)), key=lambda i: names[i])
        return [names[i] for i in at], Counter(json.dumps([r[i] for i in at], default=str) for r in records)

    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf_dir)
        got = con.execute(sql)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in got.description], got.fetchall()), name


# --- top k, pages ---


def test_top_k_in_many_pages_and_blocks(spark, monkeypatch):
    """Clusters, one with a third of all rows, equal vectors and large components; small pages and blocks."""
    for name, n in (("PAGE", 60), ("BLOCK", 3), ("PIVOTS", 7), ("LEAF", 8), ("FANOUT", 3)):
        monkeypatch.setattr(mtree, name, n)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(6, 12)) * 4
    rows = [(i, (centres[0 if i % 3 == 0 else i % 6] + rng.normal(size=12)).tolist()) for i in range(900)] + [(1000 + i, [0.25] * 12) for i in range(200)] + [(5000, [3.0e6] * 12), (5001, [-2.9e6] * 12), (5050, [1.0e6] * 12)]
    good = [(i, [int(np.floor(256 * c)) for c in v]) for i, v in rows]
    expected = []
    for i, q in good:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in good if j != i)[:5]
            expected += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    x = np.array([[2**40] * 3])
    with pytest.raises(OverflowError):
        mtree.Tree(np.array([1]), x).search(x, np.array([2]), mtree.Best(1, 5))


def test_products_are_avoided():
    """In clusters most products are ruled out by the stored distances."""
    rng = np.random.default_rng(12)
    x = np.floor(256 * (rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)] * 3 + 0.1 * rng.normal(size=(6000, 16)))).astype(np.int64)
    tree, best = mtree.Tree(np.arange(6000), x), mtree.Best(20, 5)
    tree.search(x[:20], np.arange(20), best)
    assert sorted(best.rows(np.arange(20))) == sorted((i, j, int(s)) for i in range(20) for s, j in sorted(((int(x[i] @ x[j]), j) for j in range(6000) if j != i), key=lambda r: (-r[0], r[1]))[:5])
    assert tree.products < 0.3 * 20 * 6000
