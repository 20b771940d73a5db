"""The registered queries that SQL doesn't express, against brute force on small tables written as the driver's are."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from askframe.llm import language_id, license_scan, queries, toxicity
from askframe.llm.common import words_of

from .test_operators import TEXTS, fingerprint_by_force, groups_by_force, prose


def written(spark, tmp_path, name, rows, ddl):
    spark.createDataFrame(rows, ddl).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


# --- licences ---

_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def scanned_by_force(text):
    """Every template at every start."""
    w = _WORD.findall((text or "").encode().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    hits = [(p, label) for phrase, label in license_scan.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.encode().split()]
    labels, score = {x for _, x in hits}, float(bool(hits))
    for notice, label, key in license_scan.NOTICES:
        t, k = notice.encode().split(), key.encode().split()
        for at in range(-len(t), len(w)):
            share = sum(0 <= at + i < len(w) and w[at + i] == x for i, x in enumerate(t)) / len(t)
            near = w[max(0, at) : max(0, at + len(t) + len(k))]
            if share >= 0.8 - 1e-9 and any(near[i : i + len(k)] == k for i in range(len(near))):
                labels.add(label)
                score = max(score, share)
    return len(w), len(hits), min((p for p, _ in hits), default=None), max((p for p, _ in hits), default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), round(score, 9)


def test_license_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = list(TEXTS)
    for n, (notice, _, _) in enumerate(license_scan.NOTICES):
        words = notice.split()
        for k, share in enumerate((0.0, 0.1, 0.19, 0.3)):  # that share of the words is another
            w = list(words)
            for i in rng.choice(len(w), int(share * len(w)), replace=False):
                w[i] = "zzz"
            rows.append((1000 + 10 * n + k, " ".join([prose(n, 50 + n).upper(), *w, prose(5, n)]).strip()))
        rows.append((1000 + 10 * n + 8, " ".join(words[len(words) // 10 :])))
    sf = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = Counter((*tuple(r)[:7], round(r.score, 9)) for r in queries.op10_license_scan(spark, sf).collect())
    assert got == Counter((i, *scanned_by_force(t)) for i, t in rows)


def test_copies_with_enough_words_keep_a_key():
    """Whatever 0.2 of a template's words are lost, a key stays."""
    index = license_scan.RareTokenIndex()
    kept = Counter(t for posts in index.postings.values() for t, _ in posts)
    for t, (words, _, key) in enumerate(index.templates):
        assert key is None or kept[t] > 0.2 * len(words) - 1e-9


# --- languages ---


def grams_by_force(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    n = Counter()
    for w in words:
        n.update(w)
        padded = f" {w} "
        n.update(padded[i : i + 2] for i in range(len(padded) - 1))
        n.update(padded[i : i + 3] for i in range(len(padded) - 2))
    # blanks between words are shared, so two-letter parts that end and start one count once each, as above
    return n


def ranks_by_force(n):
    def code(g):
        x = 0
        for c in g:
            x = x << 21 | ord(c)
        return x

    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.RANKS]


def test_language_query(spark, tmp_path):
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "éêabx "}
    r = np.random.default_rng(8)
    rows = [(i, "".join(r.choice(list(alphabets[lang]), 120)), lang) for i, lang in enumerate(np.resize(list(alphabets), 90).tolist())]
    rows += [(200, None, "aa"), (201, "123 ...", "bb"), (202, "", None), (203, "abab", None), (None, "cdefg " * 5, "cc"), (5, rows[5][1], rows[5][2])]
    sf = written(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string")
    total = defaultdict(Counter)
    for i, t, lang in rows:
        if i is not None and not held(i) and lang:
            total[lang].update(grams_by_force(t))
    profiles = {lang: {g: k for k, g in enumerate(ranks_by_force(n))} for lang, n in total.items()}
    want = []
    for i, t, _ in rows:
        mine = ranks_by_force(grams_by_force(t))
        far = {lang: sum(min(abs(known[g] - k), language_id.RANKS) if g in known else language_id.RANKS for k, g in enumerate(mine)) for lang, known in profiles.items()}
        best = min(sorted(far), key=far.get) if mine else "und"
        want.append((i, held(i), best, round(1 - far[best] / (language_id.RANKS * len(mine)), 9) if mine else 0.0))
    got = [(x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in queries.op5_language_id(spark, sf).collect()]
    assert Counter(got) == Counter(want)


# --- fingerprints ---


def test_simhash_query(spark, tmp_path):
    base = prose(60, 5).split()
    rows = TEXTS + [(400 + i, " ".join([*base, *["tail"] * i])) for i in range(8)]
    sf = written(spark, tmp_path, "documents", rows, "doc_id long, text string")
    made = [fingerprint_by_force(t, 3)[0] for _, t in rows]
    group = groups_by_force(made, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    got = Counter(tuple(r) for r in queries.op7_simhash(spark, sf).select("doc_id", "fingerprint", "component_id").collect())
    assert got == Counter((rows[i][0], f"{made[i]:016x}", least[group[i]]) for i in range(len(rows)))


# --- toxicity ---


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    r = np.random.default_rng(4)
    rows = [(i, prose(40, 3000 + i) + (" " + " ".join(r.choice(["grolfen", "grolft", "zworp"], 3)) if i % 4 == 0 else "")) for i in range(400)]
    rows += [(4, "another text of the same id"), (None, "grolfen zworp"), (900, None), (901, "")]
    at = tmp_path_factory.mktemp("toxic")
    written(spark, at, "documents", rows, "doc_id long, text string")
    return rows, written(spark, at, "labels", [(i, 1, int(i % 4 == 0)) for i in range(0, 400, 2)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity_query(spark, toxic):
    """The fit by its definition, from plain lists, gives each score."""
    rows, sf = toxic
    ids = {i for i in range(400) if not held(i)}
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    positive = [i for i in ids if i % 4 == 0]
    free = [i for i in text if i is not None and not held(i)]
    assert len(positive) <= toxicity.FIT_POSITIVE and len(free) <= toxicity.FIT_UNLABELLED  # so the fit takes all
    got = queries.op8_toxicity(spark, sf).collect()
    assert len(got) == len(rows) and all(x.held_out == held(x.doc_id) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    prior = sum(i % 4 == 0 for i in ids if i % 2 == 0) / sum(i % 2 == 0 for i in ids)
    models = [toxicity.fit([toxicity.features(text[i][k if i == 4 else 0]) for i in positive], [toxicity.features(text[i][k if i == 4 else 0]) for i in free], prior) for k in (0, 1)]

    def agrees(model):
        own = Counter((i, round(model.score(t), 6)) for i, t in rows)
        return own == Counter((x.doc_id, round(x.score, 6)) for x in got)

    assert any(map(agrees, models))  # of a repeated id one text is taken


def test_texts_of_a_repeated_id_are_chosen_alike(spark, toxic):
    _, sf = toxic
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    a, b = (toxicity.learn_toxicity(docs.repartition(n), labels) for n in (1, 5))
    assert np.array_equal(a.known, b.known) and np.allclose(a.weights, b.weights) and words_of("A b") == [b"a", b"b"]
