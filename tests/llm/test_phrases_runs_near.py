"""Periodic runs, collocations and MinHash near-duplicates against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import BASE, no_docs, odd_docs, odd_rows
from tests.llm.test_operators import WORD, ascii_lower, documents, plain_components
from voxdesk.llm import near_dedup, phrases, queries, runs
from voxdesk.llm.common import Scratch, word_pieces
from voxdesk.llm.substrings import WordHashes


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


# Periodic runs


def plain_runs(words, exponent, least):
    out = []
    for q in range(1, len(words) // exponent + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            low = i - q
            if j - low >= max(least, exponent * q) and not any(
                all(words[k] == words[k - r] for k in range(low + r, j)) for r in range(1, q)
            ):
                out.append((low, j, q))
            i = j + 1
    return sorted(out, key=lambda run: (run[0], run[2]))


def random_words(draw):
    n, kinds = draw.randrange(80), draw.choice([1, 2, 2, 3, 5])
    if draw.random() < 0.4:
        return [draw.randrange(kinds) for _ in range(n)]
    words = []
    while len(words) < n:
        words += [draw.randrange(kinds) for _ in range(draw.randrange(1, 12))] * draw.randrange(1, 8)
        if draw.random() < 0.3:
            words = words[: draw.randrange(len(words)) + 1]
    return words


def test_catcher_equals_brute_force_however_words_arrive():
    draw = random.Random(3)
    for _ in range(1500):
        words = random_words(draw)
        exponent, least, step = draw.choice([2, 2, 3, 4]), draw.choice([2, 6]), draw.choice([1, 3, 17, 1000])
        catcher = runs.RunCatcher(exponent, least)
        for i in range(0, len(words), step):
            catcher.append(np.array(words[i : i + step], np.int64))
        assert [tuple(r) for r in catcher.found().tolist()] == plain_runs(words, exponent, least), words


def test_texts_in_one_catcher_do_not_mix(monkeypatch):
    draw = random.Random(4)
    monkeypatch.setattr(runs, "APPEND_WORDS", 16)
    texts = [None if draw.random() < 0.1 else " ".join("abcde"[w] for w in random_words(draw)).encode() for _ in range(150)]
    for text, (n, found) in zip(texts, runs.text_runs(texts), strict=True):
        words = (text or b"").split()
        assert n == len(words)
        assert [tuple(r) for r in found.tolist()] == plain_runs(words, 4, 6)


def test_a_long_text_of_one_word_and_of_two_halves():
    words = np.zeros(300_000, np.int64)
    catcher = runs.RunCatcher(4, 6)
    catcher.append(words)
    catcher.append(np.array([1]))
    catcher.append(words[:200_000])
    assert catcher.found().tolist() == [[0, 300_000, 1], [300_001, 500_001, 1]]


def plain_op11(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 4, 6) if n < 3000 else None
    if found is None:
        return None
    gone = {i for low, high, q in found for i in range(low + q, high)}
    best = (None,) * 4
    for low, high, q in found:
        if best[0] is None or (high - low) * best[2] > best[1] * q:
            best = (low, high - low, q, 1000 * (high - low) // q)
    listed = "".join(f"{low},{high - low},{q}\n" for low, high, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


FIELDS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_op11_equals_brute_force(spark):
    found = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    got = {r["doc_id"]: tuple(r[c] for c in FIELDS) for r in found.collect()}
    texts = {r["doc_id"]: r["text"] for r in documents(spark).collect()}
    assert got.keys() == texts.keys()
    checked = 0
    for doc_id, text in texts.items():
        want = plain_op11(doc_id, text)
        if want:
            checked += want[1] > 0
            assert got[doc_id] == want
    assert checked > 5


def test_op11_odd_rows(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op11_periodic_runs(spark, str(tmp_path)).collect()
    want = [plain_op11(d, t) for d, t, *_ in odd_rows()]
    got = [tuple(r[c] for c in FIELDS) for r in rows]
    assert len(got) == len(want)
    assert Counter(w for w in want if w) <= Counter(got)
    clash = spark.createDataFrame([("x x x x x x y", 1, "kept")], "text string, runs int, other string")
    row = runs.periodic_runs(clash, with_text=True).first()
    assert row.asDict(True) == {
        "other": "kept", "n_words": 7, "runs": [{"start": 0, "length": 6, "period": 1}], "collapsed": "x y",
        "collapsed_sha256": hashlib.sha256(b"x y").hexdigest(),
    }
    assert runs.periodic_runs(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        runs.periodic_runs(no_docs(spark), min_exponent=1)


def test_word_pieces_cut_at_blanks():
    text = b"ab cd\tef  gh" * 5
    for size in (1, 2, 5, 1000):
        assert [w for piece in word_pieces(text, size) for w in piece] == text.split()
    assert list(word_pieces(None)) == list(word_pieces(b"")) == []


# Collocations


def plain_collocations(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", ascii_lower(text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts[lang].update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        frequent = {p: a for p, a in own.items() if a >= least}
        scored = []
        for phrase, a in frequent.items():
            words = phrase.split(" ")
            if len(words) < 2 or any(
                len(o.split(" ")) > len(words) and f" {phrase} " in f" {o} " and b >= a for o, b in frequent.items()
            ):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = own[" ".join(words[:k])], own[" ".join(words[k:])]
                cuts.append((1000 * a * totals[lang] // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            scored.append((-score, -a, phrase.encode(), phrase, left, right))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, totals[lang], -score))
    return sorted(out)


def random_texts(seed, n=60):
    draw = random.Random(seed)
    words = ["the", "of", "Über", "a", "New", "York", "x\x0b", "les.", "City", "é", "\xa0", "b"]
    return [
        (draw.choice(["en", "de", None, "und"]), " ".join(draw.choice(words) for _ in range(draw.randrange(60))) if draw.random() < 0.95 else None)
        for _ in range(n)
    ]


@pytest.mark.parametrize(("least", "longest", "top", "size"), [(3, 5, 2000, 500_000), (2, 3, 5, 9)])
def test_collocations_equal_brute_force(spark, scratch, monkeypatch, least, longest, top, size):
    monkeypatch.setattr(phrases, "ROW_WORDS", 8)
    rows = random_texts(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    found = phrases.collocations(df, scratch, min_count=least, max_words=longest, top=top, slice_rows=size)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, least, longest, top)


def test_tiles_count_like_a_counter(monkeypatch):
    monkeypatch.setattr(phrases, "TILE", 4)
    monkeypatch.setattr(phrases, "DENSE_PAIRS", 20)
    monkeypatch.setattr(phrases, "DENSE_TILES", 2)
    monkeypatch.setattr(phrases, "COORDINATES", 10)
    draw, want, got = np.random.default_rng(5), Counter(), Counter()
    tiles = phrases.TiledCounts(19)
    for _ in range(6):
        keys = np.minimum(draw.geometric(0.2, 200) - 1, 18) * 19 + np.minimum(draw.geometric(0.2, 200) - 1, 18)
        want.update(keys.tolist())
        tiles.add(keys)
        for part in (*tiles.flush(False),):
            got.update(dict(zip(*(c.tolist() for c in part), strict=True)))
    assert tiles.dense
    for part in tiles.flush(True):
        got.update(dict(zip(*(c.tolist() for c in part), strict=True)))
    assert +got == want


def test_collocations_odd_and_no_rows(spark, scratch):
    rows = [(r[2], r[1]) for r in odd_rows()] * 2
    found = phrases.collocations(odd_docs(spark).unionByName(odd_docs(spark)), scratch, min_count=4)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 4, 5, 2000)
    assert phrases.collocations(no_docs(spark), Scratch(spark, "t")).collect() == []


def test_scores_pass_64_bits(spark, scratch):
    rows = [("en", "a b " * 40_000)] * 50
    df = spark.createDataFrame(rows, "lang string, text string")
    found = phrases.collocations(df, scratch, max_words=2)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 100, 2, 2000)


# MinHash near-duplicates


def plain_sets(rows):
    out = []
    for _, text in rows:
        words = WORD.findall(ascii_lower(text or ""))
        out.append({tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    return out


def plain_near(rows, percent=85):
    sets = plain_sets(rows)
    links = [
        (i, j) for i in range(len(rows)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    groups = plain_components(links, range(len(rows)))
    least = defaultdict(list)
    for i, g in groups.items():
        if rows[i][0] is not None:
            least[g].append(rows[i][0])
    out = []
    for i, g in groups.items():
        component = min(least[g], default=None) if sets[i] else rows[i][0]
        out.append((rows[i][0], len(sets[i]), component, rows[i][0] == component))
    return Counter(out)


def found_near(df, scratch, **more):
    return Counter(tuple(r) for r in near_dedup.near_duplicates(df, scratch, **more).collect())


def test_near_duplicates_of_the_documents(spark, scratch):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert found_near(documents(spark), scratch) == plain_near(rows)


def test_near_duplicates_odd_and_no_rows(spark, scratch):
    assert found_near(odd_docs(spark), scratch) == plain_near([r[:2] for r in odd_rows()])
    assert found_near(no_docs(spark), Scratch(spark, "t")) == Counter()


@pytest.mark.parametrize(("seed", "small"), [(0, 64), (1, 4)])
def test_families_of_edits_lose_no_link(spark, scratch, monkeypatch, seed, small):
    """Copies of copies, whose links often run past the centre of their bucket."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    draw = random.Random(seed)
    texts = []
    for family in range(3):
        size = draw.choice([12, 40, 90])
        texts.append([f"w{family}x{draw.randrange(300)}" for _ in range(size)])
        for _ in range(60):
            words = list(draw.choice(texts[-30:]))
            for _ in range(draw.randrange(1, 4)):
                at = draw.randrange(len(words))
                kind = draw.random()
                if kind < 0.4:
                    words[at] = f"new{draw.randrange(40)}"
                elif kind < 0.7 and len(words) > 5:
                    del words[at]
                else:
                    words.insert(at, f"more{draw.randrange(40)}")
            texts.append(words)
    draw.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found_near(df, scratch) == plain_near(rows)


def star_of(spark, residues):
    rows = [(a, b, (True, residue, 9, 9, 40)) for a, b, residue in residues]
    kind = "a bigint, b bigint, c struct<linked boolean, residue array<bigint>, to_far int, to_near int, size bigint>"
    return spark.createDataFrame(rows, kind)


def test_most_hold_counts_shingles_across_slices(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SLICE_ROWS", 4)
    draw = random.Random(3)
    residues = [(star, 100 + b, sorted(draw.sample(range(12), 6))) for star in (1, 2, 3) for b in range(5 * star)]
    draw.shuffle(residues)
    found = {r["a"]: set(r["common"]) for r in near_dedup._most_hold(star_of(spark, residues).repartition(3)).collect()}
    for star in (1, 2, 3):
        own = [r for a, _, r in residues if a == star]
        held = Counter(t for r in own for t in r)
        assert found.get(star, set()) == {t for t, m in held.items() if 2 * m > len(own)}


def test_a_star_that_is_connected_hands_no_shingle_on(spark, scratch):
    compared = star_of(spark, [(1, b, [7, 8, 9]) for b in range(2, 30)])
    roots = spark.createDataFrame([(b, 1) for b in range(2, 30)], "class bigint, root bigint")
    assert near_dedup._next_buckets(compared, roots, scratch, 1, 85).count() == 0
    assert spark.read.parquet(f"{scratch.folder}/keyed-1").count() == 0


def test_prefixes_meet_wherever_two_sets_are_similar():
    draw = random.Random(9)
    linked = 0
    for _ in range(6000):
        centre = set(range(draw.randrange(6, 60)))
        pool = list(range(-20, len(centre)))
        x, y = (centre ^ set(draw.sample(pool, draw.randrange(0, min(len(pool), 14)))) for _ in range(2))
        if draw.random() < 0.7:
            y = x ^ set(draw.sample(pool, draw.randrange(0, 5)))
        if not x or not y or x == y or 100 * len(x & y) < 85 * len(x | y):
            continue
        parts = []
        for own in (x, y):
            rest = sorted(own - centre) + sorted(centre - own)
            near, far_len, near_len = near_dedup.prefix_lengths(len(centre), len(own), len(rest), 85)
            assert near == (100 * len(own & centre) >= 85 * len(own | centre))
            parts.append((near, set(rest[:far_len]), set(rest[:near_len])))
        (xn, xf, xnear), (yn, yf, ynear) = parts
        if xn and yn:
            continue
        linked += 1
        assert (xf & yf) if not xn and not yn else (xf & ynear) if xn else (yf & xnear)
    assert linked > 100


def test_signature_fills_every_bin_and_agrees_like_the_sets():
    draw = random.Random(2)
    hashes = WordHashes()
    agree = []
    for _ in range(200):
        words = [f"w{draw.randrange(10**6)}" for _ in range(40)]
        other = [*words[:-3], "a", "b", "c"]
        x, y = (near_dedup.shingle_set(" ".join(w).encode(), hashes) for w in (words, other))
        both = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        agree.append((near_dedup.signature(x) == near_dedup.signature(y)).mean() - both)
    assert abs(np.mean(agree)) < 0.02
    small = near_dedup.shingle_set(BASE.encode()[:30], hashes)
    assert set(near_dedup.signature(small).tolist()) <= set(small.tolist())
