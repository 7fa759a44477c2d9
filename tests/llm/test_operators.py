"""Operators against brute force, on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import BASE, no_docs, odd_docs, odd_rows
from voxdesk.llm import (
    components,
    decontamination,
    language,
    licenses,
    line_dedup,
    mixing,
    quality,
    sharding,
    simhash,
    substrings,
    warc,
)
from voxdesk.llm.common import Scratch

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# SimHash


def plain_fingerprint(text):
    words = WORD.findall(ascii_lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}


def plain_near_duplicates(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    links = [
        (i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4
    ]
    groups = plain_components(links, range(len(rows)))
    least = defaultdict(list)
    for i, g in groups.items():
        if rows[i][0] is not None:
            least[g].append(rows[i][0])
    return Counter((rows[i][0], prints[i], min(least[g], default=None)) for i, g in groups.items())


def found_near_duplicates(df, scratch):
    return Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(df, scratch).collect())


def test_simhash_equals_brute_force(spark, scratch):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert found_near_duplicates(documents(spark), scratch) == plain_near_duplicates(rows)


def test_simhash_odd_rows(spark, scratch):
    assert found_near_duplicates(odd_docs(spark), scratch) == plain_near_duplicates([r[:2] for r in odd_rows()])


@pytest.mark.parametrize("block", [3, 10**6])
def test_trees_lose_no_pair(spark, scratch, monkeypatch, block):
    draw = random.Random(1)
    values = set()
    for _ in range(120):
        centre = draw.getrandbits(64)
        for _ in range(4):
            value = centre
            for _ in range(draw.randrange(4)):
                value ^= 1 << draw.randrange(64)
            values.add(value)
    values = sorted(values)
    monkeypatch.setattr(simhash, "LEAF_ROWS", 16)
    monkeypatch.setattr(simhash, "CELLS", 64)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block * 16)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "fp long"), scratch).collect()
    got = plain_components([(r["a"] % 2**64, r["b"] % 2**64) for r in links], values)
    pairs = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert all((r["a"] % 2**64, r["b"] % 2**64) for r in links)
    assert got == plain_components(pairs, values)


def test_components_of_a_chain_and_a_star(spark, scratch):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (5, 4)]
    found = components.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()
    assert {r["u"]: r["v"] for r in found} == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 50)}


# Decontamination


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))


def plain_contamination(docs, items):
    out = Counter()
    windows = defaultdict(set)
    for key, text in items:
        w = plain_words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add(key)
    for doc, text in docs:
        w = plain_words(text)
        hit, names = set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                found = windows.get(tuple(w[k : k + size]))
                if found:
                    hit.update(range(k, k + size))
                    names |= found
        listed = sorted("null" if n is None else str(n) for n in names)
        digest = hashlib.sha256(",".join(listed).encode()).hexdigest()
        out[doc, len(w), len(hit), len(listed), digest, bool(hit)] += 1
    return out


ITEMS = [(1, BASE), (2, "one"), (None, "a b a"), (3, None), (4, "--- !!"), (10, BASE.upper()), (5, "fox jumps OVER")]


@pytest.mark.parametrize("chunk", [5, 10**6])
def test_contamination_equals_brute_force(spark, scratch, monkeypatch, chunk):
    monkeypatch.setattr(decontamination, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(decontamination, "SEGMENT_BYTES", 300)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    index = decontamination.build_index(odd_docs(spark), scratch, "doc_id", "text")
    rows = decontamination.contamination(decontamination.find(index, items)).collect()
    assert Counter(tuple(r) for r in rows) == plain_contamination([r[:2] for r in odd_rows()], ITEMS)


def test_proximity_matches(spark, scratch):
    texts = [(1, "red cat and blue dog"), (2, "red very old cat blue dog"), (3, "dog red cat"), (4, "red cat blue")]
    items = spark.createDataFrame([(1, "red cat blue dog")], "item_id long, text string")
    index = decontamination.build_index(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), scratch, "doc_id", "text")
    for slack, want in ((0, []), (1, [1]), (2, [1, 2])):
        rows = decontamination.find(index, items, slack=slack).where(F.size("starts") > 0).collect()
        assert sorted(r["id"] for r in rows) == want


def test_no_items_and_no_documents(spark, scratch):
    items = spark.createDataFrame([], "item_id long, text string")
    index = decontamination.build_index(odd_docs(spark), scratch, "doc_id", "text")
    assert not any(r["contaminated"] for r in decontamination.contamination(decontamination.find(index, items)).collect())
    assert decontamination.drop_contaminated(no_docs(spark), items, Scratch(spark, "t")).count() == 0


# Line dedup


def plain_removed(rows):
    ordered = sorted({(d is None, d or 0, t) for d, t in rows if t is not None}, key=lambda x: x[:2])
    seen, out = [], defaultdict(list)
    for missing, d, t in ordered:
        for k, line in enumerate(t.split("\n")):
            words = set(WORD.findall(line.lower()))
            if not words:
                continue
            if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                out[None if missing else d, t].append(k)
            seen.append(words)
    return out


def test_line_dedup_equals_brute_force(spark, scratch):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    found = {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_counts(documents(spark), scratch).collect()}
    want = plain_removed(rows)
    assert found == {d: ",".join(map(str, want[d, t])) for d, t in rows}


def test_line_dedup_odd_rows(spark, scratch):
    rows = Counter((r["doc_id"], r["n_lines"], r["removed_lines"]) for r in line_dedup.line_counts(odd_docs(spark), scratch).collect())
    want = plain_removed([r[:2] for r in odd_rows()])
    lines = lambda t: len(t.split("\n")) if t is not None else 0
    assert rows == Counter((d, lines(t), ",".join(map(str, want[d, t]))) for d, t, *_ in odd_rows())
    kept = line_dedup.drop_lines(odd_docs(spark), Scratch(spark, "t"))
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_rows())


# WARC


def test_warc_round_trip(spark, scratch):
    html = ["<p>x</p>", "<p>x</p>", None, "", "long " * 200_000, "<p>é</p>", "<p>x</p>"]
    pages = [(9 - k, f"http://h/{k}%0A", h) for k, h in enumerate(html)] + [(None, None, "<p>x</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    bundles = warc.write_bundles(df, scratch)
    rows = {r["page_id"]: r for r in warc.read_bundles(bundles).collect()}
    assert len(rows) == len(pages) and all(r["payload_ok"] for r in rows.values())
    for page, url, h in pages:
        body = (h or "").encode()
        same = [p for p, _, x in pages if (x or "").encode() == body and p is not None]
        first = min(same)
        old = first if page is None or page > first else None
        r = rows[page]
        assert (r["payload_bytes"], r["payload_digest"], r["target_uri"]) == (len(body), warc.digest_of(body), url)
        assert (r["record_type"], r["refers_to"]) == ("revisit" if old is not None else "response", old)
    bundle = bundles.where("size(entries) > 1").first()
    entry = bundle["entries"][1]
    fields, _ = warc.read_record(bytes(bundle["content"]), entry["frame"], entry["offset"], entry["length"])
    assert fields[b"WARC-Record-ID"] == f"<urn:record:{entry['record']}>".encode()


# Licences


def test_licences(spark):
    texts = [
        (1, "Some text.\nReleased under the MIT License.\nMore text of the day."),
        (2, "This work is licensed under the GNU General Public License, version 3."),
        (3, "Of the and in.\nThe licence of the tree was under the old house."), (4, None), (5, ""),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = licenses.learn(documents(spark))
    rows = {r["doc_id"]: r for r in licenses.summary(licenses.scan(docs, model)).collect()}
    assert [rows[k]["families"] for k in range(1, 6)] == ["mit", "gpl", "", "", ""]
    assert rows[1]["n_paragraphs"] == 3 and rows[4]["n_paragraphs"] == 0


def test_licence_classifier_on_held_out_crops(spark):
    model = licenses.learn(documents(spark))
    examples = licenses.crops(np.random.default_rng(99))
    best = model.line_probabilities([w for w, _ in examples])[:, 1:].argmax(axis=1)
    right = sum(model.families[b + 1] == f for b, (_, f) in zip(best, examples, strict=True))
    assert right / len(examples) > 0.95


# Quality


def plain_stats(text):
    words = WORD.findall(text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if counts[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)), len(hit),
    )


def test_quality_statistics(spark):
    for text in [r["text"] for r in documents(spark).collect()] + [r[1] for r in odd_rows()]:
        assert quality.text_stats(text.encode() if text is not None else None)[:5] == plain_stats(text)


def test_quality_keeps_clean_documents(spark, scratch):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored, _, threshold = quality.rate(docs, labels, scratch)
    rows = quality.verdict(scored, threshold).withColumnRenamed("id", "doc_id").join(labels, "doc_id").where("NOT base_failed").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) / len(clean) >= 0.99 and sum(bad) / len(bad) < 0.5


def test_quality_odd_rows(spark, scratch):
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None), (99, 0)], "doc_id long, quality int")
    docs = odd_docs(spark)
    kept = quality.keep_clean(docs, labels, scratch)
    assert kept.columns == docs.columns and kept.count() == 1  # the one text of 50 words or more
    assert quality.keep_clean(no_docs(spark), labels, Scratch(spark, "t")).count() == 0


# Language


def test_probabilities_sum_to_one():
    models = language.fit({"x": language.count_grams(["abracadabra banana"]), "y": language.count_grams(["cabbage bad"])})
    alphabet = sorted(set("abracadabra banana cabbage bad"))
    for context in ("abr", "ban", " ba", "zzz"):
        data = [language.prepared([context + c])[0] for c in alphabet]
        total = sum(np.exp(models.log_probs(d)[-1]) for d in data)
        assert total == pytest.approx(1, abs=0.2)


def test_language_on_the_held_out_fold(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = language.learn(docs, scratch, "doc_id", "text", "lang")
    found = language.identify(docs, models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    odd = {r["doc_id"]: r for r in language.identify(odd_docs(spark).where("doc_id IS NOT NULL"), models).collect()}
    assert [odd[k]["lang_pred"] for k in (4, 5, 6)] == ["und"] * 3 and odd[3]["lang_pred"] == "en"
    nothing = language.learn(no_docs(spark), Scratch(spark, "t"), "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language.identify(odd_docs(spark), nothing).collect()} == {"und"}


# Substring dedup


def plain_kept(rows):
    ordered = sorted({(d is None, d or 0, t) for d, t in rows if t}, key=lambda x: x[:2])
    seen, out = set(), {}
    for missing, d, t in ordered:
        words = WORD.findall(t)
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out[None if missing else d, t] = len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


EMPTY = (0, 0, hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("hot", [1, 10**6])
def test_substring_dedup_equals_brute_force(spark, scratch, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_ROWS", hot)
    rows = [r[:2] for r in odd_rows()] + [(20 + k, f"x{k} {BASE} y{k} {BASE}") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Counter(tuple(r) for r in substrings.without_repeats(df, scratch).collect())
    want = plain_kept(rows)
    assert found == Counter((d, *want.get((d, t), EMPTY)) for d, t in rows)


def test_no_documents(spark, scratch):
    assert substrings.without_repeats(no_docs(spark), scratch).count() == 0
    assert simhash.near_duplicates(no_docs(spark), Scratch(spark, "t")).count() == 0
    assert line_dedup.line_counts(no_docs(spark), Scratch(spark, "t")).count() == 0
    assert mixing.taken_words(no_docs(spark), Scratch(spark, "t")).count() == 0
    assert sharding.assign(no_docs(spark), Scratch(spark, "t"), 4).count() == 0


# Sharding


def test_shards_are_even_and_slots_gapless(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.assign(docs, scratch, 8).collect()
    sizes, slots, by_text = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += len(r["text"].encode()) + 1
        slots[r["shard"]].append(r["slot"])
        by_text[r["text"]].add(r["shard"])
    mean = sum(sizes.values()) / 8
    assert len(rows) == 1000 and all(abs(s - mean) < 0.05 * mean for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_of_odd_rows_and_one_text(spark, scratch):
    docs = odd_docs(spark)
    out = sharding.assign(docs, scratch, 3)
    assert out.columns == [*docs.columns, "shard_", "slot"] and out.count() == len(odd_rows())
    same = spark.createDataFrame([(k, "equal text") for k in range(400)], "doc_id long, text string")
    sizes = Counter(r["shard"] for r in sharding.assign(same, Scratch(spark, "t"), 8).collect())
    assert len(sizes) == 8 and max(sizes.values()) <= 60


# Mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == pytest.approx([50, 100, 150])
    assert mixing.targets([10, 100, 90], [3, 1, 1]) == pytest.approx([30, 85, 85])
    assert mixing.targets([0, 0], [1, 2]) == [0, 0]


def test_permutations_reach_every_index():
    for size in (1, 2, 7, 64, 1000):
        out = mixing.permuted(np.arange(size), np.full(size, size), np.full(size, 12345))
        assert sorted(out.tolist()) == list(range(size))


def test_mix_reaches_its_targets(spark, scratch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.taken_words(docs, scratch).join(docs.select(F.col("doc_id").alias("id"), "source", "text"), "id").collect()
    taken, target, words = Counter(), {}, Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(r["text"])) and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        words[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    names = sorted(words, key=str.encode)
    want = mixing.targets([words[n] for n in names], [1 + k % 3 for k in range(len(names))])
    assert [target[n] for n in names] == pytest.approx(want)
    assert all(abs(taken[n] - target[n]) <= 2 * mixing.BLOCK_WORDS for n in names)
    again = {r["id"]: r["taken"] for r in mixing.taken_words(docs.repartition(5), Scratch(spark, "t")).collect()}
    assert again == {r["id"]: r["taken"] for r in rows}


def test_mixed_documents_hold_the_taken_words(spark, scratch):
    docs = odd_docs(spark)
    taken = sum(r["taken"] for r in mixing.taken_words(docs, scratch).collect())
    mixed = mixing.mixed_documents(docs, Scratch(spark, "t"))
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(WORD.findall(r["text"])) for r in rows) == taken
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
