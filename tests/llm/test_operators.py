"""Operators against brute force on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import components, decontaminate, licenses, line_dedup, mixing, quality, quality_rules, sharding, simhash, url_filter, warc
from quern.llm.common import n_words, new_path

WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Originals, near copies and exact copies."""
    rng = random.Random(5)
    out = [prose(rng, rng.randint(1, 200)) for _ in range(150)]
    for t in out[:60]:
        words = t.split()
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        out.append(" ".join(words))
    return out + out[:30] + ["", None, "W1  w2\tW3"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, f"s{i % 5}" if i % 7 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")


def simhash_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_components(docs, texts):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = [simhash_by_hand(t) for t in texts]
    assert [rows[i]["fp"] & (1 << 64) - 1 for i in range(len(texts))] == fps
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert [rows[i]["component_id"] for i in range(len(texts))] == roots(len(texts), links)


@pytest.mark.parametrize("n", [1, 2, 9, 700])
def test_gray_index_joins_exactly_what_is_near(n):
    rng = np.random.default_rng(n)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64), axis=1)
    fps = np.unique(centres[rng.integers(0, 12, n)] ^ flips)
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    fps = fps[np.argsort(rank)]
    i, root = simhash.index_links(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    want = roots(len(fps), list(zip(*np.nonzero(near), strict=True)))
    got = roots(len(fps), list(zip(i.tolist(), root.tolist(), strict=True)))
    assert got == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_one_of_each_group_stays(docs, texts):
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {r["doc_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] == r["component_id"]}


def test_rows_are_told_apart_by_id_and_text(spark):
    """A doc_id may repeat: a text that resembles nothing else stays, and of copies one row does."""
    t, u, v = (prose(random.Random(k), 60) for k in (1, 2, 3))
    keep = lambda rows: sorted(simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=str)
    assert keep([(1, t), (5, t), (5, u)]) == sorted([(1, t), (5, u)], key=str)
    assert keep([(None, t), (None, t), (7, t), (None, u)]) == sorted([(7, t), (None, u)], key=str)
    assert len(keep([(2, None), (1, ""), (3, " \n")])) == 1


def test_kept_rows_by_brute_force(spark):
    rng = random.Random(21)
    pool = [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    pool += [t + " w1" for t in pool[:30]] + [None, ""]
    rows = [(rng.choice([None, *range(40)]), rng.choice(pool), rng.choice("ab")) for _ in range(400)]
    fps = [simhash_by_hand(t) for _, t, _ in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {}
    for k, (i, t, _) in enumerate(rows):
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        place = (i is None, i or 0, signed(fps[k]), signed(xxhash.xxh64_intdigest((t or "").encode(), 42)))
        want[root[k]] = min(want.get(root[k], (place, i, t or "")), (place, i, t or ""))
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, h string, _q_id int")
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str) == sorted(((i, t) for _, i, t in want.values()), key=str)


def test_leaks_by_brute_force(spark):
    rng = random.Random(3)
    items = [prose(rng, rng.randint(3, 60)) for _ in range(30)]
    rows = []
    for i in range(120):
        words = prose(rng, rng.randint(0, 150)).split()
        if i % 2:
            leak = rng.choice(items).split()
            if i % 3 == 0:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() + "," if i % 4 == 3 else w for w in leak]
        rows.append((i, " ".join(words)))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}

    def grams(words):
        k = min(5, len(words))
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    split = lambda t: re.findall(r"\w+", t.lower())
    df = Counter(g for t in items for g in grams(split(t)))
    want = {}
    for i, t in rows:
        words = split(t)
        for j, item in enumerate(items):
            own = split(item)
            weight = {g: np.log1p(len(items) / df[g]) for g in grams(own)}
            k, best = min(5, len(own)), 0.0
            for at in range(max(1, len(words) - len(own) + 1)):
                part = words[at : at + len(own)]
                have = {tuple(part[x : x + k]) for x in range(len(part) - k + 1)}
                best = max(best, sum(weight[g] for g in have if g in weight) / sum(weight.values()))
            if best >= 0.8:
                want[i, j] = best
    assert got.keys() == want.keys() and len(want) > 40
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_items_that_share_an_instruction_are_all_found(spark):
    """Documents hold only the item's own words, of which the shared instruction is no part."""
    rng = random.Random(7)
    shared, own = prose(rng, 40), [prose(rng, 50) for _ in range(400)]
    d = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    b = spark.createDataFrame([(i, f"{shared} {t}") for i, t in enumerate(own)], "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(400)]
    assert all(r["similarity"] >= 0.8 for r in got)


def test_a_text_under_half_an_item_can_hold_it(spark):
    """Of 100 words, 55 are an instruction that all items share; the other 45 hold most of the weight."""
    rng = random.Random(8)
    shared, own = prose(rng, 55), [prose(rng, 45) for _ in range(300)]
    d = spark.createDataFrame([*enumerate(own[:20]), (20, shared), (21, " ".join(own[0].split()[:30]))], "doc_id long, text string")
    b = spark.createDataFrame([(i, f"{shared} {t}") for i, t in enumerate(own)], "item_id long, text string")
    got = decontaminate.contaminated(d, b).collect()
    assert sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_words"]) for r in got) == [(i, i, 0, 45) for i in range(20)]
    assert all(0.8 <= r["similarity"] < 0.81 for r in got)


def best_by_hand(words, own, weight):
    """Largest share of an item's weight that a window of its length holds, by sliding over the words."""
    k, total = min(5, len(own)), sum(weight.values())
    grams = [tuple(words[x : x + k]) for x in range(len(words) - k + 1)]
    reach, have, value, best = min(len(own), len(words)) - k + 1, Counter(), 0.0, 0.0
    for x, g in enumerate(grams):
        if g in weight:
            have[g] += 1
            value += weight[g] if have[g] == 1 else 0.0
        if x >= reach and grams[x - reach] in weight:
            have[grams[x - reach]] -= 1
            value -= weight[grams[x - reach]] if have[grams[x - reach]] == 0 else 0.0
        best = max(best, value / total)
    return best


def leaks_by_hand(rows, items):
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w: {tuple(w[i : i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)}
    items = {j: split(t) for j, t in set(items) if split(t)}
    df = Counter(g for w in items.values() for g in grams(w))
    weight = {j: {g: np.log1p(len(items) / df[g]) for g in grams(w)} for j, w in items.items()}
    found = set()
    for i, t in rows:
        words = split(t)
        have = {k: {tuple(words[x : x + k]) for x in range(len(words) - k + 1)} for k in range(1, 6)}
        for j, own in items.items():
            likely = sum(v for g, v in weight[j].items() if g in have[min(5, len(own))]) >= 0.79 * sum(weight[j].values())
            if likely and best_by_hand(words, own, weight[j]) >= 0.8 - 1e-9:
                found.add((i, j))
    return found


def test_repeats_short_texts_and_graded_edits_are_all_found(spark):
    """Items that repeat themselves, texts shorter than an item, and 0 to 12 words changed; no match is lost or added."""
    rng = random.Random(17)
    items = [(j, prose(rng, rng.randint(20, 60))) for j in range(25)] + [(25, "a b c d e f " * 10), (26, "x y z"), (26, "x y z"), (27, None)]
    rows = [(0, "a b c d e f a b c d e"), (0, "X, y; Z!"), (1, None), (2, ""), (3, "a b c")]
    for n in range(13):
        for j, text in items[:25]:
            words = text.split()
            for at in rng.sample(range(len(words)), n):
                words[at] = "edited"
            rows.append((1000 + 100 * n + j, " ".join([*prose(rng, rng.randint(0, 30)).split(), *words[: len(words) - rng.choice([0, 0, 5])]])))
    want = leaks_by_hand(rows, items)
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and {(0, 25), (0, 26)} <= want and 40 < len(want) < 300


def test_no_leak_of_a_whole_table_is_lost(spark):
    """All documents of the small tables against the whole benchmark."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = leaks_by_hand([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == want and want


def test_a_large_benchmark_is_dealt_to_several_indexes(spark):
    rng = random.Random(4)
    items = [prose(rng, 30) for _ in range(20)]
    d = spark.createDataFrame([(i, prose(rng, 20) + " " + t) for i, t in enumerate(items)], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    key = lambda df: sorted((r["doc_id"], r["item_id"], r["first_word"]) for r in df.collect())
    assert key(decontaminate.contaminated(d, b, index_words=100)) == key(decontaminate.contaminated(d, b)) == [(i, i, 20) for i in range(20)]
    assert decontaminate.keep_clean(d, b, index_words=100).count() == 0


def test_repeat_words_by_hand():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abc").encode() for _ in range(rng.randint(0, 14))]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(3)}
        assert quality_rules.repeat_words(words) == len(covered)


def test_line_rules():
    assert not quality_rules.line_fails("A plain sentence of some words.")
    for bad in ("no mark at its end", "Home | News | Sport | About us.", "### $$$ *** buy.", "ALL OF THIS SHOUTS AT YOU.", "Please accept cookies to go on.", "go " * 12 + "go.", "ÜBER ALLE ŽABY.", "Alle Rechte vorbehalten.", "Tous droits réservés.", "Aviso legal."):
        assert quality_rules.line_fails(bad), bad


def test_cleaning_keeps_good_lines(spark):
    good = "\n".join(f"Sentence{i} has{i} a{i} few{i} good{i} words." for i in range(10))
    df = spark.createDataFrame([(1, good + "\nHome | News | Sport | More"), (2, "menu item\n" * 60)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in quality_rules.clean(df).collect()}
    assert rows[1]["kept"] and rows[1]["clean"] == good
    assert not rows[2]["kept"]


def test_windows_of_lines(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\nb\n\nc \nd\ny"), (3, "b\nc\nd\ne"), (4, "a\nb"), (5, "q\nr\ns\nq\nr\ns"), (6, " a\n\nb"), (7, "b\na"), (8, "One."), (9, "One.")]
    got = {r["doc_id"]: (r["clean"], [tuple(s) for s in r["spans"] or []]) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc\nd\ne", []), 2: ("x\ny", [(1, 3)]), 3: ("", [(0, 3)]), 4: ("a\nb", []), 5: ("q\nr\ns", [(3, 5)]), 6: ("", [(0, 1)]), 7: ("b\na", []), 8: ("One.", []), 9: ("", [(0, 0)])}


def test_licences(spark):
    rows = [(1, "Some text.\nreleased under THE mit license\nmore text"), (2, "Licensed under CC BY-NC 4.0."), (3, "We like licences."), (4, None)]
    got = {r["doc_id"]: (r["license"], r["line"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 2), 2: ("CC-BY-NC-4.0", 1), 3: (None, None), 4: (None, None)}


def test_every_template_finds_itself(spark):
    rows = [(k, t.text) for k, t in enumerate(licenses.TEMPLATES)]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["license"], r["dice"]) == (licenses.TEMPLATES[r["doc_id"]].license, 1.0)


def test_notices_across_and_within_lines(spark):
    wrap = lambda t, n: "\n".join(" ".join(t.split()[i : i + n]) for i in range(0, len(t.split()), n))
    mit, gpl = licenses.BODIES[1].text, licenses.TEMPLATES[9].text
    rows = [
        (1, "About.\n\n" + wrap(licenses.BODIES[0].text, 11)), (2, wrap(gpl, 12) + "\nThe end."), (3, "See the notes at the end of the build. Released under the MIT License."),
        (4, "Copyright 2020 A. Person\n\n" + wrap(mit, 12)), (5, wrap(licenses.BODIES[2].text, 12)), (6, wrap(licenses.BODIES[3].text, 12)), (7, wrap(licenses.BODIES[4].text, 12)),
        (8, "Licensed under CC BY-NC 4.0.\nparts are released under\nthe MIT License. here"), (9, "We released the build under a license of the MIT."),
    ]
    got = {r["doc_id"]: (r["license"], r["line"], r["n_notices"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1][:2] == ("MIT", 3) and got[3] == ("MIT", 1, 1) and got[4][:2] == ("MIT", 3)
    assert [got[i][0] for i in (2, 5, 6, 7)] == ["GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "ISC"]
    assert got[8] == ("CC-BY-NC-4.0", 1, 2) and got[9] == (None, None, 0)


def test_rules_for_urls(spark):
    urls = ["http://a.org/x", "http://org/", "http://a.org", "http://forg/x", "http://m.Example.ORG/es/1", "https://example.org/en/12?x", "http://example.org/en/2", "http://b.com/de/", "http://b.com/fr/#t", "example.org/es/"]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), labels).collect()}
    assert [got[i] for i in range(len(urls))] == [
        ("a.org", "/x", "org/", "allow"), ("org", "/", "org/", "allow"), ("a.org", "", None, "allow"), ("forg", "/x", None, "allow"),
        ("m.example.org", "/es/1", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("b.com", "/de/", "com/de/", "block"), ("b.com", "/fr/", "com/fr/", "allow"), ("", "", None, "allow"),
    ]


def test_mined_combinations_block(spark):
    """Only the host and the folder together are bad."""
    rows = [(i, f"http://{h}.net/{d}/{i}") for i, (h, d) in enumerate([(h, d) for h in ("one", "two") for d in ("in", "out")] * 30)]
    bad = {i for i, u in rows if "one.net/out" in u}
    labels = spark.createDataFrame([(i, 0 if i in bad else 1) for i, _ in rows if i % 5], "doc_id long, quality int")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == bad
    assert {r["page_id"]: r["mined"] for r in got} == {i: "block" if i in bad else "allow" for i, _ in rows}


def test_deep_folders_keys_and_values_are_mined(spark):
    """Tokens deep in a path or late in a query mark bad URLs; very long paths that all URLs share cost nothing."""
    deep = "/".join(f"f{k}" for k in range(60))
    marks = ["/a/b/casino/{}", "/a/b/{}?id=1&aff=x", "/a/b/fine/{}", "/" + deep + "/{}"] * 25
    rows = [(i, "http://h.net" + m.format(i)) for i, m in enumerate(marks)]
    bad = {i for i, u in rows if "casino" in u or "aff=x" in u}
    labels = spark.createDataFrame([(i, int(i not in bad)) for i, _ in rows if i % 3], "doc_id long, quality int")
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, block_odds=2).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == bad


def test_labels_of_one_kind_teach_nothing(spark):
    pages = spark.createDataFrame([(i, f"http://h.net/{i}") for i in range(20)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, quality int")
    assert {(r["verdict"], r["mined"]) for r in url_filter.judge(pages, labels).collect()} == {("allow", None)}


def test_archives_round_trip(spark):
    html = ["<p>" + c * 200 for c in "aabca"] + ["short", "short", "", None, "ü" * 300]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    path = new_path(spark, "warc-test")
    index = warc.write(pages, path)
    rows = {r["page_id"]: r for r in warc.read(index, path).collect()}
    first = {h: min(10 - j for j, x in enumerate(html) if x == h) for h in html}
    for i, h in enumerate(html):
        r, body = rows[10 - i], (h or "").encode()
        revisit = len(body) >= 100 and first[h] != 10 - i
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"]) == (len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response")
        assert r["refers_to"] == (first[h] if revisit else None)
        assert r["payload"] == (None if revisit else h or "")
    some = index.where("page_id in (3, 7)")
    assert {r["page_id"] for r in warc.read(some, path).collect()} == {3, 7}


def test_ranges_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (100, 1), (500, 2)], gap=85) == [(0, 101, [(0, 10), (10, 5), (100, 1)]), (500, 502, [(500, 2)])]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 != 0
        words = prose(rng, rng.randint(5, 120))
        rows.append((i, words + "." if good else words.upper().replace(" ", "!! ")))
        labels.append((i, int(good)))
    found = quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found)


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, f"text {i} " + ("good words here" if i % 3 else "BAD!! WORDS!!")) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda flip: spark.createDataFrame([(i, int((i % 3 > 0) != (flip and zlib.crc32(str(i).encode()) % 4 == 2))) for i, _ in rows], "doc_id long, quality int")
    score = lambda l: sorted((r["doc_id"], r["score"]) for r in quality.judge(df, l).collect())
    assert score(label(False)) == score(label(True))


def test_interactions_in_linear_time():
    m = quality.FactorisationMachine()
    m.w = np.random.default_rng(0).normal(size=m.w.shape)
    columns, values = np.array([3, 10, 77, 500]), np.array([0.5, 1.0, 0.2, 0.9])
    pairs = sum(m.v[columns[i]] @ m.v[columns[j]] * values[i] * values[j] for i in range(4) for j in range(i))
    assert abs(m.raw(columns, values) - (m.w[columns] @ values + pairs)) < 1e-12


def test_features_by_hand():
    columns, values = quality.features(b"Go go go! 12\n\nGo go")
    want = Counter(zlib.crc32(w) % quality.BUCKETS for w in b"Go go go! 12 Go go".split())
    words = {int(c): v for c, v in zip(columns, values, strict=True) if c < quality.BUCKETS}
    assert words == {c: n / 6.0 for c, n in want.items()}
    shapes = values[columns >= quality.BUCKETS]
    chars = 19
    assert np.allclose(shapes, [1.0, 2 / chars, 0.0, 2 / chars, min(1, 4 / chars), min(1, 10 / chars), chars / 6 / 20, 4 / 6, 2 / 6, 0.0, 0.0, np.log1p(6) / 20])
    assert np.array_equal(quality.features(None)[1], quality.features(b"")[1])


def test_a_step_follows_the_slope_of_the_log_loss():
    """One Adam step moves every parameter by the rate against the sign of a numeric derivative."""
    rng = np.random.default_rng(3)
    rows = [(np.array(sorted(rng.choice(40, 5, replace=False))), rng.random(5)) for _ in range(12)]
    y = rng.integers(0, 2, 12).astype(float)

    def loss(m):
        p = np.array([1 / (1 + np.exp(-m.raw(c, x))) for c, x in rows])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 5e-6 * ((m.w**2).sum() + (m.v**2).sum())

    m, start = quality.FactorisationMachine(), quality.FactorisationMachine()
    m.fit(rows, y, epochs=1, rate=0.01)
    assert not m.w[100:].any() and not m.v[100:].any()  # columns that no row has
    one, two, three = (int(rows[k][0][0]) for k in (0, 4, 9))
    for name, at in [("w", (one,)), ("w", (two,)), ("v", (one, 0)), ("v", (two, 3)), ("v", (three, 2))]:
        ends = []
        for step in (1e-6, -1e-6):
            near = quality.FactorisationMachine()
            getattr(near, name)[at] += step
            ends.append(loss(near))
        slope = (ends[0] - ends[1]) / 2e-6
        moved = getattr(m, name)[at] - getattr(start, name)[at]
        assert abs(moved + 0.01 * np.sign(slope) * abs(slope) / (abs(slope) + 1e-8)) < 1e-4


def test_scores_by_brute_force(spark):
    """A fitted model's scores against all pairs of columns, one by one."""
    rows = [(i, f"text {i} " + ("good words here." if i % 3 else "BAD!! WORDS!!")) for i in range(60)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "doc_id long, quality int")
    m = quality.fit(df, labels)
    got = {r["doc_id"]: r["score"] for r in quality.judge(df, labels).collect()}
    for i, t in rows[::7] + rows[-1:]:
        c, x = quality.features((t or "").encode())
        z = m.w[c] @ x + sum(m.v[c[a]] @ m.v[c[b]] * x[a] * x[b] for a in range(len(c)) for b in range(a))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9


def test_shards(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(1, 60)) for _ in range(3000)] + ["one hot text " * 8] * 1500 + ["a small group"] * 40
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard(rows).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    sizes, slots, groups = Counter(), {}, {}
    for r in got:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(text.encode()) + 1, zlib.crc32(text.encode()), "bytes")
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        groups.setdefault(text, set()).add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) == set(range(16)) and max(sizes.values()) < 1.06 * sum(sizes.values()) / 16
    assert len(groups["a small group"]) == 1 and len(groups["one hot text " * 8]) > 3


def test_shards_by_brute_force(spark):
    """Shards and slots follow one sorted list of all rows, and each shard begins where that list comes nearest to its share,
    as near as a range or the slack for equal texts allows."""
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(0, 90)) for _ in range(2500)] + [prose(rng, 30)] * 300 + [None, "", "w " * 3000]
    rows = [(rng.choice([None, *range(5000)]), t) for t in texts]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, i) for i, t in rows)
    placed = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["doc_id"], r["size"]) for r in placed] == [(i, size) for _, _, size, i in order]
    total, reach, at = sum(o[2] for o in order), max(o[2] for o in order), 0
    for k in range(1, 8):
        at = sum(r["size"] for r in placed if r["shard"] < k)
        assert abs(at - k * total / 8) <= total / 8 * (2 / 64 + 0.02) + reach


def test_rows_that_repeat_id_and_text_are_divided(spark):
    df = spark.createDataFrame([(7, "the very same row " * 5)] * 4000 + [(None, "x")] * 4000, "doc_id long, text string")
    sizes = Counter()
    for r in sharding.shard(df, 8).collect():
        sizes[r["shard"]] += r["size"]
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 1.1 * sum(sizes.values()) / 8


def test_written_shards_hold_the_planned_rows(spark, docs):
    path = new_path(spark, "shards-test")
    sharding.write_shards(docs.withColumn("_q_h", F.lit("clash")), path, 4)
    back = spark.read.parquet(path)
    assert back.columns == [*docs.columns, "_q_h", "slot", "shard"]
    key = lambda df: sorted((r["doc_id"], r["shard"], r["slot"]) for r in df.collect())
    assert key(back) == key(sharding.shard(docs, 4))
    assert sorted((r["doc_id"], r["text"]) for r in back.collect() if r["text"]) == sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["text"])


def fill(sizes):
    """Targets by sharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * unit >= 3 * sizes[s]}
        if not full:
            return target | {s: weight[s] * unit for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix(docs, texts):
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    rows = mixing.mix(sized).collect()
    assert sorted(rows) == sorted(mixing.mix(sized.repartition(7)).collect())
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    want, taken = fill(sizes), Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 220 for s in want)


@pytest.mark.parametrize("varied", [range(26, 64, 2), range(50, 62)])
def test_large_groups_are_dealt_again_and_lose_no_link(spark, varied):
    rng = np.random.default_rng(5)
    bits = np.array(list(varied), np.uint64)
    near = (rng.integers(0, 2, (600, len(bits))).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64) ^ np.uint64(0xF0F0F0F0)
    fps = np.unique(np.r_[near, rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    rows = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    at = {f: k for k, f in enumerate(fps.view(np.int64).tolist())}
    links = [(at[r["a"]], at[r["b"]]) for r in simhash.near_links(rows, most=150).collect()]
    want = [(k, int(j)) for k, f in enumerate(fps) for j in np.flatnonzero(np.bitwise_count(fps[:k] ^ f) <= 3)]
    assert roots(len(fps), links) == roots(len(fps), want)
    assert simhash.dealt(rows, 150).groupBy("free", "fixed").count().agg({"count": "max"}).first()[0] <= 150


def test_a_labelled_id_that_repeats_gives_the_fit_one_row(spark, monkeypatch):
    rows = [(1, prose(random.Random(i), 30), 1) for i in range(500)] + [(i, prose(random.Random(i), 30), i % 2) for i in range(2, 60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame(sorted({(r[0], r[2]) for r in rows}), "doc_id long, quality int")
    given = []
    monkeypatch.setattr(quality.FactorisationMachine, "fit", lambda self, x, y: given.append((list(map(lambda v: tuple(v[0].tolist()), x)), y.tolist())))
    for most in (3000, 3000, 20):
        quality.fit(docs, labels, most)
    taught = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(1, 60))
    assert [len(x) for x, _ in given] == [taught, taught, 20]
    assert given[0] == given[1]


def test_mined_rules_grow_with_depth_and_not_with_its_subsets(spark):
    counts = []
    for depth in (8, 32):
        urls = []
        for i in range(600):
            at = i % depth + 1  # folders a0/a1/... of every depth, so each folder has rows of its own
            urls.append((f"http://h.org/{'/'.join(f'a{k}' for k in range(at))}/f.html?q=x{i % 3}", i % 10 != 0))
        df = spark.createDataFrame(urls, "url string, bad boolean")
        labelled = df.select(url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"), "bad")
        rules = url_filter.mine(labelled, block_odds=1, allow_odds=1).collect()
        counts.append(len(rules))
        for r in rules:
            kinds = [re.match("dir|scheme|host|domain|part|query|pair|", p[0]).group() for p in r["parts"]]
            assert sum(k == "dir" for k in kinds) <= 1 and sum(k in ("scheme", "host", "domain", "part") for k in kinds) <= 1 and sum(k in ("query", "pair") for k in kinds) <= 1
    assert 0 < counts[1] < 6 * counts[0]


def test_mined_supports_are_those_of_the_urls(spark):
    rng = random.Random(4)
    rows = [(f"http://{rng.choice(['a', 'b.a', 'c'])}.org/{rng.choice(['x', 'y'])}/{rng.choice(['u', 'v'])}/p.html{rng.choice(['', '?k=z', '?k=w&m=n'])}", rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "url string, bad boolean")
    labelled = df.select(url_filter.tokens(F.col("url"), url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))).alias("tokens"), "bad")
    rules, seen = url_filter.mine(labelled, block_odds=1, allow_odds=1).collect(), labelled.collect()
    assert len(rules) > 20
    for r in rules:
        own = [x["bad"] for x in seen if all(set(p) & set(x["tokens"]) for p in r["parts"])]
        good = r["verdict"] == "allow"
        assert r["support"] == pytest.approx(sum(b != good for b in own) / len(seen)) and r["confidence"] == pytest.approx(sum(b != good for b in own) / len(own))


def test_sentences_that_merely_have_such_words_stay():
    for good in ("The mill was powered by water until the fire of 1911.", "The company uses cookies made by a local baker."):
        assert not quality_rules.line_fails(good)
    for bad in ("This site uses cookies.", "By going on you accept our privacy policy and the terms of use.", "© 2020 Smith. All rights reserved.", "Diese Seite verwendet Cookies."):
        assert quality_rules.line_fails(bad)
    assert not quality_rules.is_boilerplate("log in to, log in to and what else there is to say of it all, at length", 17, quality_rules.phrases())
