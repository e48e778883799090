"""Exact dedup, SimHash and line dedup against brute force."""

import hashlib
import itertools
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from sensorframe.llm import components, exact_dedup, line_dedup, simhash

WHITE = r"[\x20\x09-\x0D]+"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, kept string").repartition(4)


def sample_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("fan,slot_rows", [(2, 10), (4, 50), (4, 50_000)])
def test_exact_groups(spark, sf_dir, fan, slot_rows):
    docs = sample_docs(spark, sf_dir)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[re.sub(WHITE, " ", r.text)].append(r.doc_id)
    expected = {
        i: (min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest())
        for t, ids in groups.items()
        for i in ids
    }
    found = exact_dedup.exact_dedup(docs, fan=fan, slot_rows=slot_rows).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found} == expected


def test_exact_odd_rows(spark):
    rows = [(5, "a  b", "k"), (3, "a\tb", "k"), (None, "a b", "k"), (3, "a b", "k"), (7, None, None), (8, "", None)]
    rows += [(9, " " * 10_000, None), (None, "lone", None)]
    found = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    ab = [r for r in found if r.group_size == 4]
    assert {r.keep_id for r in ab} == {3} and sum(r.kept for r in ab) == 1
    assert [r.keep_id for r in found if r.doc_id in (7, 8)] == [7, 7]
    assert [(r.doc_id, r.keep_id, r.kept) for r in found if r.doc_id == 9] == [(9, 9, True)]
    assert sum(r.kept for r in found) == 4
    assert exact_dedup.exact_dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_merge_keeps_unequal_texts_of_one_digest_apart():
    one, two = ("d", 1, 1, 0, 5, 0, 1), ("d", 2, 1, 0, 4, 1, 1)
    assert list(exact_dedup.merge_runs([iter([one]), iter([two]), iter([one])])) == [("d", 1, 1, 0, 5, 0, 2), two]


def test_runs_are_merged_page_by_page():
    read = 0

    def rows():
        nonlocal read
        for page in range(50):
            for run in (3, 8, 11):
                for digest in ("a", "b"):
                    read += 1
                    yield (2, page, run, f"{page:02}{digest}", 1, 1, 0, 100 - run, run, 2)

    merged = exact_dedup.merged_pages(rows())
    assert next(merged) == (2, 0, 2, "00a", 1, 1, 0, 89, 11, 6) and read <= 7
    rest = list(merged)
    assert len(rest) == 99 and [r[3] for r in rest] == sorted(r[3] for r in rest) and {r[-1] for r in rest} == {6}


def test_slots_follow_the_rows():
    assert [exact_dedup.slots_for(n, 4, 100) for n in (0, 400, 401, 10**6)] == [4, 4, 16, 16384]


def brute_fingerprint(text, size=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, distance=4):
    least = {}
    names = sorted(fps, key=lambda i: (i is None, i))
    left = set(names)
    while left:
        start = min(left, key=lambda i: (i is None, i))
        group, queue = {start}, [start]
        left.discard(start)
        while queue:
            one = queue.pop()
            near = {i for i in left if bin(fps[i] ^ fps[one]).count("1") <= distance}
            left -= near
            group |= near
            queue += near
        for i in group:
            least[i] = start
    return least


def test_simhash_whole_table(spark, sf_dir):
    docs = sample_docs(spark, sf_dir)
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    found = simhash.near_duplicates(docs).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r.doc_id: r.component_id for r in found} == brute_components(fps)


def test_simhash_odd_rows(spark):
    rows = [(4, None, "k"), (2, "  ", "k"), (9, "one", "k"), (9, "one", "k"), (None, "one", None), (1, "A b C d e", None)]
    found = simhash.near_duplicates(docs_of(spark, rows)).collect()
    assert len(found) == 6
    assert {(r.doc_id, r.component_id) for r in found} == {(4, 2), (2, 2), (9, 9), (None, 9), (1, 1)}
    assert {r.fingerprint for r in found if r.doc_id in (2, 4)} == {"0" * 16}
    one = simhash.representatives(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in one) == [(1, "A b C d e"), (2, "  "), (9, "one")]
    assert simhash.near_duplicates(docs_of(spark, rows).limit(0)).count() == 0


def clustered(n, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(base)
        for _ in range(rng.randint(0, 6)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("cell_rows", [40, 20_000])
def test_links_connect_what_is_near_in_hot_cells(spark, cell_rows):
    fps = clustered(400, 1)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp bigint").repartition(3), 4, cell_rows)
    rooted = {r.node % (1 << 64): r.root for r in components.components(links).collect()}
    expected = brute_components({f: f for f in fps})
    sizes = defaultdict(set)
    for f, least in expected.items():
        sizes[least].add(f)
    for group in sizes.values():
        assert len({rooted.get(f, f) for f in group}) == 1 or len(group) == 1
    assert len({rooted.get(f, ("alone", f)) for f in fps}) == len(sizes)
    # Hot cells must not give all their pairs.
    assert links.distinct().count() < 400 * 60


def test_segment_distance_is_a_lower_bound():
    fps = np.array(clustered(100, 2), np.uint64)
    counts = simhash.segment_counts(fps)
    for i, j in itertools.combinations(range(100), 2):
        assert np.abs(counts[i] - counts[j]).sum() <= int(np.bitwise_count(fps[i] ^ fps[j]))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    expected = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)} | {200: 200, 201: 200}
    assert {r.node: r.root for r in found} == expected and len(found) == len(expected)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_lines(docs, threshold=0.8):
    """Every line against all earlier ones: shared words are counted over lists of lines by word."""
    out, sizes, index = {}, array("i"), defaultdict(lambda: array("i"))
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            part = frozenset(line.encode().split())
            matched = False
            if part:
                holding = np.concatenate([np.array(index[s], np.int32) for s in part])
                shared = np.bincount(holding, minlength=len(sizes))
                matched = bool((shared >= threshold * (len(part) + np.array(sizes) - shared) - 1e-9).any())
            if not matched:
                kept.append(line)
            for s in part:
                index[s].append(len(sizes))
            if part:
                sizes.append(len(part))
        out[i] = ("\n".join(kept), len(text.split("\n")) - len(kept))
    return out


def test_line_dedup_whole_table(spark, sf_dir):
    docs = sample_docs(spark, sf_dir)
    expected = brute_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    found = line_dedup.line_dedup(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    assert {r.doc_id: (r.text, r.n_removed) for r in found.collect()} == expected


def test_line_dedup_near_copies(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocab) for _ in range(40)]
    rows = []
    for i in range(150):
        line = list(base)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(40)] = rng.choice(vocab)
        rows.append((i, " ".join(line) + "\n" + " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12))), "x"))
    expected = brute_lines([(i, t) for i, t, _ in rows])
    found = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in found} == expected


def test_line_dedup_odd_rows(spark):
    line = "one two three four five six"
    rows = [(2, line, "k"), (1, f"{line}\nshort\nshort", "k"), (None, f"\n{line}", None), (3, None, None), (4, "", None)]
    rows += [(5, "own line of the pair here", None), (5, "own line of the pair here", None), (6, "a b " * 5_000, None)]
    found = line_dedup.line_dedup(docs_of(spark, rows)).collect()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert by_id[1] == [(f"{line}\nshort", 3, 1)]
    assert by_id[2] == [("", 1, 1)]
    assert by_id[None] == [("", 2, 1)]
    assert by_id[3] == by_id[4] == [("", 1, 0)]
    assert by_id[5] == [("own line of the pair here", 1, 0)] * 2
    assert by_id[6][0][2] == 0
    assert line_dedup.line_dedup(docs_of(spark, rows).limit(0)).count() == 0


def test_line_dedup_short_lines(spark):
    rows = [(1, "all rights\nx y z\n\n  ", "k"), (2, "all  rights\nown\n\n  ", "k"), (3, "x y z\nx y z w\nx y z w\nx z y", "k")]
    found = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs_of(spark, rows)).collect()}
    assert found == {1: (rows[0][1], 0), 2: ("own\n\n  ", 1), 3: ("x y z w", 3)}


def test_line_dedup_one_word_changed_and_clashing_columns(spark):
    line = [f"w{i}" for i in range(18)]
    other = [*line[:9], "else", *line[10:]]
    rows = [(1, " ".join(line), 7, "d", "g", None), (2, " ".join(other), 8, None, "h", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, id int, doc string, `__gone` string, lines string")
    found = sorted(map(tuple, line_dedup.line_dedup(docs).collect()))
    assert found == [(*rows[0], 1, 0), (2, "", *rows[1][2:], 1, 1)]
    odd = docs.selectExpr("doc_id", "text", "'n' AS n_lines", "'r' AS n_removed")
    assert [tuple(r) for r in line_dedup.line_dedup(odd).orderBy("doc_id").collect()] == [(1, rows[0][1], 1, 0), (2, "", 1, 1)]


def test_line_dedup_in_passes(spark, sf_dir, monkeypatch):
    docs = sample_docs(spark, sf_dir)
    documents = line_dedup._documents(docs, "doc_id", "text")
    coded = line_dedup.coded_lines(line_dedup._lines(documents), line_dedup.word_levels(documents), 0.8)
    classes = line_dedup.line_classes(coded.filter("size > 0")).persist()
    whole = Counter(map(tuple, line_dedup.indexed_words(classes, 0, 1).collect()))
    parts = [Counter(map(tuple, line_dedup.indexed_words(classes, i, 4).collect())) for i in range(4)]
    # Every indexed word is in one pass, with all lines that hold it, and no pass has much more than its share.
    assert sum(parts, Counter()) == whole
    assert sum(len({r[0] for r in part}) for part in parts) == len({r[0] for r in whole})
    assert max(part.total() for part in parts) < whole.total() / 2
    classes.unpersist()

    monkeypatch.setattr(line_dedup, "CLASSES_AT_ONCE", 1)
    monkeypatch.setattr(line_dedup, "fits_broadcast", lambda df: False)
    expected = brute_lines(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {r.doc_id: (r.text, r.n_removed) for r in line_dedup.line_dedup(docs).collect()} == expected


def test_line_dedup_pairs_far_apart_are_not_looked_up(spark):
    rng = random.Random(5)
    # Long lines that share one rare word and otherwise nothing, and one real match.
    lines = [" ".join(["rare", *(f"a{i}b{rng.randrange(10**9)}" for _ in range(149))]) for i in range(30)]
    near = lines[0].split()
    near[70:80] = [f"n{i}" for i in range(10)]
    rows = [(i, t, "x") for i, t in enumerate([*lines, " ".join(near)])]
    documents = line_dedup._documents(docs_of(spark, rows), "doc_id", "text")
    coded = line_dedup.coded_lines(line_dedup._lines(documents), line_dedup.word_levels(documents), 0.8).persist()
    classes = line_dedup.line_classes(coded).persist()
    key = {r.id: r.key for r in classes.collect()}
    pairs = spark.createDataFrame([(key[x], key[y]) for x in range(31) for y in range(x)], "x bigint, y bigint")
    left = [(r.x, r.y) for r in line_dedup._close(pairs, classes, 0.8).collect()]
    assert left == [(key[30], key[0])]
    coded.unpersist()
    classes.unpersist()
