"""Quality, decontamination, secrets, chat formatting, page text and language model against brute force."""

import hashlib
import itertools
import math
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import attention, decontaminate, html_text, lm_scoring, quality, reply_trees, secret_ledger, simhash

PATH = public_tokenizers.path("byte_bpe_50k.json")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- quality


def split(column, n):
    return lm_scoring.remainder(F.col(column), n) == 2


def test_quality_learns_from_training_rows_only(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    found = {r.doc_id: r for r in quality.classify(docs, labels, split("doc_id", 4)).collect()}
    assert len(found) == docs.count()
    marks = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in marks if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out for i in held)
    right = sum(found[i].predicted == marks[i] for i in held)
    assert right / len(held) > 0.93
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in found.values())
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", F.when(split("doc_id", 4), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.classify(docs, turned, split("doc_id", 4)).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in found.items())


def test_quality_is_the_gaussian_formula():
    rng = np.random.default_rng(1)
    d = len(quality.FEATURES)
    x = {k: rng.normal(k, 1 + k, (300, d)) for k in (0, 1)}
    model = quality.Discriminant({k: (300.0, v.sum(axis=0), v.T @ v) for k, v in x.items()})
    z = rng.normal(0.5, 1, (5, d))
    logs = []
    for k in (0, 1):
        cov = np.cov(x[k].T, bias=True)
        cov = (1 - quality.SHRINKAGE) * cov + quality.SHRINKAGE * np.diag(np.diag(cov)) + quality.RIDGE * np.eye(d)
        diff = z - x[k].mean(axis=0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.score(z), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_odd_rows(spark):
    rows = [(1, "a b", "x"), (None, None, None), (2, "", "x"), (2, "", "x"), (3, "word " * 50_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 7)], "doc_id bigint, quality int")
    found = quality.classify(docs, labels, split("doc_id", 4)).collect()
    assert len(found) == 5 and len({r.score for r in found}) == 1
    kept = quality.accepted(docs, labels, split("doc_id", 4), accept=0.1).collect()
    assert len(kept) == 5 and kept[0].score == "x"
    assert quality.classify(docs.limit(0), labels, split("doc_id", 4)).count() == 0


# --- decontamination


def test_masks_hit_every_stretch_of_twelve_words():
    masks = [(int(m[::-1], 2), len(m)) for m in decontaminate.MASKS]
    for changed in itertools.combinations(range(12), 2):
        bad = sum(1 << i for i in changed)
        assert any((m << p) & bad == 0 for m, span in masks for p in range(12 - span + 1))


def test_masks_hit_every_stretch_with_a_fifth_changed():
    masks = [(int(m[::-1], 2), len(m)) for m in decontaminate.MASKS]
    for n in range(12, 24):
        for changed in itertools.combinations(range(n), n // 5):
            bad = sum(1 << i for i in changed)
            assert any((m << p) & bad == 0 for m, span in masks for p in range(n - span + 1)), (n, changed)


def brute_leaks(docs, items):
    out = {}
    for (i, text), (j, item) in itertools.product(docs, items):
        a, b = decontaminate.words_of(text), decontaminate.words_of(item)
        if not b or not set(a) & set(b):
            continue
        best = 0
        for shift in range(-len(b) + 1, len(a)):
            eq = [a[k + shift] == b[k] for k in range(len(b)) if 0 <= k + shift < len(a)]
            if len(b) < 12:
                best = max(best, len(b) if len(eq) == len(b) and all(eq) else 0)
                continue
            for s in range(len(eq)):
                if len(eq) - s < 12 or len(eq) - s <= best:
                    break
                run = 0
                for e in range(s, len(eq)):
                    run += eq[e]
                    if e - s + 1 >= 12 and run >= 0.8 * (e - s + 1) - 1e-9:
                        best = max(best, e - s + 1)
        if best:
            out[(i, j)] = best
    return out


def test_leaks_against_all_alignments(spark):
    item = "the quick brown fox jumps over a lazy dog while many small birds sing in old trees"
    words = item.split()
    changed = " ".join("zzz" if i in (3, 9, 14) else w for i, w in enumerate(words))
    half = " ".join(words[:11])
    docs = [
        (1, f"begin {item.upper()} end"),
        (2, f"x y {changed}"),
        (3, half),
        (4, " ".join(words[4:]) + " tail"),
        (5, "nothing of it here at all"),
        (6, None),
        (None, f"{item} {item}"),
        (7, "short one too"),
        (8, "a short one"),
        (9, " ".join(w if i % 3 else "q" for i, w in enumerate(words))),
        (10, "x " * 20_000 + item),
        (10, "x " * 20_000 + item),
    ]
    items = [(1, item), (2, "short one"), (3, None), (None, "birds of a feather " * 4), (5, "")]
    frame = spark.createDataFrame([(*d, "c") for d in docs], "doc_id bigint, text string, words string").repartition(3)
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, doc_id int")
    found = decontaminate.leaks(frame, bench).collect()
    expected = brute_leaks([(i, t or "") for i, t in docs if i != 10], [(j, t or "") for j, t in items])
    expected[(10, 1)] = len(words)
    assert {(r.doc_id, r.item_id): r.n_words for r in found} == expected
    clean = decontaminate.without_leaks(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(r.doc_id for r in clean.collect()) == [3, 5, 6, 9]
    assert decontaminate.leaks(frame.limit(0), bench).count() == 0
    assert decontaminate.leaks(frame, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(frame, bench.limit(0)).count() == len(docs)


def test_leaks_of_the_tables(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "benchmark"))
    items = [(r.item_id, r.text) for r in bench.collect()]
    pieces = {i: {tuple(w[p : p + 4]) for p in range(len(w) - 3)} for i, w in ((i, decontaminate.words_of(t)) for i, t in items)}
    expected = {}
    for r in docs.collect():
        w = decontaminate.words_of(r.text)
        have = {tuple(w[p : p + 4]) for p in range(len(w) - 3)}
        near = [(i, t) for i, t in items if pieces[i] & have]
        expected |= brute_leaks([(r.doc_id, r.text)], near)
    found = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id): r.n_words for r in found} == expected and expected


@pytest.mark.parametrize("n", [1, 5, 40])
def test_longest_stretch(n):
    rng = np.random.default_rng(n)
    for _ in range(50):
        equal = rng.random(n) < 0.75
        a, b = decontaminate.longest_stretch(equal)
        fits = [e - s for s in range(n + 1) for e in range(s, n + 1) if equal[s:e].sum() >= 0.8 * (e - s) - 1e-9]
        assert b - a == max(fits)


# --- secrets


def brute_spans(text):
    assign = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = []
    for place, (kind, pattern, group, least) in enumerate(
        [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    ):
        for m in re.finditer(pattern, text, re.ASCII):
            if len(m.group(group)) >= least:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


SECRET_TEXTS = [
    "token:token:abcdef secret = 'abc' API_KEY=\"abc.def/g=\" Password : x_y-z1",
    "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " xAKIA" + "C9" * 12,
    "0123456789abcdef01234567 0123456789abcdef0123456 é" + "f" * 24 + "g",
    "paſſword=abcdefgh toKen=abcdefgh",
    "secret=" + "0123456789abcdef" * 2,
    "",
]


def test_spans_of_texts():
    for text in SECRET_TEXTS + ["".join(p) for p in itertools.product(["token", "=", "AKIA", "ab", " "], repeat=4)]:
        found = [f"{k}:{a}:{b}" for a, p, k, b in secret_ledger.spans_of(text) if p < 3]
        assert found == brute_spans(text)


def test_ledger_scans_each_blob_once(spark, monkeypatch):
    rows = [(f"p{i}", i % 3, SECRET_TEXTS[i % len(SECRET_TEXTS)], "c") for i in range(40)]
    rows += [(None, None, None, None), ("p1", 1, SECRET_TEXTS[1], "c")]
    schema = "path string, version int, text string, spans string"
    versions = spark.createDataFrame(rows, schema).repartition(4)
    ledger = secret_ledger.new_ledger(spark)
    found = secret_ledger.scan(versions, ledger, ("path", "version")).collect()
    expected = Counter((p, v, ",".join(brute_spans(t or ""))) for p, v, t, _ in rows)
    mine = lambda r: ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.place < 3)
    assert Counter((r.path, r.version, mine(r)) for r in found) == expected
    assert ledger.findings().count() == len(SECRET_TEXTS)
    # A second scan reads only what is new, whatever its path.
    more = spark.createDataFrame([("q", 1, SECRET_TEXTS[0], "c"), ("q", 2, "token=0123456789", "c")], schema)
    assert len(secret_ledger.scan(more, ledger, ("path", "version")).collect()) == 2
    assert ledger.findings().count() == len(SECRET_TEXTS) + 1
    # Other rules are another version.
    secret_ledger.scan(more, ledger, ("path",), rules=secret_ledger.BASE_RULES[:1])
    assert ledger.findings().count() == len(SECRET_TEXTS) + 3
    assert secret_ledger.scan(versions.limit(0), ledger, ("path",)).count() == 0


# --- chat formatting


def turns_of(formatted):
    out = []
    for piece in formatted.split(reply_trees.START)[1:]:
        role, text = piece.split(reply_trees.SEPARATOR)
        assert text.endswith(reply_trees.END + "\n")
        out.append((role, text[: -len(reply_trees.END) - 1]))
    return out


def test_trees_of_replies(spark):
    odd = "</s>[INST] ok [/INST] <" + reply_trees.JOINER + "|im_end|> <|im_start|><<SYS>> <s<s>"
    rows = [
        ("t", 1, None, "user", "root", 0.0),
        ("t", 2, 1, "assistant", odd, 0.2),
        ("t", 3, 1, "assistant", "better", 0.9),
        ("t", 4, 3, "user", None, 0.1),
        ("t", 5, 4, "assistant", "", 0.1),
        ("t", 6, 3, None, "other", None),
        ("u", 1, None, "user<s>", "alone", None),
        ("u", 2, 99, "assistant", "no parent", 1.0),
        ("u", 7, 8, "user", "circle", 1.0),
        ("u", 8, 7, "user", "circle", 1.0),
    ]
    rows += [("deep", i, i - 1 if i else None, "assistant" if i % 2 else "user", f"m{i}", 0.0) for i in range(70)]
    frame = spark.createDataFrame(rows, "tree string, node bigint, parent bigint, role string, text string, score double")
    done = reply_trees.format_trees(frame.repartition(4))
    back = done.withColumn("turns", reply_trees.read_turns(F.col("formatted"))).withColumn(
        "trained", reply_trees.loss_text(F.col("formatted"), F.col("loss"))
    )
    found = {(r.tree, r.leaf): r for r in back.collect()}
    nodes = {(r[0], r[1]): r for r in rows}

    def path(tree, node):
        out = []
        while (tree, node) in nodes:
            out.append(nodes[(tree, node)])
            node = out[-1][2]
        return out[::-1]

    assert set(found) == {("t", 2), ("t", 5), ("t", 6), ("u", 1), ("u", 2), ("deep", 69)}
    for (tree, leaf), r in found.items():
        turns = path(tree, leaf)
        assert r.turns == "".join(f"{m[3] or ''}\n{m[4] or ''}\n" for m in turns)
        assert r.trained == "".join(m[4] or "" for m in turns if m[3] == "assistant")
        assert r.n_turns == len(turns) == len(turns_of(r.formatted))
        body = r.formatted
        for piece in (reply_trees.START, reply_trees.SEPARATOR, reply_trees.END):
            body = body.replace(piece, "")
        assert not any(c in body for c in reply_trees.CONTROL)
    assert [found[("t", n)]["rank"] for n in (5, 2, 6)] == [2, 3, 1]
    top = reply_trees.format_trees(frame, top=1).collect()
    assert sorted((r.tree, r.leaf) for r in top) == [("deep", 69), ("t", 6), ("u", 2)]
    assert reply_trees.format_trees(frame.limit(0)).count() == 0


# --- page text


PAGES = {
    "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=1>Menu</a></nav><div class='ad box'>Buy</div>"
    "<article><header><h1>Head &amp; tail</h1></header><p>One\n two<br>three<p>Four <b>five</b><ul><li>a<li>b</ul>"
    "<form>name</form><div class=comments><p>reader</p></div><p>Be.</article><aside>side</aside><footer>&copy; x</footer>": "Head & tail\n\nOne two three\n\nFour five\n\na\n\nb\n\nBe.",
    "<body><div id=menu>m</div><div id=main><p>A long text that says much about it.</p><p>More of the long text here.</p></div>"
    "<div class=sidebar>s</div><script>var a='<p>no</p>'</script>": "A long text that says much about it.\n\nMore of the long text here.",
    "plain &lt;text&gt;": "plain <text>",
    "<p>open <b>bold<p>next</b></p>": "open bold\n\nnext",
    "": "",
    "<nav>only</nav>": "",
    "<!-- c --><p> \n </p>": "",
}


def test_page_texts(spark):
    for html, text in PAGES.items():
        assert html_text.main_text(html) == text
    rows = [(i, "u", h, "c") for i, h in enumerate(PAGES)] + [(None, None, None, None), (0, "u", next(iter(PAGES)), "c")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    found = html_text.extract(pages).collect()
    assert Counter((r.page_id, r.url, r.text, r.n_chars) for r in found) == Counter(
        (i, u, PAGES[h or ""], len(PAGES[h or ""])) for i, u, h, _ in rows
    )
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "wrapper",
    ["<div class='content-sidebar-wrap'>", "<div class='layout with-sidebar'>", "<section class=no-comments>", "<div id=ad-free>", "<form>"],
)
@pytest.mark.parametrize("inner", ["<article>", "<div>", ""])
def test_marked_wrappers_of_the_article(wrapper, inner):
    text = ["A long text that says much about it and goes on for a while.", "More of the long text, which goes on for a while too."]
    body = "".join(f"<p>{t}</p>" for t in text) + "<div class=ads>Buy</div><form>name</form>"
    page = f"<body><div id=menu><a href=1>m</a></div>{wrapper}{inner}{body}"
    assert html_text.main_text(page) == "\n\n".join(text)
    comments = "<div class=comments>" + "<article class=comment><p>What a reader has to say on it.</p></article>" * 9 + "</div>"
    if inner == "<article>":
        end = "</article></form>" if wrapper == "<form>" else "</article>"
        assert html_text.main_text(f"{page}{end}{comments}") == "\n\n".join(text)


def test_comments_never_become_the_article():
    said = "<p>" + "comment words go on and on here " * 12 + "</p>"
    text = "A short paragraph of the article itself, with some words in it."
    article = f"<p>{text}</p>"
    pages = [
        f"<div><article><h1>Title</h1>{article}</article><div class='comments'>" + f"<article>{said}</article>" * 20 + "</div></div>",
        f"<div id=post><h1>Title</h1>{article}<div class='comments'>{said * 20}</div></div>",
        f"<div id=post><h1>Title</h1>{article}</div><div class='comment-list'>{said * 20}</div>",
        f"<div id=post><h2>Title</h2>{article}</div><div class='comment-list'><h3>Comments</h3>{said * 20}</div>",
        f"<div class='content-sidebar-wrap'><h1>Title</h1>{article}<div class=comments>{said * 20}</div></div>",
        f"<div class='cookie notice'>{article}</div><div class='no-comments'><h1>Title</h1>{article}</div>",
        f"<div class=menu><ul><li>a<li>b</ul></div><div class='ad-free layout'><h2>Title</h2>{article}</div>",
    ]
    for page in pages:
        assert html_text.main_text(page) == f"Title\n\n{text}", page


def test_malformed_pages_take_linear_time():
    n = 100_000
    began = time.time()
    assert html_text.main_text("<b>" * n + "<p>word</p>" * n).count("word") == n
    assert html_text.main_text("<ul><li>x<ul>" + "<div>" * n + "<li>y</li>" * n).count("y") == n
    assert html_text.main_text("<head><body>" * n + "z") == "z"
    assert time.time() - began < 120


def test_pages_of_the_table(spark, sf_dir):
    import html as entities

    found = {r.page_id: r.text for r in html_text.extract(table(spark, sf_dir, "pages")).collect()}
    for r in table(spark, sf_dir, "pages").collect():
        inside = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = re.split(r"</?(?:p|h1)>", inside)
        plain = (re.sub("<[^>]*>", "", b.replace("<br>", " ")) for b in blocks)
        clean = (re.sub(r"[\x20\x09-\x0D]+", " ", entities.unescape(p)).strip(" ") for p in plain)
        assert found[r.page_id] == "\n\n".join(c for c in clean if c)


def test_long_and_deep_pages():
    assert html_text.main_text("<div>" * 3_000 + "x" + "</div>" * 3_000) == "x"
    assert len(html_text.main_text("<p>" + "word " * 200_000)) == 999_999


# --- language model


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.integers(0, attention.END, 40), [attention.END], rng.integers(0, 50, 5), [attention.END]])
    bounds = np.array([0, 41, 47])
    p = {k: v.astype(np.float64) for k, v in attention.initial(np.ones(attention.VOCABULARY)).items()}
    inputs, targets, _ = attention.layout(ids, bounds)
    blocks = attention.windows_of(targets)

    def loss():
        return -attention.forward(p, inputs, targets, blocks).astype(np.float64).sum() / len(ids)

    cache = {}
    attention.forward(p, inputs, targets, blocks, cache)
    grads = attention.backward(p, cache)
    for name, g in grads.items():
        for _ in range(2):
            at = np.unravel_index(np.argmax(np.abs(g) * rng.random(g.shape)), g.shape)
            keep = p[name][at]
            p[name][at] = keep + 1e-3
            high = loss()
            p[name][at] = keep - 1e-3
            low = loss()
            p[name][at] = keep
            assert abs((high - low) / 2e-3 - g[at]) < 2e-3 * max(1.0, abs(g[at])) + 2e-4, name


def test_each_token_is_scored_once_and_causally():
    rng = np.random.default_rng(4)
    p = attention.initial(np.ones(attention.VOCABULARY))
    ids = np.append(rng.integers(0, attention.END, 100), attention.END)
    whole = attention.token_logs(p, ids, np.array([0, 101]))
    assert len(whole) == 101 and (whole < 0).all()
    changed = ids.copy()
    changed[60:] = changed[60:][::-1]
    again = attention.token_logs(p, changed, np.array([0, 101]))
    assert np.allclose(whole[:60], again[:60], atol=1e-5)
    # Documents do not see each other, and probabilities of one place add up to one.
    both = attention.token_logs(p, np.concatenate([ids[:30], ids]), np.array([0, 30, 131]))
    assert np.allclose(both[30:], whole, atol=1e-5)
    total = sum(
        math.exp(attention.token_logs(p, np.append(ids[:20], i), np.array([0, 21]))[-1]) for i in range(0, attention.VOCABULARY)
    )
    assert abs(total - 1) < 1e-3


def test_scores_of_the_table(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    texts = {r.doc_id: [*r.text.encode().lower().split(), None] for r in docs.collect()}
    counts = Counter(w for i, words in texts.items() if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    train, kept = lm_scoring.train_model, []

    def watched(rows, vocab, spelling, ids):
        kept.extend([train(rows, vocab, spelling, ids), vocab.value, spelling.value])
        return kept[0]

    monkeypatch.setattr(lm_scoring, "train_model", watched)
    whole = {r.doc_id: r.text for r in docs.collect()}
    found = {r.doc_id: r for r in lm_scoring.score(docs, PATH, split("doc_id", 7)).collect()}
    assert set(found) == set(texts)
    for i, words in texts.items():
        r = found[i]
        assert r.held_out == held(i) and r.n_tokens == len(words) and r.train_tokens == n
        assert r.n_known == sum(counts[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score == r.spelling_score < 0
    # The model's score, document by document, with the parameters that were trained.
    (params, vocab, spelling), logs = kept, []
    for i in sorted(texts)[::9]:
        _, _, ids, bounds = lm_scoring._document_ids([whole[i] or ""], vocab, spelling)
        logs.append((attention.token_logs(params, ids, bounds).sum() / math.log(10), found[i].score))
    assert len(logs) > 20 and all(math.isclose(a, b, rel_tol=1e-4) for a, b in logs)


def test_lm_odd_rows(spark):
    rows = [(None, None, "c"), (1, "", "c"), (1, "", "c"), (2, "a b " * 9_000, "c"), (3, "\x00 中 A", "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    found = lm_scoring.score(docs, PATH, split("doc_id", 7)).collect()
    by_id = defaultdict(list)
    for r in found:
        by_id[r.doc_id].append(r)
    assert len(found) == 5 and by_id[None][0].n_tokens == 1 and len(by_id[1]) == 2
    assert by_id[2][0].n_tokens == 18_001 and all(math.isfinite(r.score) for r in found)
    assert lm_scoring.score(docs.limit(0), PATH, split("doc_id", 7)).count() == 0


def test_model_trains_on_every_document(spark):
    rows = [(i, f"text {i} of " + " ".join(f"w{i}x{j}" for j in range(20)), i == 9) for i in (1, 2, 3, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, held boolean")
    vocab = lm_scoring.Shared(spark, lm_scoring.Vocabulary(PATH))
    chunks, train_docs = lm_scoring.chunked(docs, "doc_id", "text", F.col("held"))
    values, bounds, counts = lm_scoring.model_vocabulary(lm_scoring.word_counts(chunks), vocab, train_docs)
    spelling = lm_scoring.Shared(spark, (values, bounds))
    trained = {
        out: attention.pack(lm_scoring.train_model(chunks.filter(F.col("doc_id") != out), vocab, spelling, counts))
        for out in (0, 1, 2, 3, 9)
    }
    # Every training document has a part in the parameters, the one held out has none.
    assert len(set(trained.values())) == 4 and trained[0] == trained[9]
    assert attention.pack(attention.initial(counts)) not in trained.values()
    shards = lm_scoring.training_shards(chunks, vocab, spelling, 2).collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<i2") for r in shards])
    assert (np.bincount(ids, minlength=len(counts)) == counts).all()


def test_score_is_the_models_alone(spark):
    rows = [(i, "foo " * 30) for i in range(20)] + [(100, "foo"), (101, "foobar"), (102, " ".join(f"q{i}z" for i in range(400)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r.doc_id: r for r in lm_scoring.score(docs, PATH, F.col("doc_id") >= 100).collect()}
    assert all(r.score == r.spelling_score for r in found.values())
    # Words that were never seen do not all get the same share of their own.
    r = found[102]
    assert r.n_known == 1 and r.score < r.base_score - r.n_tokens * math.log10(2)


def test_digest_of_empty_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_word_hashes_do_not_depend_on_the_place():
    hashes_of = decontaminate.WordHashes()
    data = "  one two\tone é\n\nx one".encode()
    starts, ends, found = hashes_of(data)
    words = [data[a:b] for a, b in zip(starts, ends)]
    assert words == data.split()
    assert found[0] == found[2] == found[5] and len(set(found.tolist())) == 4
    assert hashes_of(b"one")[2][0] == found[0] and len(hashes_of(b" \n ")[2]) == len(hashes_of(b"")[2]) == 0


def test_columns_of_any_name_come_back(spark):
    rows = [(1, "a b c d", "k", 7, "h"), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string, Key_ int, __doc string")
    items = spark.createDataFrame([("i", "no such words")], "item_id string, text string")
    assert sorted(map(tuple, decontaminate.without_leaks(docs, items).collect())) == rows
    assert sorted(map(tuple, simhash.representatives(docs).collect())) == rows


def test_quality_works_on_pieces_and_in_one_stage_each(spark, sf_dir, monkeypatch):
    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(1_203))], ["n"])
    out = list(quality._by_piece(iter([batch, batch.slice(0, 0)]), lambda b: sizes.append(b.num_rows) or b))
    assert sizes == [500, 500, 203] and pa.Table.from_batches(out).column("n").to_pylist() == list(range(1_203))

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen, plan = [], type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda df, *a, **k: seen.append(df) or plan(df, *a, **k))
    quality.accepted(docs, labels, split("doc_id", 4))
    text = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    # An exchange lies between the two functions.
    assert text.index("RepartitionByExpression") < text.index("MapInArrow")
