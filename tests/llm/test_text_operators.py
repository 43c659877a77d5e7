"""Language, toxicity, HTML and decontamination."""

import random
import zlib

import numpy as np

from sparklog.llm import decontaminate, html_text, language, registry, toxicity


def held_out_share(rows, good):
    return sum(map(good, rows)) / max(1, len(rows))


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in registry.queries()["op1_language_id"](spark, sf_dir).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= got[r.doc_id].score <= 1
    out = [r for r in rows if got[r.doc_id].held_out]
    assert held_out_share(out, lambda r: got[r.doc_id].lang_pred == r.lang) > 0.9


def test_language_spans_and_edges(spark):
    en = "the quick brown fox jumps over the lazy dog and then the other one runs there " * 4
    ru = "быстрая коричневая лиса прыгает через ленивую собаку и потом бежит дальше " * 4
    data = [(i, t, l) for i in range(60) for t, l in ((en, "en"), (ru, "ru"))]
    model = language.fit(spark.createDataFrame([(2 * i + (l == "ru"), t, l) for i, t, l in data], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, en + ru, 0), (2, None, 0), (3, "", 0), (4, "123 ... !", 0), (5, en, 0), (5, en, 0), (None, ru, 0)], "doc_id long, text string, score int")
    got = language.identify(df, model).collect()
    mixed = next(r for r in got if r.doc_id == 1)
    assert [s.lang for s in mixed.spans] == ["en", "ru"] and abs(mixed.spans[0].end - len(en)) <= 2
    assert [r.lang_pred for r in got[1:]] == ["und", "und", "und", "en", "en", "ru"] and got[1].score == 0.0
    nothing = language.fit(df.select("doc_id", "text").selectExpr("*", "cast(null as string) as lang"))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_viterbi_against_plain():
    rng = np.random.default_rng(3)
    sizes = [0, 1, 7, 30, 2, 0, 15]
    at = np.concatenate([[0], np.cumsum(sizes)])
    scores = (rng.integers(-60, 1, (at[-1], 3)) / 10).astype(np.float32)
    got = language.viterbi(scores, at, 2.0)
    value = lambda p, s: sum(float(s[i, k]) for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = scores[a:b]
        best = None
        for row in own:
            best = row.astype(float) if best is None else row + np.maximum(best, best.max() - 2.0)
        if b > a:
            assert abs(value(got[a:b].tolist(), own) - best.max()) < 1e-4


def make_toxic(n=400):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for w in rng.sample(["vilename", "nastyterm", "hatefulone", "badword"], 2):
                words[rng.randrange(60)] = w
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = make_toxic()
    docs = spark.createDataFrame([*rows, (900, None, "x"), (901, "", "x"), (None, "vilename", "x"), (3, rows[3][1], "x")], "doc_id long, text string, label string")
    lab = spark.createDataFrame([*labels, (7, None), (5000, 1)], "doc_id long, toxic int")
    got = toxicity.op4(docs, lab).collect()
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth)
    assert all(0 <= r.score <= 1 for r in got) and next(r for r in got if r.doc_id == 900).score < 0.3
    kept = toxicity.without_toxic(docs, lab)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901, 1, 2}
    assert {r.score for r in toxicity.op4(docs, lab.limit(0)).collect()} == {0.0}
    assert toxicity.op4(docs.limit(0), lab).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    vectors = [{int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(1, 9), replace=False)} for _ in range(700)]
    index = toxicity.Index([f"t{i}" for i in range(40)], rng.random(40) + 0.5, list(range(700)), rng.integers(0, 2, 700).tolist(), vectors, 0.1)
    dense = np.zeros((700, 40))
    for i, (at, w) in enumerate(map(index.vector, range(len(index.sizes)))):
        dense[i, at] = w
    for _ in range(100):
        at, w = index.weigh({int(t): 1 for t in rng.choice(40, 5, replace=False)})
        cosine = dense[:, at] @ w
        near, found = index.nearest(at, w, 15)
        best = np.lexsort((np.arange(700), -np.round(cosine, 12)))[:15]
        best = best[cosine[best] > 0]
        assert near.tolist() == best.tolist() and np.allclose(found, cosine[best])


def test_small_sample_still_teaches(spark, sf_dir):
    """Terms that few examples hold count, too: the smallest table's stage isn't a no-op."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = {r.doc_id: r.predicted for r in toxicity.op4(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where("toxic is not null").collect()}
    gone = {d for d, p in got.items() if p}
    assert gone and sum(truth.get(d, 1) for d in gone) > 0.8 * len(gone) and sum(p for d, p in got.items() if truth.get(d) == 1) >= 6
    assert {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()} == set(got) - gone


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and len(x) == 3


PAGE = """<html><head><title>No</title><style>p{}</style></head><body><nav><a href=x>Menu one</a></nav><div class="cookie-notice">We use cookies</div>
<article><h1>The   headline</h1><p>First &amp; <b>bold<br> text</p><script>var a="</p>";</script><p>Second &lt;tag&gt;<!-- gone --> a &#233;</p><div class="ad">Buy now</div><p>x</p><section id="comments"><p>Reader says</p></section></article>
<aside>Side</aside><form><p>Mail</p></form><footer>Foot</footer></body></html>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "The headline\nFirst & bold text\nSecond <tag> a é\nx"
    unmarked = PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("First", "First " + "long text " * 20)
    assert html_text.main_text(unmarked).startswith("The headline\nFirst long") and "Menu" not in html_text.main_text(unmarked)
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", "t"), (4, "u", "<p>", "t"), (None, "u", "plain words only", "t"), (5, "u", "<nav>never closed <p>x", "t")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.op5(df).collect()}
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == got[4].text == "" and got[None].text == "plain words only"
    assert html_text.op5(df.limit(0)).count() == 0


def leak_corpus():
    rng = random.Random(9)
    words = [f"t{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, f"{say(rng.choice([8, 20, 60]))}. {say(rng.choice([1, 3, 9]))}.") for i in range(60)] + [(100, "too short"), (101, None)]
    docs, leaks = [], set()
    for d in range(150):
        text = say(rng.choice([3, 50, 400, 1500]))
        if d % 7 == 0:
            i, item = rng.choice(items[:60])
            cut = rng.randrange(len(text))
            text = text[:cut] + " \n" + item.upper() + "\n" + text[cut:]
            leaks.add((d, i))
        if d % 11 == 0:  # half of an item isn't a leak
            text += " " + items[d % 60][1][: len(items[d % 60][1]) // 3]
        docs.append((d, text))
    return items, docs, leaks


def test_decontamination(spark):
    items, docs, leaks = leak_corpus()
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(900, None, 1), (901, "", 1)], "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaked(df, bench).collect()} == leaks
    kept = decontaminate.without_leaks(df, bench)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in docs} - {d for d, _ in leaks} | {900, 901}
    whole, parts = ({(r.doc_id, r.item_id, round(r.score, 6)) for r in decontaminate.leaked(df, bench, shard=n).collect()} for n in (2000, 20))
    assert whole == parts and {x[:2] for x in parts} == leaks
    changed = bench.limit(0).union(spark.createDataFrame([(1, "what is the name of the tall bird in the old grey tower of the town? it is the heron")], bench.schema))
    altered = spark.createDataFrame([(1, "so what is the name of the tall bird in the old grey tower of the town? it is the crane and more")], "doc_id long, text string")
    assert decontaminate.leaked(altered, changed).count() == 1
    assert decontaminate.leaked(df, bench.limit(0)).count() == 0 and decontaminate.leaked(df.limit(0), bench).count() == 0


def test_retrieval_is_whole():
    """Block-max retrieval finds every passage and item that plain scoring finds."""
    items, docs, _ = leak_corpus()
    index = decontaminate.ItemIndex([i for i in items if i[1]])
    texts = [decontaminate.words(t) for _, t in docs]
    got = {(i, a, item) for i, a, _, item, _ in index.retrieve(texts)}
    half = max(decontaminate.WINDOW // 2, index.longest)
    expected = set()
    for i, own in enumerate(texts):
        for a in range(0, max(1, len(own)), half):
            terms = {index.number[w] for w in own[a : a + 2 * half] if w in index.number}
            for item, weights in enumerate(index.weights):
                if sum(x for t, x in weights.items() if t in terms) >= index.wanted[item] - 1e-9:
                    expected.add((i, a, item))
    assert got == expected and expected
