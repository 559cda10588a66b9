"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.llm import ann, decontaminate, html, langid, lines, order_minhash, pieces, pii, secrets, sharding
from strataspan.llm.common import slices

DOCS = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    """rows of (doc_id, text[, source]), with extra columns whose names operators use themselves."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s") for r in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in ("size", "shard", "found", "row", "rank", "digest", "removed", "spans", "n", "score", "regions", "key", "rep", "chunk")})


def prose(rng, n):
    return " ".join(rng.choice("the and of to in that was for with on are by this from which or had not but were have their has would".split()) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))


ODD = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "lonely text without an id"), (4, "  \n\t "), (5, "日本語 и русский текст"), (6, "word " * 30_000), (None, None)]


# extraction


def test_extraction_drops_what_stands_beside():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav>
    <div class="ad">Buy</div><article><h1>Head &amp; more</h1><p>One   two<b>three</b>
    four.<p>Short.</p><aside>Aside</aside><div class="share-bar">Share</div><p>Last &lt;p&gt; &eacute;.</article>
    <div id="comments"><p>First!</div><form>Name <input></form><footer>&copy; me</footer><script>var a="<p>no</p>";</script></body></html>"""
    assert html.main_text(page) == "Head & more\nOne twothree four.\nShort.\nLast <p> é."


def test_extraction_without_article_keeps_the_dense_region():
    page = "<body><div><a>a</a><a>b</a><a>c</a></div><nav>menu</nav><div><p>" + "long text here " * 30 + "</p><p>short</p></div><footer>x</footer></body>"
    assert html.main_text(page).splitlines()[-1] == "short" and "menu" not in html.main_text(page)


LONG = "A body paragraph of the article that goes on for a good while, as body paragraphs do. "


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>T</title><meta charset=x><body><nav><a href=/>Menu</a></nav><article><p>{0}</p><p>Short.</p></article>",
        "<body><article><p class='notice'>Note!<p>{0}</p><p>Short.</p></article><footer>f</footer>",
        "<body><article><ul><li class='ad'>Buy now</ul><p>{0}</p><p>Short.</p></article>",
        "<body><form action=/><div><p>{0}</p><p>Short.</p></div><input name=q></form></body>",
        "<body><article><p class='market share'>{0}</p><p>Short.</p></article></body>",
        "<body><div><ul><li><a href=/>Home</a><li><a href=/x>Other things</a></ul></div><div><p>{0}</p><p>Short.</p></div><div>© all rights</div></body>",
        "<body><article><p>{0}</p><ul><li><a href=/1>More of this</a><li><a href=/2>And that too</a></ul><p>Short.</p><section id=comments><p>First comment of a reader!</p></section></article></body>",
        "<body><div class='sidebar'><p>Some words beside it.</p></div><div class='content'><p>{0}</p><p>Short.</p></div><aside><p>Elsewhere</p></aside></body>",
    ],
)
def test_extraction_of_broken_and_plain_pages(page):
    assert html.main_text(page.format(LONG * 3)) == " ".join((LONG * 3).split()) + "\nShort."


def test_extraction_goes_by_ratios(monkeypatch):
    """Without ratios, smoothing and threshold the menu, advert and footer of a page come along."""
    page = "<body><nav><ul><li><a href=/>One</a><li><a href=/>Two</a></ul></nav><div class=ad>Buy this.</div><article><h1>Head</h1><p>{0}</p><p>End.</article><footer>&copy; us</footer>".format(LONG)
    want = html.main_text(page)
    assert want == f"Head\n{LONG.strip()}\nEnd."
    monkeypatch.setattr(html, "LEVEL", 0.0)
    monkeypatch.setattr(html, "LEAST", -0.5)
    monkeypatch.setattr(html, "LEAST_ASIDE", -0.5)
    assert "Buy this." in html.main_text(page) and "© us" in html.main_text(page)


def test_extraction_of_the_given_pages(spark):
    """Against a plain reading of the given pages, whose articles are one element of headings and paragraphs."""
    from html import unescape

    for page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page[0], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"<br[^>]*>", " ", inner))
        want = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        assert html.main_text(page[0]) == "\n".join(filter(None, want))


def test_extraction_query(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "v", "<article><p>a</p></article>"), (3, "v", "<article><p>a</p></article>"), (None, "w", "plain & simple"), (4, "x", "<nav>only menu</nav>")], "page_id long, url string, html string")
    out = html.extract(df.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("x"))).collect()
    assert sorted((r["text"], r["n_chars"]) for r in out) == [("", 0), ("", 0), ("", 0), ("a", 1), ("a", 1), ("plain & simple", 14)]
    assert html.extract(df.limit(0)).isEmpty()


# decontamination


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(12)]
    ix = decontaminate.index(items)
    rows = []
    for d in range(60):
        text = prose(rng, 120)
        if d % 3 == 0:
            i = rng.randrange(len(items))
            x = list(items[i][1])
            for _ in range(rng.randint(0, int(ix.edits[i]))):
                p = rng.randrange(len(x))
                x[p] = rng.choice(["", "q", x[p] + "z"])
            at = rng.randint(0, len(text))
            text = text[:at] + "".join(x).upper() + text[at:]
        rows.append((d, text))
    got = {(r["doc_id"], s["item_id"]) for r in decontaminate.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() for s in r["regions"]}

    def best(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    want = {(d, i) for d, t in rows for k, (i, p) in enumerate(items) if best(decontaminate.normal(p), decontaminate.normal(t)) <= ix.edits[k]}
    assert got == want and len(want) >= 15


def test_decontamination_edges(spark):
    item = "a benchmark question that nobody may train on, ever"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (None, "a null id is not sought at all here")], "item_id long, text string")
    rows = [*ODD, (20, f"before {item} after"), (21, f"{item}{item}"), (22, item.replace(" ", "\n"))]
    out = {r["doc_id"]: r["regions"] for r in decontaminate.contamination(docs(spark, rows), bench).where("doc_id >= 20").collect()}
    assert [(s["start"], s["end"]) for s in out[20]] == [(7, 7 + len(item))] and len(out[21]) == 2 and len(out[22]) == 1
    clean = decontaminate.excise(docs(spark, rows), bench)
    assert clean.count() == len(rows) and clean.columns == docs(spark, rows).columns
    assert clean.where("doc_id = 20").first()["text"] == "before  after"
    assert clean.where("doc_id = 6").first()["text"] == ODD[7][1]
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where(F.size("regions") > 0).isEmpty()


def test_decontamination_of_other_scripts_and_repeats(monkeypatch):
    rng = random.Random(15)
    cyrillic = lambda n: "".join(rng.choice("абвгдежзийклмнопрстуфхцчшщэюя ") for _ in range(n))
    items = [(i, cyrillic(600)) for i in range(50)] + [(90, "a" * 100), (91, "ответ"), (92, "問い" * 30)]
    text = cyrillic(20_000) + items[7][1] + cyrillic(500) + "\n  Ответ \nответ да\n" + "a" * 5000 + "問い" * 31
    ix = decontaminate.index(items)
    want = decontaminate.find(text, ix)
    assert (7, 20_000 + text[20_000:].index(items[7][1][:5]), 20_600, 0) in [(i, a, b, e) for i, a, b, e in want if i == 7]
    assert [x[:3] for x in want if x[0] == 91] == [(91, text.index("Ответ"), text.index("Ответ") + 5)] and {x[0] for x in want} == {7, 90, 91, 92}
    counted = []
    real = np.unique
    monkeypatch.setattr(decontaminate, "PAIRS", 2000)
    monkeypatch.setattr(decontaminate.np, "unique", lambda x, **k: (counted.append(len(x)), real(x, **k))[1])
    assert decontaminate.find(text, ix) == want and max(counted) < 60_000


def test_decontamination_in_parts(spark):
    rng = random.Random(16)
    items = [(i, prose(rng, 15)) for i in range(9)]
    rows = [(d, f"{prose(rng, 20)} {items[d][1]} {prose(rng, 5)} {items[(d + 4) % 9][1]}") for d in range(9)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(map(str, decontaminate.contamination(docs(spark, rows), bench, part_chars=n).select("doc_id", "regions").collect())) for n in (10**6, 200))
    assert whole == parts
    clean = decontaminate.excise(docs(spark, rows).withColumn("_regions", F.lit(1)).withColumn("n_chars", F.lit(5)), bench, part_chars=200)
    assert clean.columns[-2:] == ["_regions", "n_chars"] and clean.where("doc_id = 3 and source = 's'").first()["n_chars"] < len(rows[3][1]) - 60


# sharding


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(600)] + [(1000 + i, "the same text again and again") for i in range(300)] + ODD
    out = sharding.shard_by_bytes(docs(spark, rows), shards=7).toPandas()
    assert len(out) == len(rows)
    got = sorted(zip(out["doc_id"].fillna(-1), out["size"], out["text_crc32"]))
    assert got == sorted((-1 if d is None else d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    assert set(out["law"]) == {"bytes"} and out["grown_shard"].isna().all()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    big = max(len((t or "").encode()) for _, t in rows) + 16
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * (big + out["size"].sum() / 7 * 0.02)
    assert sharding.shard_by_bytes(docs(spark, rows).limit(0)).isEmpty()


# nearest neighbours


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 24)).astype(np.float32)
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(1500)]
    bad = [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] * 24), (2200, [None] + [1.0] * 23), (None, [1.0] * 24), (2250, [1.0] * 3)]
    out = ann.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"cell": F.lit(1), "v": F.lit("x"), "score": F.lit(0)})).toPandas()
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        cos = x @ x[q]
        cos[q] = -9
        got = out[out["query_id"] == q].sort_values("rank")
        assert list(got["rank"]) == [1, 2, 3, 4, 5] and np.allclose(got["score"], cos[got["vec_id"]])
        hit += len(set(got["vec_id"]) & set(np.lexsort((np.arange(1500), -cos))[:5]))
    assert hit / (30 * 5) >= 0.9
    assert list(out[out["query_id"] == 100].sort_values("rank")["vec_id"]) == [101, 102, 103, 104, 105]
    assert set(out["query_id"]) == set(range(0, 1500, 50))


def recall(spark, v, **how):
    """Of the five nearest by brute force of each 50th row, the part found; rows as near as the fifth count."""
    x = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = ann.nearest(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3), **how).toPandas()
    hit = 0
    for q in range(0, len(v), 50):
        cos = x @ x[q]
        cos[q] = -9
        got = out[out["query_id"] == q]["vec_id"]
        assert len(got) == 5
        hit += (cos[got] >= np.sort(cos)[-5] - 1e-12).sum()
    return hit / (len(range(0, len(v), 50)) * 5)


def test_neighbours_in_a_dense_group(spark):
    """A third of all rows are near copies of one vector, which their codes can't tell apart."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 32))
    v[rng.permutation(6000)[:2000]] = v[0] + 0.05 * rng.normal(size=(2000, 32))
    assert recall(spark, v, block=700) >= 0.9


def test_neighbours_of_clusters_probe_few_cells(spark):
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(60, 32)), 100, 0) + 0.2 * rng.normal(size=(6000, 32))
    book, _ = ann.fit(ann.usable(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")))
    assert book.probes <= 0.15 * len(book.cells)
    assert recall(spark, v) >= 0.9


def test_neighbours_with_repeated_ids(spark):
    rows = [(50, [1.0, 0.0, 0.1]), (7, [1.0, 0.1, 0.1]), (7, [1.0, 0.1, 0.1]), (7, [0.0, 1.0, 0.1]), (100, [0.0, 1.0, 0.0]), (100, [0.0, 0.9, 0.0]), (9, [0.3, 0.3, 1.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in out) == sorted([(50, i) for i in range(1, 6)] + [(100, i) for i in range(1, 6)] * 2)
    assert sorted(r["vec_id"] for r in out if r["query_id"] == 50) == [7, 7, 7, 9, 100]
    assert [r["vec_id"] for r in out if r["query_id"] == 100 and r["rank"] == 1] == [100, 100]


def test_neighbours_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in ann.nearest(few).collect()}
    assert got == {(0, 1): 50, (0, 2): 7, (50, 1): 0, (50, 2): 7} or got == {(0, 1): 50, (0, 2): 7, (50, 1): 7, (50, 2): 0}
    assert got[50, 1] == 0
    assert ann.nearest(few.limit(0)).isEmpty()


# language


def test_language_accuracy_and_edges(spark):
    rng = random.Random(3)
    sounds = {"aa": ["ba", "na", "ka", "la"], "ii": ["wi", "tri", "shi", "ni"], "oo": ["zo", "mo", "pro", "to"]}
    word = lambda x: "".join(rng.choice(sounds[x]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(x) for _ in range(rng.randint(3, 60))), x) for i in range(500) for x in [rng.choice([*sounds])]]
    df = spark.createDataFrame(rows + [(900, None, "aa"), (901, "123 !", "aa"), (902, "", None)], "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "rejected": F.lit("x")})
    out = langid.identify(df, langid.fit(df), keep=("lang",)).withColumn("held", langid.held_out(F.col("doc_id"))).toPandas()
    held = out[out["held"] & (out["doc_id"] < 900)]
    assert set(held["held"]) == {True} and (held["lang_pred"] == held["lang"]).mean() > 0.97
    assert all((zlib.crc32(str(d).encode()) % 3 == 1) == h for d, h in zip(out["doc_id"], out["held"]))
    odd = out[out["doc_id"] >= 900]
    assert set(odd["lang_pred"]) == {"und"} and set(odd["score"]) == {0.0} and odd["rejected"].all()
    assert out["score"].between(0, 1).all() and (~held["rejected"]).mean() > 0.95
    none = langid.fit(df.where("doc_id < 0"))
    assert set(r["lang_pred"] for r in langid.identify(df, none).collect()) == {"und"}


def test_language_sample_is_fair_to_the_rare(spark):
    """With more languages than the sample holds in full, each has about the same part of it, and texts are bounded in all."""
    df = spark.range(24_000).select("id", F.when(F.col("id") < 4000, F.concat(F.lit("rare"), F.col("id") % 10)).otherwise(F.concat(F.lit("common"), F.col("id") % 5)).alias("lang")).selectExpr("id as doc_id", "lang", "concat('text ', id) as text")
    from collections import Counter

    got = Counter(r["lang"] for r in langid.sample(df, per_lang=100, most=600))
    assert len(got) == 15 and min(got.values()) >= 20 and sum(got.values()) == 600
    long = df.where("doc_id < 300").withColumn("text", F.expr("repeat('ab ', 1000)"))
    assert 0 < len(langid.sample(long, chars=200_000)) <= 66
    with pytest.raises(ValueError):
        langid.identify(df.withColumn("score", F.lit(1)), langid.train([], []), keep=("score",))


def test_language_scores_are_calibrated():
    """Of predictions on noisy texts, the mean score is near the part that is right."""
    rng = random.Random(17)
    def text(a, n):
        return " ".join(rng.choice(["ba", "na", "ka"] if (rng.random() < 0.7) == a else ["wi", "tri", "shi"]) for _ in range(n))
    known = [(a, text(a, rng.randint(2, 9))) for a in (True, False) for _ in range(700)]
    m = langid.train([t for _, t in known], ["x" if a else "y" for a, _ in known])
    new = [(a, text(a, rng.randint(2, 9))) for a in (True, False) for _ in range(1500)]
    langs, probs, _ = m.predict([t for _, t in new])
    right = np.mean([("x" if a else "y") == p for (a, _), p in zip(new, langs)])
    assert 0.7 < right and abs(probs.mean() - right) < 0.06


def test_language_rejects_the_unknown():
    rng = random.Random(5)
    a, b = [prose(rng, 30) for _ in range(80)], [prose(rng, 30).translate(str.maketrans("aeio", "äöüß")) for _ in range(80)]
    m = langid.train(a + b, ["x"] * 80 + ["y"] * 80)
    langs, probs, reject = m.predict(["Это предложение написано по-русски и нигде не встречалось", a[0], b[0]])
    assert list(reject) == [True, False, False] and langs[1:] == ["x", "y"]
    long = m.predict([" ".join(a) * 60])[0]
    assert long == ["x"]


# near-duplicates


def test_distance_is_levenshtein():
    rng = random.Random(6)
    for _ in range(1500):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 14))]
        b = [rng.randrange(4) if rng.random() < 0.2 else x for x in a if rng.random() > 0.1] + [rng.randrange(4) for _ in range(rng.randint(0, 3))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        most = rng.randint(0, 9)
        assert order_minhash.distance(a, b, most) == min(row[-1], most + 1)


def test_sketches_do_not_depend_on_the_batch():
    rng = random.Random(7)
    texts = [prose(rng, n) for n in (1, 4, 5, 6, 200, 3000)] + ["", "the the the the the the the", "é" * 40_000]
    counts, rows = order_minhash.sketch_texts(texts)
    for i, t in enumerate(texts):
        n, alone = order_minhash.sketch_texts([t])
        assert n[0] == counts[i] == len(order_minhash.words(t)) and (alone[0] == rows[i]).all()


def test_near_duplicates_find_all_links(spark):
    rng = random.Random(8)
    base = [prose(rng, rng.randint(40, 150)).split() for _ in range(25)]
    rows = []
    for i, words in enumerate(base):
        for c in range(rng.randint(1, 6)):
            copy = [w if rng.random() > 0.04 * (c > 1) else f"new{rng.randint(0, 999)}" for w in words]
            rows.append((len(rows) * 3 + 1, " ".join(copy).upper() if c == 2 else " ".join(copy)))
    rows += [(i + 5000, t) for i, t in enumerate([rows[0][1]] * 400)]  # a large group of exact copies
    odd = [(9000 + i, t) for i, (_, t) in enumerate(ODD) if t is None or len(t) < 1000]
    out = order_minhash.near_duplicates(docs(spark, rows + odd)).collect()
    got = {r["doc_id"]: r["class_id"] for r in out}
    assert len(out) == len(rows) + len(odd)
    words = {d: order_minhash.words(t) for d, t in rows if d < 5000}
    parent = {d: d for d in words}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in words:
        for b in words:
            if a < b and order_minhash.similar(words[a], words[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {d: got[d] for d in words} == {d: find(d) for d in words}
    assert {got[d] for d, _ in rows if d >= 5000} == {got[1]}
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in out)
    nulls = [d for d, t in odd if t is None]
    assert all(got[d] == d for d in nulls)
    kept = order_minhash.keep_one(docs(spark, rows + odd))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(d for d, c in got.items() if d == c)


def test_near_duplicates_odd_rows(spark):
    got = [(r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(docs(spark, ODD)).collect()]
    assert len(got) == len(ODD) and (None, None) in got and got.count((3, 3)) == 2
    assert order_minhash.near_duplicates(docs(spark, ODD).limit(0)).isEmpty() and order_minhash.keep_one(docs(spark, ODD).limit(0)).isEmpty()
    one = order_minhash.keep_one(docs(spark, ODD).withColumn("class_id", F.lit(1)).withColumn("of", F.lit(2)))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in one.collect()))) == sorted({repr(x) for x in ODD}) and one.columns[-2:] == ["class_id", "of"]


def test_texts_of_one_id_are_apart(spark):
    rng = random.Random(31)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (5, a), (5, b), (5, b), (None, b + " end"), (None, "alone " + prose(rng, 9))]
    got = sorted(map(repr, ((r["doc_id"], r["class_id"], r["kept"]) for r in order_minhash.near_duplicates(docs(spark, rows)).collect())))
    assert got == sorted(map(repr, [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (None, 5, False), (None, None, True)]))
    assert sorted((r["doc_id"] or 0, r["text"]) for r in order_minhash.keep_one(docs(spark, rows)).collect()) == sorted([(1, a), (5, b), (0, rows[-1][1])])


def test_words_of_other_scripts():
    assert order_minhash.words("“Don’t”—no\u00a0way…") == [b"don", b"t", b"no", b"way"]
    assert order_minhash.words("日本、語。abc") == ["日".encode(), "本".encode(), "語".encode(), b"abc"] and len(order_minhash.words("ไทย")) == 3


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_links_share_a_sketch(low, high):
    """Of pairs with so much similarity, by words replaced at random places, 95 % are found."""
    rng = random.Random(int(low * 100))
    found = tried = 0
    while tried < 400:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(100, 400))]
        rate = rng.uniform(1 - high, 1 - low)
        other = [w if rng.random() > rate else f"n{rng.randint(0, 10**6)}" for w in base]
        alike = 1 - order_minhash.distance(base, other, len(base)) / len(base)
        if low <= alike < high:
            tried += 1
            _, rows = order_minhash.sketch_texts([" ".join(base), " ".join(other)])
            found += bool((rows[0] == rows[1]).any())
    assert found / tried >= 0.95


@pytest.mark.parametrize("centre", [0, 60, 119])
def test_near_duplicates_of_a_star(spark, centre, monkeypatch):
    """Every text that shares a sketch with the centre and is 0.8 like it is in its class, wherever the centre's id lies."""
    monkeypatch.setattr(order_minhash, "BLOCK", 16, raising=False)
    rng = random.Random(11)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(200)]
    texts = [[w if rng.random() > 0.14 else f"n{rng.randint(0, 10**6)}" for w in base] if i != centre else base for i in range(120)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    _, sketched = order_minhash.sketch_texts([" ".join(t) for t in texts])
    near = [i for i, t in enumerate(texts) if (sketched[i] == sketched[centre]).any() and order_minhash.similar(base, t)]
    assert len(near) > 60 and {got[i] for i in near} == {got[centre]}


def test_alike_texts_without_a_link_are_not_aligned(monkeypatch):
    """Of 40 texts that share most words, but too few for a link, none is aligned; a chain of links still connects all texts in it with the least component."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = [[w if rng.random() > 0.25 else f"n{rng.randint(0, 10**6)}" for w in base] for _ in range(40)]
    chain = [base]
    for k in range(4):
        chain.append([*chain[-1][: 70 * k], *(f"c{k}x{i}" for i in range(50)), *chain[-1][70 * k + 50 :]])
    texts += chain
    n = len(texts)
    hashes, counts = order_minhash.word_hashes([" ".join(t) for t in texts])
    zero = [0] * n
    table = order_minhash.pa.table({
        "family": zero, "low": zero, "high": zero, "rep": range(n), "component": [100 + n - i for i in range(n)], "block": zero, "n": counts,
        "brief": [[0] * order_minhash.SKETCHES] * n, "bag": [x.tobytes() for x in order_minhash.bags(hashes, counts)], "text": [" ".join(t) for t in texts],
    })
    asked, similar = [], order_minhash.similar
    monkeypatch.setattr(order_minhash, "similar", lambda a, b, least: asked.append(similar(a, b, least)) or asked[-1])
    monkeypatch.setattr(order_minhash, "SPLIT", 4000)
    edges = [(a, b) for out in order_minhash._links(0.8)(table.to_batches()) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    left, right, _ = order_minhash.candidates(table, 0.8)
    assert len(left) > 100 and len(asked) < 20
    assert sorted(edges) == [(101 + i, 101) for i in range(1, 5)]
    far = order_minhash.bounds(table["text"], np.asarray(counts), left, right)
    real = [order_minhash.distance(texts[i], texts[j], 400) for i, j in zip(left.tolist(), right.tolist())]
    assert (far <= real).all()


def test_bounds_are_at_most_distances():
    """Whatever edits, repeated words and lengths."""
    rng = random.Random(13)
    texts = [[f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 60))] for _ in range(20)]
    for t in texts[:20]:
        other = list(t)
        for _ in range(rng.randint(1, 12)):
            at = rng.randrange(len(other) + 1)
            other[at : at + rng.randint(0, 1)] = [f"w{rng.randint(0, 9)}"] * rng.randint(0, 1) or other[:1]
        texts.append(other)
    left, right = (np.array(x) for x in zip(*[(i, j) for i in range(40) for j in range(i + 1, 40)]))
    far = order_minhash.bounds(order_minhash.pa.chunked_array([[" ".join(t) for t in texts]]), np.array([len(t) for t in texts]), left, right)
    assert (far <= [order_minhash.distance(texts[i], texts[j], 100) for i, j in zip(left.tolist(), right.tolist())]).all() and (far > 0).any()


# pseudonyms


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 2**20, 10**15])
def test_permutation(size):
    xs = range(size) if size <= 1000 else random.Random(1).sample(range(size), 200)
    image = [pii.permute(x, size, b"k", b"t") for x in xs]
    assert len(set(image)) == len(image) and all(0 <= y < size for y in image)
    assert [pii.permute(y, size, b"k", b"t", back=True) for y in image] == list(xs)


def test_pseudonyms_keep_formats_and_links(spark):
    text = "mail jo.E42@ex-ample.org, card 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; ip 10.20.30.40 not 300.1.1.1; on 2024-02-29 not 2023-02-29; ssn 123-45-6789; +1 (017) 555-7713"
    new, spans = pii.pseudonymise(text, b"key")
    assert [s[2] for s in spans] == ["email", "card", "card", "ip", "date", "ssn", "phone"]
    assert len(new) >= len(text) - 8 and re.sub(r"\d", "9", new.split("card")[1].split(" or")[0]) == " 9999 9999 9999 9999"
    assert "not 4111111111111112" in new and "300.1.1.1" in new and "2023-02-29" in new and ".org" in new and "@ex-ample.org" not in new and "+1 (" in new
    for _, _, kind, alias in spans:
        assert kind != "card" or pii.luhn(re.sub(r"\D", "", alias))
    assert re.sub(r"\D", "", spans[1][3]) == re.sub(r"\D", "", spans[2][3])
    assert pii.pseudonymise(new, b"key", back=True)[0] == text
    assert pii.pseudonymise(text, b"other")[0] != new
    out = pii.pseudonyms(docs(spark, [*ODD, (50, text), (51, "again jo.E42@ex-ample.org")]), b"strataspan pseudonyms").collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == len(ODD) + 2 and by[1]["text"] is None and by[50]["text"].startswith("mail ")
    assert by[51]["spans"][0]["alias"] == pii.pseudonymise("jo.E42@ex-ample.org", b"strataspan pseudonyms")[0]


def test_pseudonyms_need_a_key(spark):
    with pytest.raises(ValueError):
        pii.pseudonyms(docs(spark, ODD), b"")
    assert pii.pseudonyms(docs(spark, ODD).limit(0), b"k").isEmpty()


FOUND = {
    "phone": ["+1 (017) 555-7713", "017-555-7713", "(017) 555.7713"],
    "international": ["+49 30 1234567", "+493012345678", "+33 1 23 45 67 89"],
    "number": ["5551234567"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"],
    "date": ["2024-02-29", "2024/02/29", "29.02.2024", "02/29/2024", "29/02/2024", "12 March 2020", "March 2, 2020", "3. April 2021", "1 août 1999", "9 de mayo de 2001"],
    "card": ["4111 1111 1111 1111", "3782 822463 10005", "378282246310005"],
    "ip6": ["2001:db8::1", "fe80:0:0:0:1:2:3:4"],
}
LEFT = ["30.02.2024", "13/13/2024", "31 June 2020", "DE88 3704 0044 0532 0130 00", "3782 822463 10004", "12:30:45", "1999", "+12", "32. Mai 2020", "3 Smarch 2020"]


@pytest.mark.parametrize("kind, value", [(k, v) for k, vs in FOUND.items() for v in vs])
def test_formats_are_found_and_come_back(kind, value):
    text = f"It is {value}, he said."
    new, spans = pii.pseudonymise(text, b"key")
    assert [(s[2], text[s[0] : s[1]]) for s in spans] == [(kind, value)] and new != text
    again, found = pii.pseudonymise(new, b"key", back=True)
    assert [s[2] for s in found] == [kind] and (again == text or kind == "ip6" and again == f"It is {pii.ipaddress.IPv6Address(value)}, he said.")


@pytest.mark.parametrize("value", LEFT)
def test_what_is_not_valid_stays(value):
    assert pii.pseudonymise(f"It is {value} or so", b"key") == (f"It is {value} or so", [])


def test_equal_values_stay_linked():
    alias = lambda t: pii.pseudonymise(t, b"key")[1][0][3]
    assert alias("JO@x-y.org").lower() == alias("jo@X-y.org").lower()
    assert alias("a@one.org").split("@")[1] == alias("b@one.org").split("@")[1] != alias("a@two.org").split("@")[1]
    assert pii._read_date(alias("2020-03-12"))[1] == pii._read_date(alias("12.03.2020"))[1]
    assert alias("2001:DB8:0::1") == alias("2001:db8::1")


# pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces()


@pytest.mark.parametrize("size", [64, 97, 1000])
def test_chunked_encoding_is_the_librarys(model, size):
    rng = random.Random(size)
    texts = [prose(rng, 300), "a" * 700, "é☃" * 300, "x  y   z" * 60, " " * 300, "".join(rng.choice("etaoin srhldcu") for _ in range(2500)), "".join(rng.choice("abcde") for _ in range(2500)), "\n\n\t" * 90 + "end", "", "q"]
    for t in texts:
        assert pieces.encode_chunked(t, model, size) == model.lib.encode(t)
        assert model.decode(model.lib.encode(t)).decode()[1:] == t


def test_matrices_combine_associatively(model):
    text = pieces.normal("".join(random.Random(2).choice("abcde") for _ in range(900)))
    m = [pieces.transfer(model, *c) for c in pieces.chunks(text, 128, model.longest)]
    left, right = m[0], m[-1]
    for x in m[1:]:
        left = pieces.combine(left, x)
    for x in m[-2::-1]:
        right = pieces.combine(x, right)
    assert left == right == [(pieces.EDGE, pieces.EDGE)]


def test_states_come_from_a_tree(spark, model):
    """The tree's states are those of a pass over all chunks, with several levels and several documents."""
    rng = random.Random(3)
    texts = [pieces.normal("".join(rng.choice("abcde  ") for _ in range(n))) for n in (700, 9000, 65, 3000)]
    all_ = [[pieces.transfer(model, *c) for c in pieces.chunks(t, 64, model.longest)] for t in texts]
    rows = [(i, k, [x for x, _ in m], [y for _, y in m]) for i, ms in enumerate(all_) for k, m in enumerate(ms)]
    rng.shuffle(rows)
    got = {(r["row"], r["chunk"]): (r["x"], r["y"]) for r in pieces.scan(spark.createDataFrame(rows, pieces._MATRIX), fan=3).collect()}
    assert got == {(i, k): s for i, ms in enumerate(all_) for k, s in enumerate(pieces.solve(ms))} and max(map(len, all_)) > 81
    with pytest.raises(ValueError):
        pieces.solve([[(pieces.EDGE, 1)], [(2, pieces.EDGE)]])


def test_decoding_gives_the_texts(spark):
    rows = [*ODD[:4], (30, "".join(random.Random(9).choice("abcd ☃é") for _ in range(5000))), (31, " leading and  double ")]
    out = {}
    for r in pieces.decode(pieces.encode(docs(spark, rows), size=400)).collect():
        out.setdefault((r["doc_id"], r["row"]), {})[r["chunk"]] = r["text"]
    assert sorted((d, "".join(c[k] for k in sorted(c))) for (d, _), c in out.items()) == sorted((d, t or "") for d, t in rows)


def test_encoding_query(spark, model):
    rows = [*ODD, (30, "".join(random.Random(9).choice("abcdefgh ") for _ in range(5000)))]
    coded = pieces.encode(docs(spark, rows), size=500)
    out = {}
    for r in coded.collect():
        assert r["whole"]
        out.setdefault((r["doc_id"], r["row"]), []).append((r["chunk"], r["ids"]))
    got = sorted(((d or -1), [i for _, ids in sorted(c) for i in ids]) for (d, _), c in out.items())
    assert got == sorted(((d or -1), model.lib.encode(t or "")) for d, t in rows)
    n = {r["doc_id"]: r["n_tokens"] for r in pieces.digest(coded).collect() if r["doc_id"]}
    assert n[30] == len(model.lib.encode(rows[-1][1])) and n[1] == 0
    assert pieces.digest(pieces.encode(docs(spark, rows).limit(0))).isEmpty()


def test_chunks_take_little_disk(spark, model):
    """The chunks lie in the checkpoint compressed, and the shuffle that dealt them out goes."""
    rng = random.Random(11)
    words = ["".join(rng.choice("etaoinsrhldcu") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows = [(i, "▁ é" + " ".join(rng.choice(words) for _ in range(30_000))) for i in range(12)]
    raw, context = sum(len(t.encode()) for _, t in rows), spark.sparkContext

    def checkpoints():
        return sum(f.stat().st_size for f in Path(context.getCheckpointDir().removeprefix("file:")).rglob("part-*"))

    def shuffles():
        files = context._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(f.length() for f in (files.apply(i) for i in range(files.length())) if f.getName().startswith("shuffle_") and f.getName().endswith(".data"))

    pieces.checkpointed(spark.range(1))
    kept, dealt, setting = checkpoints(), shuffles(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    coded = pieces.encode(docs(spark, rows))
    assert checkpoints() - kept < 0.6 * raw and spark.conf.get(setting, None) == was
    until = time.monotonic() + 20
    while shuffles() - dealt > 0.1 * raw and time.monotonic() < until:
        time.sleep(0.2)
    assert shuffles() - dealt < 0.1 * raw
    got = {}
    for r in coded.collect():
        got.setdefault(r["doc_id"], {})[r["chunk"]] = r["ids"]
    assert {d: [i for k in sorted(c) for i in c[k]] for d, c in got.items()} == {d: model.lib.encode(t) for d, t in rows}


# lines


def brute_stretches(rows, min_words=8, min_run=25):
    """Of every distinct (doc_id, text), the words that go, by position: a plain scan over all pieces of all texts, without hashes."""
    docs = sorted({(d is not None, d or 0, t) for d, t in rows if t}, key=lambda x: (x[0], x[1], lines_key(x[2])))
    seen, gone = set(), {}
    for known, d, t in docs:
        pieces, at = [], 0
        for m in [*re.finditer(r"(?<=[.!?;:,])[^\w\s]*\s+|\s*\n\s*", t), None]:
            if words := t[at : m.start() if m else len(t)].casefold().split():
                pieces.append(words)
            at = m.end() if m else at
        total = sum(map(len, pieces))
        if total < min_words:
            gone[(d if known else None, t)] = []
            continue
        marks, at, found = [False] * total, 0, []
        last = max(i for i in range(len(pieces)) if sum(map(len, pieces[i:])) >= min_words)
        for i in range(len(pieces)):
            unit = []
            for p in pieces[i:]:
                unit += p
                if len(unit) >= min_words and i != last:
                    break
            if i <= last:
                whole = tuple(w for p in pieces[i:] for w in p)
                shortest = []
                for p in pieces[i:]:
                    shortest += p
                    if len(shortest) >= min_words:
                        break
                found.append((at, tuple(shortest)))
                if i == last and len(whole) > len(shortest):
                    found.append((at, whole))
            at += len(pieces[i])
        for a, unit in found:
            if unit in seen:
                marks[a : a + len(unit)] = [True] * len(unit)
            seen.add(unit)
        out, a = [], 0
        while a < total:
            b = a
            while b < total and marks[b] == marks[a]:
                b += 1
            if marks[a] and (b - a >= min_run or b - a == total):
                out.append((a, b))
            a = b
        gone[(d if known else None, t)] = out
    return gone


def lines_key(text):
    return KEYS[text]


KEYS = {}


def test_repeated_stretches_go_but_the_earliest(spark):
    rng = random.Random(10)
    sentence = lambda n: prose(rng, n).capitalize() + rng.choice([".", "!", ".", ","])
    shared = [" ".join(sentence(rng.randint(1, 9)) for _ in range(n)) for n in (1, 2, 6, 9, 12)]
    rows = []
    for d in range(60):
        own = [sentence(rng.randint(1, 14)) for _ in range(6)]
        own.insert(rng.randint(0, 6), rng.choice(shared))
        rows.append((d + 100, rng.choice([" ", "\n", "\n\n"]).join(own)))
    rows += [(199, "too short here.\ntoo short here."), *[(200, rows[3][1])] * 2, (205, rows[3][1]), (205, rows[4][1] + " " + sentence(40)), (None, rows[5][1]), (None, rows[6][1] + " tail")]
    KEYS.update((r["t"], r["k"]) for r in spark.createDataFrame([(t,) for _, t in rows if t], "t string").select("t", F.xxhash64("t").alias("k")).distinct().collect())
    out = lines.dedup_lines(docs(spark, [*rows, *ODD])).collect()
    assert len(out) == len(rows) + len(ODD)
    want = brute_stretches(rows)
    texts = dict(((d, KEYS[t]), t) for d, t in rows)
    seen = 0
    for r in out:
        for (d, t), gone in want.items():
            words, at, cut = t.split(), 0, [(s["start"], s["end"]) for s in r["removed"]]
            if d != r["doc_id"] or "".join([*(t[a:b] for a, b in zip([0, *(y for _, y in cut)], [*(x for x, _ in cut), len(t)]))]) != r["text"]:
                continue
            if [(len(t[:a].split()), len(t[:b].split())) for a, b in cut] == gone:
                seen += 1
                break
        else:
            assert r["doc_id"] in (None, 1, 2, 3, 4, 5, 6) and r["n_removed"] == 0
    assert seen >= len(rows) and sum(map(bool, want.values())) > 25 and texts


def test_rows_of_one_id_are_cut_alone(spark):
    rng = random.Random(21)
    a, b = prose(rng, 60) + ".", prose(rng, 60) + "."
    out = sorted((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(docs(spark, [(1, a), (5, a), (5, b), (5, b)])).collect())
    assert out == sorted([(1, a, 0), (5, "", 1), (5, b, 0), (5, b, 0)])
    assert lines.dedup_lines(docs(spark, ODD).limit(0)).isEmpty()


def test_short_pieces_have_units(spark):
    """A repeated passage of 50 words loses most of them, however short its sentences and lines are."""
    rng = random.Random(13)
    name = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    for most in (1, 2, 5, 9):
        rows, shared = [], []
        for d in range(20):
            pieces = []
            while sum(map(len, pieces)) < 60:
                pieces.append([name() for _ in range(rng.randint(1, most))])
            shared.append(" ".join(w for p in pieces for w in [*p[:-1], p[-1] + rng.choice([".", "!!", ".\n"])]))
            rows += [(2 * d, f"{name()}. {shared[d]} {name()}."), (2 * d + 1, " ".join(f"{name()}." for _ in range(9)) + " " + shared[d] + f" {name()} {name()}. {name()}.")]
        out = {r["doc_id"]: r for r in lines.dedup_lines(docs(spark, rows)).collect()}
        for d in range(20):
            assert out[2 * d]["n_removed"] == 0
            assert len(out[2 * d + 1]["text"].split()) <= 12 + 20
    same = "\n".join(f"{name()}.!!" for _ in range(150))
    few = " ".join(name() for _ in range(8))
    copies = {r["doc_id"]: r["text"].split() for r in lines.dedup_lines(docs(spark, [(1, same), (2, same), (3, "one. two. three."), (4, "one. two. three."), (5, few), (6, few)])).collect()}
    assert len(copies[1]) == 150 and not copies[2] and len(copies[4]) == 3 and len(copies[5]) == 8 and not copies[6]


def test_a_common_line_stays(spark):
    rng = random.Random(14)
    line = "one very common line that stands in each and every text"
    rows = [(i, f"{prose(rng, 30)}.\n{line}\n{prose(rng, 30)}.") for i in range(300)]
    out = lines.dedup_lines(docs(spark, rows).repartition(7))
    assert out.where("n_removed > 0").isEmpty()
    assert lines.dedup_lines(docs(spark, rows).repartition(7), min_run=0).where("n_removed = 1").count() == 299


# secrets

BRUTE = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(x):
    out = [("assign", m.start(), m.end(), 0) for m in BRUTE.finditer(x) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in sorted(out, key=lambda y: (y[1], y[3])))


def test_secrets_match_brute_force(spark):
    rng = random.Random(12)
    bits = ["password=", "TOKEN : ", "api_key='", "apikey\" = \"", "secret:", "passwd==", "AKIA", "AKIAAKIA", "é☃", " ", "\n", "deadbeef", "0123456789abcdef", "ABCDEFGH12345678", "x", ".", "=", "token=secret=", "api_key:longvalue1234"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 25))), f"o{i % 3}") for i in range(400)] + ODD
    out = secrets.scan_secrets(docs(spark, rows)).collect()
    got = sorted(((r["doc_id"] or -1), r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in out)
    count = lambda s, k: sum(x.startswith(k) for x in s.split(","))
    want = sorted(((d or -1), hashlib.sha256(s.encode()).hexdigest(), count(s, "assign"), count(s, "access"), count(s, "hex")) for d, t, *_ in rows for s in [brute(t or "")])
    assert got == want
    assert all(r["spans"] == brute(dict((x[0], x[1]) for x in rows)[r["doc_id"]]) for r in out if r["doc_id"] and 6 < r["doc_id"] < 400)


def test_ownership_separates_copied_from_live(spark):
    example, own = "token=abcdefghijkl0000", "token=Zyxwvutsrq987654"
    rows = [(100 + i, f"see {example} here", f"owner{i}") for i in range(5)] + [(110 + i, f"my {own}", "one") for i in range(4)] + [(120, "plain", None)]
    out = {r["doc_id"]: (r["n_live"], r["n_copied"]) for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert out[100] == (0, 1) and out[110] == (1, 0) and out[120] == (0, 0)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs(spark, rows + ODD)).collect()}
    assert clean[100] == f"see {example} here" and clean[110] == "my [SECRET]" and clean[1] is None and clean[120] == "plain"
    assert secrets.redact(docs(spark, rows).limit(0)).isEmpty()


def test_ownership_counts_distinct_repositories_and_owners(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\n{}\n-----END RSA PRIVATE KEY-----"
    rows = [(1, "token=abcdefghijkl0000 token=abcdefghijkl0000 again token=abcdefghijkl0000", "a"), (2, "token=abcdefghijkl0000", "b"), (2, "token=abcdefghijkl0000", "b")]
    rows += [(10 + i, "x " + key.format(f"Zm9vYmFy{i}zzzz=="), f"o{i}") for i in range(5)] + [(20, key.format("c2hhcmVk"), "a"), (30, "-----BEGIN PRIVATE KEY----- gone", "a")]
    rows += [(1000 + i, "password=manyrepositories1", f"o{i % 2}") for i in range(60)]
    out = {r["doc_id"]: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert (out[1]["max_repositories"], out[1]["max_owners"], out[1]["n_live"], out[1]["n_copied"]) == (2, 2, 3, 0)
    assert all((out[10 + i]["max_repositories"], out[10 + i]["n_live"]) == (1, 1) for i in range(5)) and out[30]["n_issued"] == 1
    assert (out[1000]["max_repositories"], out[1000]["max_owners"], out[1000]["n_copied"]) == (60, 2, 1)
    odd = docs(spark, rows + ODD).withColumns({"__found": F.lit(1), "_found": F.lit(2), "secret": F.lit(3), "s": F.lit(4), "salt": F.lit(5), "live": F.lit(6)})
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and {r["text"] for r in clean.where("doc_id between 10 and 14").collect()} == {"x [SECRET]"}


def test_secrets_in_a_long_text(spark):
    text = " ".join(f"{i:016x} token=abcdefghijkl{i}" for i in range(3000))
    row = secrets.scan_secrets(docs(spark, [(1, text)])).first()
    assert (row["n_hex"], row["n_assign"]) == (3000, 3000) and row["spans"] == brute(text)


def test_slices():
    assert list(slices([], 5)) == [] and list(slices([9, 1, 1, 9, 0], 5)) == [(0, 1), (1, 3), (3, 4), (4, 5)]
