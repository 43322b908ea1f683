"""Sharding, URL verdicts, HTML extraction, embeddings and the pipeline."""

import random
import time

import numpy as np
import pytest

from tallyloom.llm import embeddings, html, sharding, urls

# Sharding


def test_differencing_beats_dealing_in_order():
    rng = np.random.default_rng(1)
    sizes = rng.lognormal(8, 1.5, 3000).astype(np.int64)
    start = np.zeros((3000, 24), np.int64)
    start[:, 0] = sizes
    labels = sharding.difference(start)
    assert sorted(set(labels[:, 0])) == list(range(24)) and (np.sort(labels, axis=1) == np.arange(24)).all()
    sums = np.bincount(labels[:, 0], sizes, minlength=24)
    greedy = np.zeros(24)
    for s in -np.sort(-sizes):
        greedy[greedy.argmin()] += s
    assert np.ptp(sums) <= np.ptp(greedy) and np.ptp(sums) <= sizes.min() * 4 + 40


@pytest.mark.parametrize("chunk,fan", [(1 << 15, 512), (50, 2)])
def test_shards_are_whole_gapless_and_near_equal(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(sharding, "FAN_IN", fan)
    monkeypatch.setattr(sharding, "SLOT_ROWS", 5)
    monkeypatch.setattr(sharding.assign, "__defaults__", (24, chunk))
    rng = random.Random(2)
    rows = [(k, "é" * rng.randrange(1, 400) + str(k % 300)) for k in range(600)] + [(k, "copy " * 200) for k in range(600, 640)] + [(900, None), (901, ""), (None, "x"), (5, "again")]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    import zlib
    from collections import Counter, defaultdict

    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, sums, homes = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sums[r["shard"]] += r["size"]
        homes[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(24))
    assert all(len(h) == 1 for (_, size), h in homes.items() if size > 9)
    rest = sorted(sums.values())[:-1]
    assert max(rest) - min(rest) <= 0.05 * max(rest) or chunk == 50
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in got)
    assert sharding.shards(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# URLs

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow")]


def test_urls_match_brute_force(spark):
    cases = [None, "", "nothing", "http://", "HTTP://WWW.Example.COM/en/x?q#f", "https://a.example.com/en/", "https://example.com/EN/", "https://x.net/es/y", "https://x.net/es", "https://org.example.org/spam/?a", "https://www.org.example.org/spam", "https://org.example.org/spam/index.html#t", "https://org.example.org/ham", "a://b?c/d", "x://net", "https://É.net/es/", "https://notcom/", "https://example.com/en/" + "z" * 50_000]
    pages = spark.createDataFrame([(k, u, "host") for k, u in enumerate(cases + cases)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("http://org.example.org/spam",), (None,), ("bad",), ("https://other.example.org/1",)], "url string")
    got = {r["page_id"]: r for r in urls.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), listed).collect()}
    assert len(got) == 2 * len(cases)
    for k, u in enumerate(cases + cases):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        verdict = best[2] if best else "block" if host.removeprefix("www.") == "org.example.org" and path.startswith("/spam") else "allow"
        r = got[k]
        assert (r["host_"], r["path"], r["rule"], r["verdict"], r["host"]) == (host, path, best and best[1], verdict, "host"), u


def test_urls_with_clashing_columns_deep_rules_and_empty_tables(spark, monkeypatch):
    """Also with a filter that is joined by block instead of broadcast, and a list that tells nothing in the host."""
    monkeypatch.setattr(urls, "MAX_BLOCKS", 2)
    pages = spark.createDataFrame([(k, f"https://h{k}.org/p", "a", "b", k) for k in range(400)] + [(999, "https://" + "a." * 20_000 + "b.c/x/y", None, None, 0)], "page_id long, url string, listed string, best string, judged_host int")
    rules = spark.createDataFrame([("a.b.c", "/x", "block"), ("b.c", "/x/", "allow"), ("h7.org", "", "allow")], "host string, path string, verdict string")
    listed = spark.createDataFrame([(f"http://www.h{k}.org/p/",) for k in range(0, 400, 7)], "url string")
    out = urls.judge(pages, rules, listed)
    assert out.columns == [*pages.columns, "host", "path", "rule", "verdict"]
    got = {r["page_id"]: r for r in out.collect()}
    assert {k for k, r in got.items() if r["verdict"] == "block"} == {k for k in range(0, 400, 7) if k != 7} | {999} - {7}
    assert got[7]["rule"] == "h7.org" and got[999]["rule"] == "a.b.c/x" and got[3]["listed"] == "a" and got[3]["judged_host"] == 3
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    assert urls.judge(pages, rules.limit(0), listed.limit(0)).where("verdict = 'allow' and rule is null").count() == 401


def test_bloom_passes_every_key_and_few_others(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.concat(F.lit("key "), "id").alias("key"))
    table, blocks = urls.bloom(keys, 20_000)
    at, words = urls._bits(F.col("key"))
    asked = spark.range(40_000).select(F.concat(F.lit("key "), "id").alias("key"), "id").select("id", F.pmod(at, F.lit(blocks)).alias("block"), *(w.alias(f"m{i}") for i, w in enumerate(words)))
    hit = asked.join(table, "block").where(" and ".join(f"(w{i} & m{i}) = m{i}" for i in range(4)))
    n = {r["own"]: r["count"] for r in hit.groupBy((F.col("id") < 20_000).alias("own")).count().collect()}
    assert n[True] == 20_000 and n.get(False, 0) < 1_000
    empty, _ = urls.bloom(keys.limit(0), 0)
    assert empty.count() == 0


# HTML


@pytest.fixture(scope="module")
def labeller(spark):
    return html.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><div>My site</div></header><div class="cookie-notice"><p>We use cookies on this site. Accept them please.</p></div><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav>
<main><article><h1>The big   story &amp; more</h1><p>First paragraph with <a href=x>a link</a>, <b>bold</b><br>text&nbsp;and &eacute;.<p>Second paragraph follows, it is rather long as well, with commas.
<aside><p>Related: another story</p></aside><div class="ad">Buy now!</div><form><label>Your e-mail</label></form><p>Third paragraph ends the story here.</p></article>
<section class="comments"><div class="comment"><p>Nice article, I liked it very much.</p></div></section></main><footer>&copy; 2024 My site</footer></body></html>"""


def test_main_text_of_a_page(labeller):
    assert labeller.texts([PAGE, "", None, "<p>"]) == ["The big story & more\nFirst paragraph with a link, bold text and é.\nSecond paragraph follows, it is rather long as well, with commas.\nThird paragraph ends the story here.", "", "", ""]


def test_articles_of_real_pages_are_whole(spark, labeller):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    got = {r["page_id"]: r for r in html.extract(pages, labeller).collect()}
    for r in pages.collect():
        want = "\n".join(t for t, path, _ in html.blocks(r["html"]) if html.told(path))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    assert html.extract(pages.limit(0), labeller).columns == ["page_id", "url", "text", "n_chars"]


def shown(page):
    return [t for t, _, _ in html.blocks(page)]


def test_text_behind_open_controls_is_not_lost():
    assert shown("<body><button>Go<p>Article</p>") == ["Article"]
    assert shown("<select><option>x<p>text") == ["text"]
    assert shown("<svg><p>in</p>") == ["in"]
    assert shown("<head><title>T</title><article>No body tag</article>") == ["No body tag"]
    assert shown("<p>One <button>Go</button> two<svg><text>no</text></svg> three</p>") == ["One two three"]
    assert len(shown("<div>x" * 3000)) == 3000


def test_text_in_a_head_ends_it():
    assert shown("<html><head><title>T</title>Plain words of the article.</html>") == ["Plain words of the article."]
    assert shown("<head> <title>T</title>\n<style>p {}</style> <meta name=a> Words<p>more") == ["Words", "more"]


@pytest.mark.parametrize("page, n", [("<div>" * 100_000 + "x", 1), ("<div>x" * 50_000, 50_000), ("<b>" * 50_000 + "<div>x</div>" * 50_000, 50_000), ("<div>" * 50_000 + "x</b></p></li>" * 50_000, 50_000), ("<p><a>x" * 50_000, 50_000), ("<div>" * 50_000 + "<select><option>a<p>x</p>" * 20_000, 20_000)])
def test_many_open_tags_take_no_longer(page, n):
    start = time.process_time()
    found = html.blocks(page)
    [html.told(path) for _, path, _ in found]
    assert len(found) == n and time.process_time() - start < 6


def test_long_pages_are_labelled_as_in_one_piece(labeller):
    page = html.blocks("".join(body for body, _ in HAND_MADE) * 20)
    whole = html.label(labeller.weights, [html.vectors(page)])[0]
    for step in (1, 7, 100, 10_000):
        assert (html.label_long(labeller.weights, page, step) == whole).all()


LONG = " ".join(f"Sentence number {k} goes on, and on." for k in range(2000))
HAND_MADE = [
    ("<html><body><div><h1>Harbour opens again</h1><p>The harbour opened on Monday, after two years of work.</p><p>Ships came in from the north.</p></div></body></html>", ["Harbour opens again", "The harbour opened on Monday, after two years of work.", "Ships came in from the north."]),
    ("<body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><main><p>Only this one is the text, says the editor.</p></main><footer>All rights reserved.</footer>", ["Only this one is the text, says the editor."]),
    (f"<body><header><a href=/>Site</a></header><article><h1>Long</h1><p>{LONG}</p></article><aside><ul><li><a>Buy now and save 50%</a></ul></aside></body>", ["Long", LONG]),
    ("<article>" + "<div>" * 12 + "<p>Deep inside many boxes there is a paragraph of the article.</p>" + "</div>" * 12 + "</article><div class=comments><div class=comment><p>Nice one, thanks!</p></div></div>", ["Deep inside many boxes there is a paragraph of the article."]),
]


@pytest.mark.parametrize("page, want", HAND_MADE)
def test_hand_written_pages(labeller, page, want):
    assert labeller.texts([page]) == ["\n".join(want)]


def test_repeats_and_clashing_columns_of_pages(spark, labeller):
    pages = spark.createDataFrame([(1, HAND_MADE[1][0], "t"), (1, HAND_MADE[1][0], "t"), (None, None, None)], "page_id long, html string, text string")
    out = html.extract(pages, labeller)
    assert out.columns == ["page_id", "text", "text_", "n_chars"] and sorted(r["n_chars"] for r in out.collect()) == [0, 43, 43]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    w = {k: x.astype(np.float64) for k, x in html.start_weights(5, rng).items()}
    x, mask, y = rng.standard_normal((4, 2, 5)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float), rng.integers(0, 2, (4, 2)).astype(float)
    loss = lambda: float(-(mask * (y * np.log(p := html.forward(w, x, mask)[0]) + (1 - y) * np.log(1 - p))).sum() / mask.sum())
    p, both, tf, tb = html.forward(w, x, mask, keep=True)
    d = ((p - y) * mask / mask.sum())[..., None]
    grad = html._back(x, mask, w["Wf"], tf, (d @ w["o"].T)[..., : html.HIDDEN])[0]
    for i, j in [(0, 0), (3, 25), (7, 50), (9, 70)]:
        old = w["Wf"][i, j]
        w["Wf"][i, j] = old + 1e-3
        up = loss()
        w["Wf"][i, j] = old - 1e-3
        down = loss()
        w["Wf"][i, j] = old
        assert abs((up - down) / 2e-3 - grad[i, j]) < 2e-3


# Embeddings


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    ok = [(i, v / np.linalg.norm(v)) for i, v in ok]
    linked = [[j for j, (b, w) in enumerate(ok) if j != k and len(w) == len(v) and v @ w >= threshold] for k, (a, v) in enumerate(ok)]
    parent = {i: i for i, _ in ok}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, js in enumerate(linked):
        for j in js:
            a, b = root(ok[k][0]), root(ok[j][0])
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(js), root(i)) for (i, _), js in zip(ok, linked, strict=True))


@pytest.mark.parametrize("rows_a_tile", [8192, 40])
def test_links_match_brute_force(spark, monkeypatch, rows_a_tile):
    monkeypatch.setattr(embeddings, "TILE_ROWS", rows_a_tile)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 16))
    x = np.concatenate([base[rng.integers(12, size=300)] + rng.standard_normal((300, 16)) * 0.28, np.repeat(base[:1], 40, axis=0), rng.standard_normal((60, 16))]).astype(np.float32)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [3.0]), (906, [5.0]), (907, [1e-30] + [0.0] * 15), (908, [2e30] + [0.0] * 15)]
    got = embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    want = {i: (n, c) for i, n, c in brute_links(rows)}
    for r in got:
        assert (r["n_links"], r["component_id"]) == want.get(r["vec_id"], (0, r["vec_id"]))
    assert embeddings.near(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_rows_without_an_id_are_compared(spark):
    """Two rows without an id connect 1 and 2, which are not alike themselves; others reach no id."""
    turn = lambda degrees: [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))]
    rows = [(2, turn(0)), (None, turn(20)), (None, turn(20)), (1, turn(40)), (None, turn(120)), (None, turn(121)), (None, None), (3, turn(200)), (None, [0.0, 0.0])]
    got = embeddings.near(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    told = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str)
    assert told == sorted([(2, 2, 1, False), (None, 3, 1, False), (None, 3, 1, False), (1, 2, 1, True), (None, 1, None, True), (None, 1, None, False), (None, 0, None, True), (3, 0, 3, True), (None, 0, None, True)], key=str)


@pytest.mark.parametrize("open_pairs", [0, 10**6])
def test_pairs_that_codes_leave_open(spark, monkeypatch, open_pairs):
    """Many cosines lie at 0.9: they are decided pair by pair, or by their tiles' vectors."""
    monkeypatch.setattr(embeddings, "TILE_ROWS", 60)
    monkeypatch.setattr(embeddings, "OPEN_PAIRS", open_pairs)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((4, 8))
    x = base[rng.integers(4, size=200)] + rng.standard_normal((200, 8)) * 0.33
    rows = [(k // 2 if k < 20 else k, [float(c) for c in v]) for k, v in enumerate(x)] + [(500, [1.0] * 5), (501, [1.0] * 5), (502, [1.0, 1.0, 1.0, 1.0, 1.1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, unit string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embeddings.near(docs).collect())
    unit = [np.array(v) / np.linalg.norm(v) for _, v in rows]
    near = [[len(u) == len(v) and k != j and u @ v >= 0.9 for j, v in enumerate(unit)] for k, u in enumerate(unit)]
    parent = {i: i for i, _ in rows}
    for _ in rows:
        for k, (i, _) in enumerate(rows):
            for j, ok in enumerate(near[k]):
                if ok:
                    parent[i] = parent[rows[j][0]] = min(parent[i], parent[rows[j][0]])
    assert got == sorted((i, sum(near[k]), parent[i]) for k, (i, _) in enumerate(rows))


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((500, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, error = embeddings.quantise(x)
    near = embeddings.products(codes, codes) * scale[:, None] * scale[None, :]
    bound = error[:, None] + (1 + error[:, None]) * error[None, :] + 1e-6
    assert (np.abs(x @ x.T - near) <= bound).all()
    big = rng.integers(-127, 128, (3, 3000)).astype(np.int8)
    assert (embeddings.products(big, big) == big.astype(np.int64) @ big.astype(np.int64).T).all()


# Pipeline


def test_pipeline_matches_its_stages_one_by_one(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "byte_bpe"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, sf)
        assert seen.columns == docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in seen.select("doc_id").collect()}
    assert out.where("not round_trip").count() == 0 and 0 < out.count() < docs.count()
