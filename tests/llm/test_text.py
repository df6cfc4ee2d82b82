"""Archives, tokens, packing, language, mixing, extraction, privacy: against brute force and round trips."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import LONG, SCHEMA, awkward, documents
from pyspark.sql import functions as F

from voxlattice.llm import html_extract, langid, mixing, packing, token_counts, warc
from voxlattice.llm.scratch import scratch_path

PAGES = "page_id long, url string, html string"


# WARC --------------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    odd = "<p>a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n\r\n</p>\n\n"
    pages = [(1, "http://a/ b", "x"), (2, None, "x"), (3, "u", ""), (4, "u", None), (5, "u", odd), (6, "u", odd + "\n"), (7, "u", "é" * 1000), (8, "u", LONG), (None, "u", "null id")]
    repeated = warc.archive_round_trip(spark.createDataFrame([(1, "u", "r"), (1, "u", "r"), (1, "u", "other"), (None, "u", "r"), (None, "u", "r")], PAGES)).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in repeated) == [("1", "response", "None")] * 3 + [("None", "revisit", "1")] * 2
    got = {r["page_id"]: r for r in warc.archive_round_trip(spark.createDataFrame(pages, PAGES)).collect()}
    assert len(got) == len(pages)
    same = defaultdict(list)
    for p, _, h in pages:
        same[h or ""].append(p)
    for p, _, h in pages:
        raw, top = (h or "").encode(), max((x for x in same[h or ""] if x is not None), default=None)
        want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == top else "revisit", None if p == top else top)
        assert tuple(got[p][k] for k in ("payload_bytes", "payload_digest", "record_type", "refers_to")) == want
        assert got[p]["declared_digest"] == want[1]
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_captures_are_nested(spark):
    path = scratch_path(spark, "warc-test")
    warc.write_warc(spark.createDataFrame([(1, "u", "body"), (2, "v", "body")], PAGES), path)
    rows = {r["uri"]: r for r in warc.assemble(warc.read_warc(spark, path)).collect()}
    assert rows["v"]["response"]["payload"] == b"body" and rows["u"]["response"]["type"] == "revisit"
    assert rows["u"]["request"]["http_head"].startswith("GET") and b"page_id: 1" in bytes(rows["u"]["metadata"]["payload"])
    lines = spark.read.option("lineSep", "\n").text(path).where("value like 'WARC/1.1%'").count()
    assert lines == 6


# Tokens ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    pytest.importorskip("public_tokenizers")
    return token_counts.default_vocabulary()


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_add_up(spark, vocabulary, rule):
    encoding, _ = token_counts.load_encoder(*vocabulary)
    rows = [*awkward(), (20, "a\n\nb  \n \n\ncé\n", "en", "a", 1)]
    got = token_counts.section_token_counts(documents(spark, rows), *vocabulary, rule).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for d, t, *_ in rows:
        n = len(encoding.encode_ordinary(t or ""))
        parts = by_doc[d, n]
        assert parts and abs(sum(r["tokens"] for r in parts) % n if n else 0) < 1e-6
    parts = sorted(by_doc[20, len(encoding.encode_ordinary(rows[-1][1]))], key=lambda r: r["section"])
    assert [(r["start_char"], r["end_char"]) for r in parts] == [(0, 2), (2, 3), (3, 7), (7, 9), (9, 10), (10, 13)]
    with pytest.raises(ValueError):
        token_counts.section_token_counts(documents(spark), *vocabulary, "guess")


def test_crossing_tokens_by_rule():
    lengths, cuts = np.array([2, 3, 1]), np.array([0, 3, 6])
    for rule, want in (("start", [2, 1]), ("majority", [1, 2]), ("split", [1 + 1 / 3, 1 + 2 / 3])):
        counts, crossing = token_counts.attribute(lengths, cuts, rule)
        assert np.allclose(counts, want) and crossing.tolist() == [1, 0]


# Packing -------------------------------------------------------------------------------------------------------------------


def test_chunked_ids_are_the_whole_text_ids():
    pytest.importorskip("public_tokenizers")
    tk = packing.tokenizer(packing.default_tokenizer())
    texts = ["", "It's HERE,'s ok", "Ünïcödé é 日本語!? 1234", "a\x1cb\x0bc d e", "ΣΑΣ İI", "x" * 300, "<|endoftext|> a", LONG, "--don't--!!", "½²٣ ⅧⅦ ﬁ"]
    ids, at = tk.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tk.base.encode(t, add_special_tokens=False).ids


def test_ids_of_every_code_point():
    """Alone between letters, and in random mixtures, as the tokenizer gives them for the whole text."""
    pytest.importorskip("public_tokenizers")
    tk = packing.tokenizer(packing.default_tokenizer())
    points = [chr(c) for c in range(0x32000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0xE0000, 0xE0200)]
    rng = np.random.default_rng(3)
    odd = pa.compute.match_substring_regex(pa.array(points[:0x2700]), tk.odd).to_pylist()
    known = [c for c, o in zip(points, odd, strict=False) if not o]
    texts = [f"a{c}b" for c in points] + ["".join(rng.choice(points, 12)) for _ in range(3000)] + ["".join(rng.choice(known, 12)) for _ in range(20000)]
    plain = [i for i, odd in enumerate(pa.compute.match_substring_regex(pa.array(texts), tk.odd).to_pylist()) if not odd]
    assert len(plain) > 2000, "Latin, Greek and Cyrillic texts go the short way"
    ids, at = tk.encode(pa.array(texts))
    whole = [e.ids for e in tk.base.encode_batch_fast(texts, add_special_tokens=False)]
    assert [t for i, t in enumerate(texts) if ids[at[i] : at[i + 1]].tolist() != whole[i]] == []


def _best_fit_one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 65, 400).tolist() + [40] * 100
    runs, windows = packing.plan_best_fit(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True)), 64)
    used = np.zeros(windows, int)
    ranks = defaultdict(set)
    for r in runs:
        for k in range(r.number):
            w = r.window + k // r.each
            assert used[w] == r.offset + (k % r.each) * r.length
            used[w] += r.length
            ranks[r.length].add(r.rank + k)
    assert all(v == set(range(len(v))) for v in ranks.values()) and used.sum() == sum(lengths)
    assert sorted((64 - used).tolist()) == _best_fit_one_by_one(lengths, 64)


def test_room_tree():
    t = packing.RoomTree(64)
    t.add(10, 1), t.add(64, 2)
    assert (t.tightest(3), t.tightest(10), t.tightest(11), t.tightest(64)) == (10, 10, 64, 64)
    t.add(64, -2)
    assert t.tightest(11) is None


def test_pack(spark):
    pytest.importorskip("public_tokenizers")
    path = packing.default_tokenizer()
    tk = packing.tokenizer(path)
    rows = [r for r in awkward() if r[0] is not None]
    got = packing.pack(documents(spark, awkward()), path, capacity=256, bucket_rows=3).collect()
    ids = {d: [*tk.base.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in rows}
    n = {d: sum(r[0] == d for r in rows) for d in ids}
    cover, windows = defaultdict(int), defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        if r["doc_id"] is None:
            continue
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        cover[r["doc_id"]] += r["length"]
    assert cover == {d: n[d] * len(ids[d]) for d in ids}
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(documents(spark, []), path).count() == 0
    assert (packing.padded_length(2048), packing.padded_length(2049)) == (2048, 4096)


# Language ------------------------------------------------------------------------------------------------------------------


def test_gradients_match_differences():
    m = langid.new_model(["a", "b"], 3, 1)
    m.table, m.rec, m.out, m.bias = (p.astype(np.float64) for p in m.params())
    rng = np.random.default_rng(0)
    x, y, used = rng.integers(97, 123, (7, 5)), np.array([0, 1, 0, 1, 1]), np.ones((7, 5), np.float32)
    _, grads = langid.gradients(m, x, y, used)
    for p, g in zip(m.params(), grads, strict=True):
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        at = p[i]
        p[i] = at + 1e-3
        up = langid.gradients(m, x, y, used)[0]
        p[i] = at - 1e-3
        down = langid.gradients(m, x, y, used)[0]
        p[i] = at
        assert abs((up - down) / 2e-3 - g[i]) < 1e-3 * max(1, abs(g[i]))


def test_reader_equals_the_trained_network():
    m = langid.new_model(["a", "b", "c"], 5, 2)
    x = np.random.default_rng(1).integers(32, 255, (16, 9)).astype(np.uint8)
    p = langid.position_probabilities(m, langid.hidden_states(m, x))
    got, n = langid.Reader(m).pooled(x)
    used = langid.letter_bytes(x)
    assert np.allclose(got, (p * used[:, :, None]).sum(0), atol=1e-4) and (n == used.sum(0)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 150 and np.mean([r["lang_pred"] == r["lang"] for r in got]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in got)


def test_language_of_awkward_rows(spark):
    got = langid.identify(documents(spark)).collect()
    assert len(got) == len(awkward())
    by_text = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] is not None}
    for d in (3, 4, 7, 8):
        assert by_text[d] == ("und", 0.0)
    assert by_text[9][0] in ("en", "fr")
    kept = langid.drop_unidentified(documents(spark))
    assert kept.columns == SCHEMA.names and not {3, 4, 7, 8} & {r["doc_id"] for r in kept.collect()}
    assert {r["lang_pred"] for r in langid.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(documents(spark, [])).count() == 0
    clash = documents(spark).withColumn("score", F.lit(1)).withColumn("__text", F.lit("x"))
    assert langid.drop_unidentified(clash).columns == clash.columns


# Mixing ----------------------------------------------------------------------------------------------------------------------


def _targets(size, weight, epochs=3):
    total, clamped = sum(size.values()), set()
    while True:
        rest, w = total - sum(epochs * size[s] for s in clamped), sum(weight[s] for s in size if s not in clamped)
        t = {s: epochs * size[s] if s in clamped else (rest * weight[s] / w if w else 0) for s in size}
        new = {s for s in size if s not in clamped and t[s] > epochs * size[s] + 1e-9}
        if not new:
            return t
        clamped |= new


def _sampled(rows, target, size, bucket_rows):
    """Document after document: those that fit in order, then smaller ones, the last one if half of it fits."""
    goal = min(round(target), 3 * size)
    epochs, left = divmod(goal, size) if size else (0, 0)
    buckets = max(1, -(-len(rows) // bucket_rows))
    order = sorted(rows, key=lambda r: (r["order_key"] % buckets, r["order_key"], r["doc_id"]))
    taken, before, late = {}, 0, []
    rest, reached = left, 0
    for r in order:
        if before + r["size"] <= rest:
            taken[id(r)], reached = epochs + (r["size"] > 0), before + r["size"]
        else:
            late.append(r)
        before += r["size"]
    before = 0
    for r in late:
        taken[id(r)] = epochs
        if r["size"] <= rest - reached:
            taken[id(r)] += before + r["size"] / 2 <= rest - reached
            before += r["size"]
    return taken


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 20, None: 5}, {"a": 100, "b": 100, "c": 100}, {"a": 5000, "b": 1, "c": 1, "d": 2, "é": 300}, {"a": 0, "b": 7}])
def test_mixing(spark, sizes):
    rows, n = [], 0
    for s, words in sizes.items():
        while words > 0 or not any(r[3] == s for r in rows):
            k = min(words, 1 + n % 17)
            rows.append((n, " ".join(["w"] * k), "en", s, 1))
            words, n = words - k, n + 1
    got = mixing.sampled_sizes(documents(spark, rows), bucket_rows=5).collect()
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    want = _targets({s: max(sizes[s], 0) for s in sizes}, {s: 1 + i % 3 for i, s in enumerate(order)})
    assert len(got) == len(rows)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] for r in mine)
        assert all(0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["whole"] * r["size"] for r in mine)
        assert {id(r): r["whole"] for r in mine} == _sampled(mine, want[s], sizes[s], 5)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine)
    again = mixing.sampled_sizes(documents(spark, rows[::-1]).repartition(7), bucket_rows=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_rows_hold_the_taken_words(spark):
    docs = documents(spark)
    plan = mixing.sampled_sizes(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == SCHEMA.names
    rows = mixed.collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows) == plan
    assert {r["text"] for r in rows} <= {r[1] for r in awkward()}, "no document is cut"
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.sampled_sizes(documents(spark, [])).count() == 0


# Extraction --------------------------------------------------------------------------------------------------------------------


def test_main_text(spark):
    shell = '<html><head><title>T x</title><script>var a="</p>";</script></head><body class="menu"><nav><ul><li><a href="/">Home page</a></li></ul></nav><div class="ad">Buy now</div>{}<footer>&copy; x</footer></body></html>'
    article = "<article><h1>Head &amp; tail</h1><p>One  two\n three<br>four</p><p><b>open<p>five&nbsp;six</article>"
    labelled = [(i, "u", shell.format(article.replace("One", f"Word{i} one more"))) for i in range(30)]
    extra = [
        (100, "u", shell.format('<div><p>plain text with several words here</p><ul><li><a href="x">linked</a></li></ul><p>and an end</p><div class="comments"><p>first!</p></div></div>')),
        (101, None, None), (102, "u", ""), (103, "u", "<p>just this"), (104, "u", "a < b &lt; c"), (105, "u", "<p>cut <a hre"), (106, "u", "<script>x</script><style>y</style>"),
        (107, "u", shell.format("<main><p>kept words here</p><form><p>no form words</p></form><aside>no aside words</aside><p>kept too</p></main>")),
    ]
    df = spark.createDataFrame(labelled + extra, PAGES)
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[3]["text"] == "Head & tail\nWord3 one more two three four\nopen\nfive six" and got[3]["n_chars"] == len(got[3]["text"])
    assert got[100]["text"] == "plain text with several words here\nlinked\nand an end"
    assert [got[k]["text"] for k in range(101, 107)] == ["", "", "just this", "a < b < c", "cut", ""]
    assert got[107]["text"] == "kept words here\nkept too" and got[101]["url"] is None
    assert html_extract.extract(df.limit(0)).count() == 0


def test_short_leads_and_tails_beside_chrome():
    """Weights are of pages whose adverts, scripts and lists all stand outside the article."""
    menu = '<nav><ul><li><a href="/">Home</a></li><li><a href="/b">More of it</a></li></ul></nav>'
    chrome = f'<div class="ad"><p>Buy now</p></div><script>var a = 1</script>{menu}'
    shell = f"<html><body>{menu}{chrome}{{}}{chrome}<footer><p>old words</p></footer></body></html>"
    long = " ".join(["word"] * 60)
    pages = [shell.format(f"<article><h1>Some title here</h1><p>{long}</p><p>{long}</p></article>")] * 60
    weights = html_extract.learn([(p, *html_extract.own_region(p)) for p in pages])
    for between in ('<div class="ad">Buy now</div>', "<script>x</script>", menu, chrome, chrome * 10):
        page = shell.format(f"<article><h1>five word title of it</h1>{between}<p>{long}</p>{between}<p>The end.</p></article>")
        assert html_extract.main_text(page, weights) == f"five word title of it\n{long}\nThe end.", between
    page = shell.format(f'<article><h1>A short title</h1><ul><li><a href="x">one link</a></li><li>two words</li></ul><p>{long}</p></article>')
    assert html_extract.main_text(page, weights) == f"A short title\none link\ntwo words\n{long}"


SITE = '<html><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy it now</div>{}<footer>old words</footer></body></html>'
STORY = "<article><h1>Head line</h1><p>" + " ".join(["word"] * 80) + "</p><p>end of it</p></article>"
TOLD = "Head line\n" + " ".join(["word"] * 80) + "\nend of it"


def _site_weights():
    pages = [SITE.format(STORY.replace("word", f"w{i}")) for i in range(20)]
    return html_extract.learn([(p, *html_extract.own_region(p)) for p in pages])


@pytest.mark.parametrize("names", ["site has-sidebar", "layout no-header", "search-results", "post social-science", "sidebar", "comments", "ad", "content", "menu page"])
def test_names_do_not_hide_a_page(names):
    w, inner = _site_weights(), STORY[9:-10]
    wrap = f'<div class="{names}">{{}}</div>'
    for page in (SITE.format(wrap.format(STORY)), SITE.format(f"<article>{wrap.format(inner)}</article>"), wrap.format(SITE.format(STORY)), SITE.format(wrap.format(inner))):
        assert html_extract.main_text(page, w) == TOLD
    discussed = STORY.replace("<p>end", '<section class="discussion"><p>end').replace("</article>", "</section></article>")
    assert html_extract.main_text(SITE.format(discussed), w) == TOLD


def test_the_scan_decides():
    """What has no telling name, or any name, is left outside by its score; what is inside is left out by clear evidence only."""
    w = _site_weights()
    links = "<div><ul>" + "".join(f'<li><a href="/{i}">See page number {i}</a></li>' for i in range(12)) + "</ul></div>"
    page = SITE.format(f"{links}<div>{STORY[9:-10]}</div>{links}")
    assert html_extract.main_text(page, w) == TOLD
    chrome = w.chrome(html_extract.read(page))
    kept = [x.text for x in html_extract.read(page).items if not x.tag and (x.element < 0 or not chrome[x.element])]
    assert any("See page number" in t for t in kept), "more than the region is no chrome"
    inside = '<div class="ad">Buy it now</div><div class="comment-list"><p>first comment</p></div><aside>beside</aside><div class="box">in a box</div>'
    assert html_extract.main_text(SITE.format(STORY.replace("<p>end", inside + "<p>end")), w) == TOLD.replace("\nend", "\nin a box\nend")
    # Names that training saw mostly in the content, or mostly outside, whatever they say.
    pages = [SITE.format(f'<div class="zzz">{" ".join(["out"] * 30)}</div>' + STORY.replace("<p>end", f'<div class="banner"><p>{" ".join(["good"] * 30)}</p></div><p>end')) for _ in range(5)]
    w = html_extract.learn([(p, *html_extract.own_region(p)) for p in pages])
    assert w.names["zzz"] < -html_extract.CLEAR and w.names["banner"] > html_extract.CLEAR
    got = html_extract.main_text(SITE.format(STORY.replace("<p>end", '<div class="zzz">not this</div><div class="banner"><p>but this</p></div><p>end')), w)
    assert got == TOLD.replace("\nend", "\nbut this\nend")


def test_long_pages_are_read_whole(spark):
    long = SITE.format(STORY.replace("end of it", LONG))
    rows = [(i, "u", SITE.format(STORY.replace("word", f"w{i}"))) for i in range(10)] + [(50, "u", long)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[50] == TOLD.replace("end of it", LONG)


def test_best_region():
    assert html_extract.best_region([-1, 2, -1, 3, -5, 4]) == (1, 4)
    assert html_extract.best_region([1, -1, 1]) == (0, 1) and html_extract.best_region([-1, 0]) == (0, 0) and html_extract.best_region([]) == (0, 0)


def test_extraction_on_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        inside = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S).group(1)
        import html as h

        blocks = [" ".join(h.unescape(re.sub(r"<(?!/?(?:p|h1)>)[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
