"""Each operator against brute force, an exact round trip or accuracy on held-out rows, and its special cases."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, gru, html, jaccard, jpeg, langid, linededup, order, packing, quality

SF = "/root/testdata/sf0.001"
WEIRD = [None, "", " ", "one", "one", "tab\tand\x0bmore\x0c\r\n", "çé ñ ß 中文 😀", "x" * 5000, "a b " * 4000, "<|endoftext|> a<|endoftext|>", "\x00\x1c\x85\xa0 "]


def frame(spark, texts, **more):
    rows = [(i, t, "en", "s", "clash", *more.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, ids string")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark)


# 1 --------------------------------------------------------------------------------------------------------------------
def repeated(words, n=8):
    where = {}
    for i in range(len(words) - n + 1):
        where.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({i + k for at in where.values() if len(at) > 1 for i in at for k in range(n)})


def test_quality_measures():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 60))]
        assert quality.measure(" ".join(words))[4] == repeated(words)
    text = "a b\na b\n\n \nc # |"
    assert quality.measure(text)[:4] == (7, 7, 2, 1)
    assert quality.measure(None)[:5] == (0, 0, 0, 0, 0)


def test_quality_verdicts(spark, docs):
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_quality_learns_what_labels_say(spark):
    """Beyond the base rules the posterior rejects the bad and keeps the good; no label is read in learning."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").withColumnRenamed("quality", "label")
    rows = quality.verdicts(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(labels, "doc_id").filter("not base_failed").collect()
    bad, good = ([r.kept for r in rows if r.label == v] for v in (0, 1))
    assert len(bad) > 20 and np.mean(bad) < 0.5 and np.mean(good) > 0.98


def test_quality_special(spark):
    got = quality.score(frame(spark, WEIRD)).collect()
    assert len(got) == len(WEIRD) and not got[0].kept and got[3].quality == got[4].quality and got[0].ids == "clash"
    assert quality.verdicts(frame(spark, [])).collect() == []


def test_quality_estimate_finds_what_agrees():
    rng = np.random.default_rng(3)
    good = rng.random(4000) < 0.8
    votes = np.where(rng.random((4000, 5)) < 0.9, np.where(good, 0, 2)[:, None], np.where(good, 2, 0)[:, None])
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, chance = quality.estimate(patterns, counts)
    assert abs(np.exp(prior[0]) - 0.8) < 0.05 and np.all(np.exp(chance[0, :, 0]) > 0.8)


# 2 --------------------------------------------------------------------------------------------------------------------
def test_language_model_is_a_distribution():
    m = langid.Model({"abba": 3, "abc": 2, "ca": 1})
    for before in ("", "a", "ab"):
        total = 0.0
        for c in "abc ":
            code = np.array([ord(x) for x in f" {before}{c}"], np.uint64)
            total += 2.0 ** m.bits(langid.gram_keys(code, np.arange(len(code))))[-1]
        assert 0.8 < total <= 1.0001  # the rest is for characters not seen


def test_language_held_out(docs):
    got = langid.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred != 'und'").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.9
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and all(0 <= r.score <= 1 for r in got)


def test_language_special(spark, docs):
    model = langid.train(docs)
    got = langid.identify(frame(spark, [*WEIRD, "123 !!", "Жизнь прекрасна и удивительна"]), model).collect()
    assert got[0].lang_pred == got[1].lang_pred == "und" and got[-2].lang_pred == "und" and got[-1].rejected
    assert got[3].score == got[4].score
    odd = langid.identify(frame(spark, ["½ ²", "Ⅷ ³", "½ the house and the garden ²"]), model).collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, False]
    none = langid.predictions(frame(spark, []))
    assert none.collect() == []
    assert langid.predictions(frame(spark, ["a b"]).withColumn("lang", F.lit(None).cast("string"))).first().lang_pred == "und"


# 3 --------------------------------------------------------------------------------------------------------------------
def brute_components(texts, percent, width):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def copies(seed, groups=14, most=7):
    rng = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 5, 11, 12, 40, 120, 300]))]
        for _ in range(rng.randint(1, most)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                own[rng.randrange(len(own))] = f"v{rng.randint(0, 9)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("percent,width,parts,held,hot", [(90, 3, 1, 50, 2), (90, 3, 16, 10**6, 4096), (80, 5, 5, 400, 3), (80, 5, 2, 10**6, 2)])
def test_jaccard_brute_force(spark, monkeypatch, percent, width, parts, held, hot):
    """Whatever the partitions, the pieces that a task groups at once and the size of groups that stay apart."""
    for name, value in (("BLOCK", 3), ("HELD", held), ("HOT", hot)):
        monkeypatch.setattr(jaccard, name, value)
    texts = copies(percent + parts) + WEIRD
    got = sorted(jaccard.classes(frame(spark, texts).repartition(parts), percent, width).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(texts, percent, width)


def test_jaccard_pieces_meet_whatever_the_parts():
    """Every two nodes that share a piece of one's own band are a pair or two members, or each a pair with one hub where that is all of them."""
    rng = random.Random(4)
    for _ in range(200):
        rows = sorted({(rng.randrange(6), rng.randrange(9), rng.randrange(2)) for _ in range(rng.randrange(1, 30))})
        sig, node, side = (np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, np.int64, np.int32)))
        part, sent = np.array([rng.randrange(4) for _ in rows]), []
        for k in set(part.tolist()):
            own = part == k
            sent.append(jaccard._sent(sig[own], node[own], side[own], k, rng.randrange(1, 4), 3))
        held = {k: [np.zeros(0, t) for t in kinds] for k, kinds in jaccard._kinds.items()}
        for b in sent:
            for _, kind, n, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[kind] = [np.concatenate(x) for x in zip(held[kind], jaccard.buckets.unpack(payload, n, jaccard._kinds[kind]), strict=True)]
        s, n, d = held[jaccard.ALL]
        key, s2, n2, d2 = held[jaccard.APART]
        both = jaccard._met(s, n, s, d, True), jaccard._met(key, n2, s2, d2, False)
        pairs = {frozenset(p) for found, _ in both for p in found[:, :2].tolist()}
        rest = [x for _, m in both for x in zip(m[0].tolist(), m[1].tolist(), strict=True)]
        for s in set(sig.tolist()):
            members = {n for x, n in rest if x == s}
            at = {(n, d) for x, n, d in rows if x == s}
            evens = {n for n, d in at if not d}
            for x, _ in at:
                for y in evens - {x}:
                    assert frozenset((x, y)) in pairs or {x, y} <= members


def test_sketches_that_link_share_a_piece_that_is_joined_on():
    rng, met = np.random.default_rng(6), set()
    for percent in (80, 90):
        edges = jaccard._Bands(percent)
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, int(rng.choice([20, 90, 300, 900])), dtype=np.uint64))
            b = np.concatenate([a[int(rng.integers(0, 1 + len(a) // 6)) :], rng.integers(0, 2**63, int(rng.integers(0, 1 + len(a) // 12)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            i, j = edges.of(len(a)), edges.of(len(b))
            if 100 * both < percent * (len(a) + len(b) - both) or min(i, j) < 0:
                continue
            top = max(i, j)
            assert np.intersect1d(*(jaccard.signs(v, edges, top)[1] for v in (a, b))).size
            met.add(edges.plan(top)[1] > 0)
    assert met == {False, True}


def test_jaccard_rows_of_one_id_connect(spark):
    df = spark.createDataFrame([(5, "a b c d"), (1, "a b c d"), (5, "k l m n o p"), (9, "k l m n o p"), (7, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.classes(df).collect()} == {(5, 2): 1, (1, 2): 1, (5, 4): 1, (9, 4): 1, (7, 1): 7}


def test_jaccard_chains_across_bands(spark):
    """Chains a-b-x, x of the next band, in another task than a and b, and linked to b alone."""
    rng, percent, width = random.Random(3), 90, 3
    edges, flat, far = jaccard.bands(percent, 600), [], []
    for k in range(24):
        n = (edges[-4 - k % 8] - 1) // 9 * 9  # shingles
        b = [f"w{rng.randint(0, 10**6)}" for _ in range(n + width - 1)]
        flat += [" ".join(["u", *b[1:]]), " ".join(b)]
        far.append(" ".join(b + [f"v{k}_{i}" for i in range(n // 9)]))
    df = frame(spark, flat + far).repartitionByRange(3, "doc_id")
    got = sorted(jaccard.classes(df, percent, width).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == brute_components(flat + far, percent, width)


def test_jaccard_special(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (2**62 + 5, "q r s t"), (-7, "q r s t")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.classes(df).collect()}
    assert got == {(None, 2): None, (1, 2): 1, (2, 2): 1, (2**62 + 5, 2): -7, (-7, 2): -7}
    assert sorted(r.doc_id for r in jaccard.one_of_each(df).filter("doc_id is not null").collect()) == [-7, 1]
    assert jaccard.classes(frame(spark, [])).collect() == []


def test_sketch_bounds_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(150, len(a))], rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)]))
        d = len(np.setxor1d(a, b))
        assert np.bitwise_count(jaccard.sketch(a, 7) ^ jaccard.sketch(b, 7)).sum() <= d
        short = [np.frombuffer(jaccard.folded(jaccard.sketch(x, 7)), np.uint64) for x in (a, b)]
        assert np.bitwise_count(short[0] ^ short[1]).sum() <= d


def test_components(spark):
    rng = random.Random(2)
    for n in (1, 30, 200):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
        up = list(range(n))
        for _ in range(n):
            for a, b in edges:
                up[a] = up[b] = min(up[a], up[b])
        got = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
        assert got == {x: up[x] for e in edges for x in e}


# 4 --------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("<p>", ""),
        ("<nav><a href=x>Menu</a></nav><article><h1>T&amp;t</h1><p>One\n two&nbsp;three<p>Four<br>five</article><footer>F</footer>", "T&t\n\nOne two three\n\nFour five"),
        ("<article><p>A <b>b</b>c</p><div class='ad'>Buy</div><aside>S</aside><script>var a='</p>'</script><ul><li>x<li>y</ul><section id=comments><p>Nice!</p></section></article>", "A bc\n\nx\n\ny"),
        ("<main><p>only<!-- no --> this</main><p>not this</p>", "only this"),
        ("<div class=menu><a href=x>one</a></div><div><p>" + "Long text of the page. " * 6 + "<p>Short.</div><div class=comment-list><p>" + "A remark. " * 20 + "</div>", ("Long text of the page. " * 6).strip() + "\n\nShort."),
        ("<article><p title=it's>hello</p><p>you</article>", "hello\n\nyou"), ("<p>A short page.</p>", "A short page."),
        ("<article><p>Text.</p><div class='legal'><p>This is a paragraph about the law, a part of the article.</p><p>Terms</p></div></article>", "Text.\n\nThis is a paragraph about the law, a part of the article.\n\nTerms"),
        ("<main></main><article>Teaser</article><form></form><form></form><form></form><div>" + "Long text. " * 40 + "</div>", ("Long text. " * 40).strip()),
        ("<article><p>1 < 2 &lt; 3", "1 < 2 < 3"), ("<article><form><p>Name</p></form><header><h2>Head</h2></header><p>x</p></article>", "Head\n\nx"),
    ],
)
def test_main_text(page, text):
    assert html.extract(page) == text


def test_main_text_spans():
    assert html.spans([0, 5, 0, 0, 0, 9, 9, 0, 0, 0, 3], 15, 1) == [(5, 7)]
    assert html.spans([9, 0, 0, 0, 4, 0, 9, 1, 1, 1], 9, 9) == [(0, 1), (4, 7)]
    assert html.spans([], 1, 1) == []


def test_main_text_follows_the_windows(monkeypatch):
    """Surge and dive decide, with and without marks; with all windows above the threshold the same pages give more."""
    text, gap, far = "Text of the page that goes on for a while. " * 4, "<form></form>" * 4, "<div>Imprint of the house</div>"
    pages = [f"{far}{gap}<p>{text}<p>{text}<p>End.{gap}{far}", f"{far}<article><p>{text}<p>End.</article>{far}{gap}<div>{text * 9}</div>"]
    want = [f"{text.strip()}\n\n{text.strip()}\n\nEnd.", f"{text.strip()}\n\nEnd.\n\n{(text * 9).strip()}"]
    assert [html.extract(p) for p in pages] == want
    monkeypatch.setattr(html, "spans", lambda weights, *_: [(0, len(weights))])
    assert all(html.extract(p) != w for p, w in zip(pages, want, strict=True))


def test_main_text_without_its_marks(spark):
    """Pages whose article tags are taken away give the same text but for few words."""
    import collections
    import re

    found = right = want = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        a, b = (collections.Counter(html.extract(h).split()) for h in (re.sub("</?article>", "", r.html), r.html))
        found, want, right = found + a.total(), want + b.total(), right + (a & b).total()
    assert right > 0.95 * found and right > 0.95 * want


LONG_LINE = "A long text that goes on for some time, as texts of pages do. " * 5


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<h1>Title</h1><p>By Ann.<p>x<p>y<p>{LONG_LINE}<p>{LONG_LINE}", ["Title", "By Ann.", "x", "y", LONG_LINE, LONG_LINE]),
        (f"<nav>Menu</nav><h1>Title</h1><p>{LONG_LINE}<p><a href=x>the whole report</a><p>{LONG_LINE}<p>z<footer>F</footer>", ["Title", LONG_LINE, "the whole report", LONG_LINE, "z"]),
        (f"<article><p>{LONG_LINE}<div class='related'><h2>Section on related work</h2><p>Prose.</div></article>", [LONG_LINE, "Section on related work", "Prose."]),
        (f"<article><p>{LONG_LINE}<div class='search'><pre>a b</pre><ul><li>one<li>two</ul></div><div class='legal'><p>Short legal text</div></article>", [LONG_LINE, "a b", "one", "two", "Short legal text"]),
        (f"<article><p>{LONG_LINE}<div class='menu-review'><p>On menus.</div><div class='navigation-systems'>On ships.</div></article>", [LONG_LINE, "On menus.", "On ships."]),
        (f"<article><p>{LONG_LINE}<div class='comment-list'><p>{LONG_LINE}</div><div id='site-nav-2'>no</div><p class='ad_box'>no</article>", [LONG_LINE]),
        (f"<article><p>{LONG_LINE}<div class='related-stories'><h2>Related</h2><ul><li><a href=x>One story</a><li><a href=y>Another</a></ul></div></article>", [LONG_LINE]),
        (f"<main></main><article>teaser</article><div>{LONG_LINE}</div>", [LONG_LINE]),
        (f"<main><h1>Head</h1><article><p>{LONG_LINE}</article></main><article>Another teaser</article>", ["Head", LONG_LINE]),
        (f"<main><p>{LONG_LINE}<p>short</main><p>outside", [LONG_LINE, "short"]),
    ],
)
def test_main_text_keeps_what_belongs_to_it(page, text):
    assert html.extract(page) == "\n\n".join(t.strip() for t in text)


def test_main_text_believes_marks_by_windows(monkeypatch):
    """With windows that say nothing a teaser's marks count as much as those of the text."""
    page = f"<article>teaser</article><div>{LONG_LINE}</div>"
    assert html.extract(page) == LONG_LINE.strip()
    monkeypatch.setattr(html, "_sums", lambda weights: [1.0] * len(weights))
    assert html.extract(page) != LONG_LINE.strip()


def test_main_text_blocks_without_marks(spark):
    """Blocks of pages whose article tags are taken away: all of the article's, and no others."""
    import re

    found = right = want = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        own = [t for t, *_ in html.lines_of(re.search("(?s)<article>.*</article>", r.html)[0]) if t]
        assert html.extract(r.html).split("\n\n") == own
        got = html.extract(re.sub("</?article>", "", r.html)).split("\n\n")
        found, want, right = found + len(set(got)), want + len(set(own)), right + len(set(got) & set(own))
    assert right >= 0.99 * found and right >= 0.999 * want


def test_main_text_takes_long_and_deep_pages():
    assert html.extract("<div>" * 20000 + "deep" + "</p>" * 20000 + "</div>" * 20000) == "deep"
    assert html.extract("<a " * 20000).startswith("<a <a") and html.extract('<p>x<a b="' * 20000)
    assert html.extract("<article>" + "<p>word" * 50000) == "\n\n".join(["word"] * 50000)


def test_main_text_query(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</article>", 5), (2, None, None, 6), (2, None, None, 6)], "page_id long, url string, html string, text int")
    got = sorted(html.main_text(pages).collect())
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "x", 1), (2, "", 0), (2, "", 0)]


# 5 --------------------------------------------------------------------------------------------------------------------
def test_media_round_trip():
    rng = random.Random(4)
    for n in (192, 384, 576, 192 * 130):
        data = bytes(rng.randrange(256) for _ in range(n))
        media = jpeg.encode_payload(data)
        fast, slow = jpeg.Picture(media), jpeg.Picture(media, fast=n > 6000)
        assert fast.payload() == slow.payload() == data
        assert all((a["coef"] == b["coef"]).all() for a, b in zip(fast.parts, slow.parts, strict=True))
        assert fast.rgb().shape == (fast.height, fast.width, 3)
    with pytest.raises(ValueError):
        jpeg.encode_payload(b"x")


def test_media_agrees_with_another_decoder(spark):
    jvm = spark.sparkContext._jvm
    own = jpeg.Picture(jpeg.encode_payload(b"abcdefghijklmnop" * 36))
    picture = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(jpeg.encode_payload(b"abcdefghijklmnop" * 36))))
    rgb = np.array([[picture.getRGB(x, y) & 0xFFFFFF for x in range(own.width)] for y in range(own.height)])
    other = np.stack([rgb >> 16, rgb >> 8 & 255, rgb & 255], axis=2)
    # It smooths chroma where this one repeats it, so luma is compared, where nothing was cut off.
    mine = own.rgb().astype(int)
    whole = ((mine > 0) & (mine < 255) & (other > 0) & (other < 255)).all(axis=2)
    luma = np.abs((other - mine) @ np.array([0.299, 0.587, 0.114]))[whole]
    assert whole.sum() > 100 and luma.max() < 3


def test_media_refines_coefficients_that_were_zero():
    """A scan of first bits that leaves zeros, and its refinement, bit by bit."""
    codes = jpeg.Codes.by_length({0x01: 2, 0x11: 2, 0x00: 2})
    bits = "".join(format(codes.of[s][1], f"0{codes.of[s][0]}b") + v for s, v in ((0x11, "1"), (0x01, "0"), (0x00, "")))
    row = np.zeros(64, np.int16)
    row[2] = 4
    data = bits[:3] + "1" + bits[3:]  # the correction of the coefficient that is passed over
    jpeg.Picture._refine(jpeg._Bits(np.packbits([int(b) for b in data]).tobytes()), row, codes, 1, 63, 0, 0)
    assert {k: int(v) for k, v in enumerate(row) if v} == {2: 5, 3: 1, 4: -1}


def test_media_query(spark):
    got = {r.doc_id: r for r in jpeg.stored_texts(frame(spark, WEIRD)).collect()}
    for i, t in enumerate(WEIRD):
        raw = (t or "").encode()
        data = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert got[3][1:] == got[4][1:]
    tensor = jpeg.load(jpeg.store(frame(spark, ["abc"]))).first()
    assert len(tensor.tensor) == tensor.height * tensor.width * 3


# 6 --------------------------------------------------------------------------------------------------------------------
def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts], t


def test_bpe_is_the_library(spark, docs):
    rng = random.Random(6)
    pool = "abc '’sdt 12²½٣一Ⅷ_-.,\n\t\r\x0b\x1c\x85\xa0 ​😀éßİ́\0"
    texts = WEIRD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choice("abcdefg") for _ in range(300)) for _ in range(5)]
    texts += [r.text for r in docs.limit(60).collect()]
    own = bpe.Bpe(bpe.default_vocabulary(), most=100)
    ids, at, _, _ = own.encode(texts)
    want, library = reference_ids(texts)
    assert [ids[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
    assert [own.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]
    got = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts[:40])).collect()}
    for i, x in enumerate(want[:40]):
        assert got[i].n_tokens == len(x) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() and got[i].decoded_sha256 == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_bpe_columns(spark):
    got = bpe.decode(bpe.encode(frame(spark, WEIRD))).collect()
    assert [r.decoded for r in got] == [t or "" for t in WEIRD] and got[0].ids == []


# 7 --------------------------------------------------------------------------------------------------------------------
def test_packing(spark, docs):
    texts = WEIRD + [r.text for r in docs.collect()]
    got = packing.packed(frame(spark, texts).repartition(2), ids=True).collect()
    want, _ = reference_ids(texts)
    for i, ids in enumerate(want):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in own for x in r.ids] == [*ids, 1] and own[0].doc_tokens == len(ids) + 1
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids) > 0 for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [sum(x.length for x in rows[:k]) for k in range(len(rows))] and sum(r.length for r in rows) <= 2048
    assert sum(sum(r.length for r in rows) < 2048 for rows in by.values()) <= 2  # the last of each partition
    assert packing.packed(frame(spark, [])).collect() == []


def test_packing_takes_related_documents():
    terms = [[1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5], [6, 6, 6], [6, 1, 7]]
    start = np.cumsum([0, *map(len, terms)])
    index = packing.Index(np.array(sum(terms, [])), start)
    scores = index.scores(0)
    assert scores[2] > scores[1] == 0
    assert [[d for d, _, _ in w] for w in packing.pack(np.array([5, 5, 5, 5, 5, 5]), index, 10)][:2] == [[0, 2], [1, 3]]


# 8 --------------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    a, b = order.permuted(np.arange(n), n, 1), order.permuted(np.arange(n), n, 2)
    assert sorted(a) == sorted(b) == list(range(n))
    assert n < 60 or (a != b).any() and (a != np.arange(n)).any()


def test_training_order(spark, tmp_path):
    texts = WEIRD + [f"text number {i} " * 20 for i in range(60)]
    df = frame(spark, texts).repartition(3)
    m = order.write(df, str(tmp_path / "out"), length=32, per_shard=8, key=9)
    rows = list(order.read(str(tmp_path / "out")))
    assert len(rows) == m["slots"] and all((tmp_path / "out" / f"shard-{k:08d}.bin").stat().st_size % m["stride"] == 0 for k in range(-(-m["slots"] // 8)))
    for at in (0, 5, 8, m["slots"] - 1):
        assert (next(order.read(str(tmp_path / "out"), at)) == rows[at]).all()
    want, _ = reference_ids(texts)
    tokens = np.concatenate(rows)
    assert (tokens != order.END).sum() == sum(x != order.END for ids in want for x in ids)
    assert order.shards(frame(spark, [])).collect() == []


# 9 --------------------------------------------------------------------------------------------------------------------
def test_gru_gradient():
    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(1, 50, 100).astype(float), np.full(gru.TAILS, 3.0), 5.0, 1024)
    stop, begin = gru.ends_of(p)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    tokens = rng.choice([3, 40, 99, 1024, 1030, stop], (4, 5))
    tokens[0, 3:] = -1
    before, h = np.full(4, begin), rng.normal(0, 0.3, (4, gru.HIDDEN))
    g, _, _ = gru.gradient(p, tokens, before, h)
    n = (tokens >= 0).sum()
    for name in p:
        at = np.unravel_index(np.argmax(np.abs(g[name])), p[name].shape)
        keep, e = p[name][at], 1e-5
        p[name][at] = keep + e
        up = gru.gradient(p, tokens, before, h)[2]
        p[name][at] = keep - e
        down = gru.gradient(p, tokens, before, h)[2]
        p[name][at] = keep
        assert abs(-(up - down) / (2 * e) * n - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_gru_scores_sum_to_one_and_carry_the_state():
    p = gru.initial(np.arange(1, 1025)[::-1].astype(float), np.full(gru.TAILS, 9.0), 9.0, 1024)
    stop, begin = gru.ends_of(p)
    h = np.random.default_rng(1).normal(0, 0.5, (1, gru.HIDDEN)).astype(np.float32)
    every = np.arange(stop + 1)
    assert abs(np.exp(gru.output(p, np.repeat(h, len(every), 0), every)).sum() - 1) < 1e-3
    docs = [np.array([1, 5, 1030, 7, stop]), np.array([stop]), np.tile([3, 4, 9], 50)]
    got = gru.log_likelihood(p, docs)
    for d, x in zip(docs, got, strict=True):
        h, before, total = np.zeros((1, gru.HIDDEN), np.float32), np.array([begin]), 0.0
        for t in d:
            h = gru.step(p, p["x"][before], h)[0]
            total, before = total + gru.output(p, h, np.array([t]))[0], np.array([t])
        assert abs(total - x) < 1e-2


def test_gru_classes_take_few_outputs():
    """Each word and kind has one class; where frequencies are Zipf's, a token takes fewer outputs than with classes of one size."""
    for head in (1024, 1088, 1280, 3840, 14080):
        n = head + gru.TAILS
        begin, class_of = gru.classes(n)
        size = np.diff(begin)
        assert begin[0] == 0 and begin[-1] == n and head in begin and (size > 0).all()
        assert np.array_equal(class_of, np.append(np.repeat(np.arange(len(size)), size), len(size)))
        often = 1 / np.arange(1, head + 1)
        share = np.append(0.6 * often / often.sum(), np.full(gru.TAILS, 0.4 / gru.TAILS))
        assert len(size) + 1 + (share * size[class_of[:-1]]).sum() < 0.85 * (n // gru.CLASS + 1 + gru.CLASS)


def test_gru_sums_by_token_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 40, 3000):
        token, rows = (rng.pareto(0.7, n) * 3).astype(int) % 90, rng.normal(size=(n, 6))
        order = np.argsort(token, kind="stable")
        own = token[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        want = np.zeros((90, 6))
        np.add.at(want, token, rows)
        assert np.allclose(gru._by_token(rows, order, first), want[own[first]])


def test_gru_windows_use_their_memory_again():
    """A second window asks for little memory, and gives what the first one gave."""
    import tracemalloc

    rng = np.random.default_rng(4)
    p = gru.initial(np.arange(1, 1025)[::-1].astype(float), np.full(gru.TAILS, 9.0), 9.0, 1024)
    tokens, before, h = rng.integers(0, 1281, (gru.BATCH, gru.WINDOW)), rng.integers(0, 1281, gru.BATCH), rng.normal(0, 0.3, (gru.BATCH, gru.HIDDEN)).astype(np.float32)
    g, after, logp = gru.gradient(p, tokens, before, h)
    tracemalloc.start()
    again, other, mean = gru.gradient(p, tokens, before, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6e6 and logp == mean and np.array_equal(after, other) and all(np.array_equal(g[k], again[k]) for k in g)


def test_lm_words_brute_force(monkeypatch):
    """Words, their order and their texts are those of the pattern, whatever the span; equal words have equal hashes, others differ."""
    rng = np.random.default_rng(5)
    signs = list("aAbBzZ \t\n\x0b\x85é漢字0.\x1c")
    for span in (7, 64, 1 << 17):
        monkeypatch.setattr(gru, "SPAN", span)
        gru._powers.cache_clear()
        hash_of, word_of = {}, {}
        for _ in range(60):
            texts = [None if rng.random() < 0.1 else "".join(rng.choice(signs, rng.choice([0, 1, 5, 40, 300]))) for _ in range(4)]
            size, words, ids = gru.words_in(texts)
            want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
            assert size.tolist() == [len(x) for x in want]
            for w, h in zip((x for y in want for x in y), words[ids].tolist(), strict=True):
                assert hash_of.setdefault(w, h) == h and word_of.setdefault(h, w) == w
    gru._powers.cache_clear()


def test_lm_trains_on_every_token(spark, monkeypatch):
    """One pass meets every token of every text once, with the state that the text before it leaves."""
    texts = [" ".join(f"w{(i * j) % 50}" for j in range(n)) for i, n in enumerate([0, 1, 15, 16, 17, 500, 3000])]
    known = gru.hashed(" ".join(f"w{i}" for i in range(50)).encode())[0]
    ranks, rows = gru.Ranks(known), []
    for b in gru.chunked(frame(spark, texts).withColumn("held_out", F.lit(False))).toArrow().to_batches():
        for _, _, size, words, ids in gru.unchunked(b):
            rows += gru.targets(words, ranks.of(words), ids, size, 1024)
    assert {int(x) for r in rows for x in r} <= {*range(50), 1024 + gru.TAILS} and all(r[-1] == 1024 + gru.TAILS for r in rows)
    assert [len(r) for r in rows] == [len(t.split()) + 1 for t in texts]
    monkeypatch.setattr(gru, "LEAST_STEPS", 0)
    assert np.array_equal(np.concatenate(gru.streams(rows)), np.concatenate(rows)) and len({len(x) for x in gru.streams(rows)}) <= 2
    monkeypatch.setattr(gru, "BATCH", 1)  # one stream: no state is begun anew within a text
    monkeypatch.setattr(gru.Adam, "update", lambda *_: None)
    p, real, met = gru.initial(np.ones(50), np.ones(gru.TAILS), 1.0, 1024), gru.gradient, [0, 0.0]

    def gradient(p, tokens, before, h):
        g, h, logp = real(p, tokens, before, h)
        n = int((tokens >= 0).sum())
        met[0], met[1] = met[0] + n, met[1] + logp * n
        return g, h, logp

    monkeypatch.setattr(gru, "gradient", gradient)
    gru.trained(p, rows, 1)
    assert met[0] == sum(map(len, rows)) and abs(met[1] - gru.log_likelihood(p, rows).sum()) < 1


def test_lm_base(spark, docs):
    import collections
    import math
    import re

    texts = {r.doc_id: r.text for r in docs.collect()} | {10**6: None, 10**6 + 1: "", 10**6 + 2: "never seen zzz"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = {k: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 10 == 0 for k in texts}
    c = collections.Counter(w for k, ws in words.items() if not held[k] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in gru.scores(df).collect()}
    for k, ws in words.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) < 1e-6 * len(ws) + 1e-9
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)


def test_lm_rare_words(spark, monkeypatch):
    """With few known words the counts of all others come from the join."""
    monkeypatch.setattr(gru, "KNOWN", 3)
    texts = [f"a b c rare{i} other{i % 7}" for i in range(40)]
    got = gru.scores(frame(spark, texts)).collect()
    assert all(r.n_known == 6 for r in got if not r.held_out) and gru.scores(frame(spark, [])).collect() == []


# 10 -------------------------------------------------------------------------------------------------------------------
def passage(rng, n):
    return " ".join(f"q{rng.randint(0, 10**6)}" + ("." if i % 9 == 8 else "") for i in range(n))


def test_line_dedup_finds_passages(spark):
    rng = random.Random(10)
    shared, line = passage(rng, 60) + ".", passage(rng, 12)
    texts = [f"{passage(rng, 30)}. {shared} {passage(rng, 25)}\n{line}\n{passage(rng, 40)}" for _ in range(6)] + [passage(rng, 80), f"{line}\nx\n{line}"]
    got = [r.text for r in sorted(linededup.deduplicated(frame(spark, texts)).collect())]
    assert got[0] == texts[0] and got[6] == texts[6]
    inner = shared.split(". ")[1:-1]
    for t, old in zip(got[1:6], texts[1:6], strict=True):
        assert not any(s in t for s in inner) and line not in t
        assert t.startswith(old[:20]) and t.endswith(old[-20:])
    assert got[7] == "x"


def test_line_dedup_finds_short_lines(spark):
    rng = random.Random(11)
    short = lambda n, k: "\n".join(f"{passage(rng, k)}" for _ in range(n))
    menu, words, copy = short(8, 7), short(40, 1), short(12, 5)
    texts = [f"{passage(rng, 30)}\n{m}\n{passage(rng, 40)}" for m in (menu, words) for _ in range(3)] + [copy, copy, "\n".join(["no end of this"] * 300)]
    got = [r.text for r in sorted(linededup.deduplicated(frame(spark, texts)).collect())]
    for i, t in enumerate(texts[:6]):
        lines = t.split("\n")
        assert got[i] == (t if i % 3 == 0 else f"{lines[0]}\n{lines[-1]}")
    assert got[6:8] == [copy, ""] and len(got[8].split()) < linededup.GRAM + linededup.SPAN  # of a line repeated in place, less than a stretch stays


def test_line_dedup_brute_force(spark):
    """Of a run of GRAM + SPAN words and a unit more that an earlier document has, fewer than SPAN words in a row stay, and few at all; every unit that goes has an equal one further up."""
    rng = random.Random(12)
    vocabulary = [" ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 999)}" for _ in range(rng.choice([1, 2, 3, 6, 8, 12, 30]))) for _ in range(400)]
    docs: list[list[str]] = []
    for _ in range(40):
        own: list[str] = []
        for _ in range(rng.randint(1, 6)):
            if docs and rng.random() < 0.6:
                source = rng.choice(docs)
                a = rng.randrange(len(source))
                own += source[a : a + rng.randint(1, 40)]
            else:
                own += rng.choices(vocabulary, k=rng.randint(1, 25))
        docs.append([u if rng.random() < 0.97 else " " for u in own])
    texts = ["\n".join(d) for d in docs]
    got = {r.doc_id: r.n_deleted for r in linededup.deduplicated(frame(spark, texts).repartition(5)).collect()}
    gone = {r.doc_id: [i for a, z in zip(r.gone[::2], r.gone[1::2]) for i in range(a, z)] for r in linededup.repeats(frame(spark, texts).repartition(3)).collect()}
    assert {k: len(v) for k, v in gone.items()} == {k: n for k, n in got.items() if n}
    flat = [[u.strip() for u in d] for d in docs]
    size = [[len(u.split()) for u in d] for d in flat]
    grams = {}
    for k, d in enumerate(flat):
        for i in range(len(d)):
            n, j = 0, i
            while j < len(d) and n < linededup.GRAM:
                n, j = n + size[k][j], j + 1
            if n >= linededup.GRAM:
                for x in range(i, j):
                    grams.setdefault((tuple(d[i:j]), x - i), []).append((k, x))
    repeated = {place for at in grams.values() if len(at) > 1 for place in at}
    missed = total = 0
    for k, d in enumerate(flat):
        drop = set(gone.get(k, []))
        for i in drop:
            # a unit goes with a gram of its own or beside one that it is equal next to
            assert not d[i] or any((k, x) in repeated for x in range(max(0, i - linededup.AHEAD), min(len(d), i + linededup.AHEAD)))
            assert not d[i] or any(d[i] in flat[e] for e in range(k)) or d.index(d[i]) < i
        for e in range(k):
            for off in range(1 - len(d), len(flat[e])):  # diagonals: unit i of d beside unit i + off of the earlier one
                i = max(0, -off)
                while i < len(d) and i + off < len(flat[e]):
                    j, n = i, 0
                    while j < len(d) and j + off < len(flat[e]) and d[j] == flat[e][j + off] and d[j]:
                        n, j = n + size[k][j], j + 1
                    if j > i and n - size[k][j - 1] >= linededup.GRAM + linededup.SPAN:
                        missed, total = missed + len(set(range(i, j)) - drop), total + j - i
                        stay = 0  # words in a row that stay: fewer than a stretch of the guarantee
                        for x in range(i, j):
                            stay = 0 if x in drop else stay + size[k][x]
                            assert stay < linededup.SPAN
                    i = j + 1
    assert total > 1000 and missed <= 0.01 * total


def test_stages_give_back_columns_of_any_name(spark):
    text = "The quick brown fox jumps over the lazy dog while many small birds sing in the old green garden behind the house. "
    names = [*quality.MEASURES, "base_failed", "quality", "kept", "lang_pred", "score", "bits_per_char", "rejected", "n_deleted", "deleted", "new", "gone", "_key", "key", "_th", "th", "_gone", "own", "a", "n_shingles", "component_id", "node", "digest", "_node"]
    rows = [(i, f"{text} {' '.join(f'word{i}x{j}' for j in range(40))}.", "en", *(-7.0 for _ in names)) for i in range(30)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "lang", *names])
    for stage in (quality.keep, langid.keep, linededup.keep, lambda d: jaccard.one_of_each(d, 80, 5)):
        got = stage(df)
        assert got.columns == df.columns
        got = got.collect()
        assert got and all(r[n] == -7.0 for r in got for n in names)


def test_line_dedup_special(spark):
    got = sorted(linededup.cleaned(frame(spark, [*WEIRD, "same line of words that is long enough for a gram to be"] + ["same line of words that is long enough for a gram to be"])).collect())
    assert [r.text for r in got[: len(WEIRD)]] == [t if i != 8 else got[8].text for i, t in enumerate(WEIRD)] and got[-1].text == "" and got[-2].n_deleted == 0
    assert got[0].n_deleted == 0 and got[0].ids == "clash"
    null = frame(spark, ["same line of words that is long enough for a gram to be"] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    assert all(r.text for r in linededup.deduplicated(null).collect())
    assert linededup.deduplicated(frame(spark, [])).collect() == []


def test_units_are_the_text(docs):
    for t in [r.text for r in docs.collect()] + [w for w in WEIRD if w]:
        own, seps = linededup.units(t)
        assert "".join(a + b for a, b in zip(own, seps, strict=True)) == t
        assert linededup.without(t, []) == t.rstrip()


# Pipeline -------------------------------------------------------------------------------------------------------------
def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = docs.withColumn("n_chars", F.length("text").cast("long"))
    extra = rows.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    at = rows.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == docs.columns, name
        n = after.count()
        assert 0.5 * at.count() < n <= at.count(), name
        at = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
