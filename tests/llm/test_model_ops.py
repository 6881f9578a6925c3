"""Tokens, packing, HTML and classifiers: exact round trips and held-out accuracy."""

import bisect
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellgrid.llm import html_text, packing, quality_classifier, sampling, tokens, toxicity
from cellgrid.llm.features import word_runs
from tests.llm.test_text_ops import docs, words

TEXTS = [(3, "Hello  world\n\n it's 12,5 €"), (1, None), (2, ""), (9, "<|endoftext|> x　y\x85z"), (9, "twice"), (None, "no id"), (5, "long word " * 4000)]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return t


_ENCODER = []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\r 　'sax1,.!é中\x1c\x85"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=5))
def test_encoder_equals_the_library(texts):
    if not _ENCODER:
        t = Tokenizer.from_file(tokens.VOCABULARY)
        t.encode_special_tokens = True
        _ENCODER.extend([tokens.Encoder(), t])
    ours, theirs = _ENCODER
    assert [x.tolist() for x in ours.column(pa.array(texts, pa.string()))] == [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]


def test_token_files_round_trip(spark, tmp_path, plain):
    out = str(tmp_path / "t")
    tokens.write_token_files(docs(spark, TEXTS), out)
    rows = sorted(tokens.read_token_files(spark, out).collect(), key=lambda r: r.start)
    order = sorted(TEXTS, key=lambda x: (-1 if x[0] is None else x[0], x[1] or ""))
    start = 0
    for r, (i, t) in zip(rows, order, strict=True):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, bytes(r.ids)) == (i, start, ids.tobytes())
        start += len(ids)
    assert [r.doc_id for r in tokens.read_token_files(spark, out, [5]).collect()] == [5]
    hot = [(None if i % 3 else 7, f"text {i % 50}") for i in range(400)]
    tokens.write_token_files(docs(spark, hot).repartition(4), str(tmp_path / "h"))
    rows = sorted(tokens.read_token_files(spark, str(tmp_path / "h")).collect(), key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) // 4 for r in rows[:-1])]).tolist() and [r.doc_id for r in rows] == sorted((i for i, _ in hot), key=lambda i: i or 0)
    tokens.write_token_files(docs(spark, []), str(tmp_path / "e"))
    assert tokens.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_packing_is_whole_and_gapless(spark, plain):
    rows = packing.packed(docs(spark, TEXTS)).collect()
    whole = {}
    for i, t in TEXTS:
        whole.setdefault(i, []).append(np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4"))
    for r in rows:
        assert any(r.ids_crc32 == zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in whole[r.doc_id]) and (r.piece == 0 or r.length == 2048)
    assert sum(r.length for r in rows) == sum(len(x) for xs in whole.values() for x in xs)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed(docs(spark, [])).count() == 0


def bins(items, capacity):
    """Best-fit decreasing, piece by piece."""
    room, n = [], 0
    for x in sorted(items, reverse=True):
        at = bisect.bisect_left(room, x)
        free = room.pop(at) if at < len(room) else capacity
        n += free == capacity
        if free > x:
            bisect.insort(room, free - x)
    return n


def log_normal(seed, n):
    sizes = np.clip(np.random.default_rng(seed).lognormal(5.5, 1, n).astype(int), 1, 2048)
    return sizes, {int(x): int(k) for x, k in zip(*np.unique(sizes, return_counts=True), strict=True)}


def check_plan(h):
    """The sequences of a plan that holds each piece once."""
    plan, used = packing.packing_plan(h), {}
    for times, config in plan:
        assert sum(config) <= 2048 and times > 0
        for x in config:
            used[x] = used.get(x, 0) + times
    assert used == h
    return sum(t for t, _ in plan)


@pytest.mark.parametrize(("seed", "n"), [(0, 4000), (1, 10000), (2, 200000), (3, 4000)])
def test_plan_covers_the_histogram_near_the_bound(seed, n, monkeypatch):
    sizes, h = log_normal(seed, n)
    rest = []
    plain = packing.best_fit
    monkeypatch.setattr(packing, "best_fit", lambda left, capacity, plan: rest.append((sum(left.values()), plain(left, capacity, plan))) or rest[-1][1])
    plan = packing.packing_plan(h)
    monkeypatch.undo()
    count = check_plan(h)
    assert count <= bins(sizes.tolist(), 2048) and count <= -(-int(sizes.sum()) // 2048) + 2
    assert [r[0] for r in rest if r[1] is plan][0] <= min(2048, 0.05 * n)  # whole configurations place the others


def test_plan_of_many_pieces_costs_no_more():
    sizes, h = log_normal(4, 100000)
    many = {x: 10000 * n for x, n in h.items()}
    start = time.perf_counter()
    count = check_plan(many)
    assert count <= 10000 * int(sizes.sum()) / 2048 * 1.0002 and time.perf_counter() - start < 20


def test_plan_of_lengths_that_fit_badly():
    rng = np.random.default_rng(5)
    for sizes in (rng.integers(600, 1500, 20000), rng.integers(1, 2048, 3000), rng.integers(680, 700, 10000), np.array([700] * 1000 + [1024] * 7 + [683] * 50), np.array([3] * 5000), np.array([2048] * 7), np.array([5, 3, 1])):
        h = {int(x): int(k) for x, k in zip(*np.unique(sizes, return_counts=True), strict=True)}
        assert check_plan(h) <= 1.001 * bins(sizes.tolist(), 2048) + 1
        assert sum(t for t, _ in packing.best_fit(h, 2048, [])) == bins(sizes.tolist(), 2048)
    assert packing.packing_plan({}) == []


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.choice(np.arange(2, 20), 5, replace=False)
        price = np.zeros(31)
        price[lengths] = rng.random(5)
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(price[x] + best[c - x] for x in lengths if x <= c)])
        assert packing.knapsack(price, 30) == pytest.approx(best)
        counts = np.where(price > 0, 40, 0)
        for first in lengths:
            got = packing.filled(price, best, counts, int(first))
            assert got[0] == first and sum(got) <= 30 and price[got[1:]].sum() == pytest.approx(best[30 - first])
        few = packing.filled(price, best, np.where(price > 0, 1, 0), int(lengths[0]))
        assert len(few) == len(set(few)) and sum(few) <= 30


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav><!-- c --><div class="ad-box">Buy</div>
<div class="x9"><p>Join our list {salt}</p></div><article><header><h1>Head &amp; {n}</h1></header><p><b>One  {n}<br>two<p>quoted by many</p><ul><li>a<li>b</ul><div class="x7"><a>Same for all</a></div><form><input>send</form><section id="comments"><p>nice</p></section></article><aside>side</aside><footer>&copy; me</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, f"http://Host.example:80/{i}", PAGE.format(n=i, salt="")) for i in range(8)]
    pages += [(50, "http://other.example/", PAGE.format(n=50, salt="")), (51, None, None), (52, "x", ""), (53, "http://h/", "just text &lt; more &am"), (53, "http://h/", "just text &lt; more &am"), (54, "http://h/", "<p>a<p>b <i>c</i>d<")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = html_text.main_texts(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and got[3] == "Head & 3\nOne 3 two\nquoted by many\na\nb"
    assert got[50] == "Head & 50\nOne 50 two\nquoted by many\na\nb\nSame for all"  # one page is no template
    assert got[51] == got[52] == "" and got[53] == "just text < more &am" and got[54].split("\n")[:2] == ["a", "b cd<"]
    assert html_text.main_texts(df.limit(0)).count() == 0


def test_copies_of_a_page_are_no_template(spark):
    html = "<html><body><article><h1>t</h1><div><p>body of the page</p></div></article></body></html>"
    df = spark.createDataFrame([(i, f"http://a.b/{i}", html) for i in range(40)], "page_id long, url string, html string")
    assert {r.text for r in html_text.main_texts(df).collect()} == {"t\nbody of the page"}


def test_templates_of_pages_without_an_article(spark):
    bare = "<html><body><table><tr><td>banner</td></tr></table><h1>Head {n}</h1><p>Own words {n}</p><p>cookie text</p><div>Copyright all rights</div></body></html>"
    boxed = "<html><body><article><h1>Head {n}</h1><div><p>Own words {n}</p></div><div><p>Copyright all rights</p></div><p>quoted by many</p></article></body></html>"
    rows = [(i, f"http://bare/{i}", bare.format(n=i)) for i in range(12)] + [(100 + i, f"http://boxed/{i}", boxed.format(n=i)) for i in range(12)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Head 3\nOwn words 3" and got[103] == "Head 3\nOwn words 3\nquoted by many"


def test_near_copies_without_an_article_keep_what_they_share(spark):
    near = "<html><body><h1>Head</h1><p>shared words</p><p>version {n}</p></body></html>"
    rows = [(i, "http://big/", near.format(n=i)) for i in range(6)] + [(100 + i, "http://big/", f"<body><p>page {i}</p></body>") for i in range(60)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Head\nshared words\nversion 2" and got[130] == "page 30"


def test_templates_of_large_hosts(spark):
    html = "<body><article><p>own words {n}</p>{menu}</article></body>"
    menu = '<div class="x7">section menu</div>'
    rows = [(i, "http://hot/", html.format(n=i, menu=menu if i < 100 else '<div class="x8">rare</div>' if i < 150 else "")) for i in range(12000)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[7] == "own words 7" and got[120] == "own words 120\nrare"


def main_of(source):
    page = html_text.Page(source)
    return "\n".join(page.blocks(page.main())[0])


def test_layouts_keep_the_article():
    body = "<html><body><nav><a>menu</a></nav>{}<footer>foot</footer></body></html>"
    inside = "<article><h2 id='related-work'>Related work</h2><p id=notice>p one</p><section id='discussion'><h2>Discussion</h2><p>p two</p></section><section id='comments'><p>nice</p></section><div id='share'>tell</div><div class='related-posts'><a>more</a></div><p title='a hidden gem'>p three</p><p hidden>no</p><p data-id='comment 5'>p four</p></article>"
    assert main_of(body.format(inside)) == "Related work\np one\nDiscussion\np two\np three\np four"
    two = "<article><p>first story, the longer one</p></article><article><p>second</p></article><article class='comment'><p>nice</p></article><article><a href=x>teaser link</a></article>"
    assert main_of(body.format(two)) == "first story, the longer one\nsecond"
    cards = "<main><h1>Head</h1><p>long prose that is the text of the page</p><article><p>card</p></article></main>"
    assert main_of(body.format(cards)) == "Head\nlong prose that is the text of the page\ncard"
    full = "<main><p>x</p><article><h1>Head</h1><p>prose of the article</p><article class='comment'>no</article></article></main>"
    assert main_of(body.format(full)) == "Head\nprose of the article"
    assert main_of("<body><div class='c1'><article class='post tag-search'><p>kept</p></article></div></body>") == "kept"


@pytest.mark.parametrize("source", ["<body>" + "<div>x" * 100_000, "<body><article>" + "<div class=q><a href=x>y</a></div>" * 50_000 + "</article>", "<body>" + "<span>" * 50_000 + "<p>t</p>" * 50_000, "<body>" + '<a href="x>' * 20_000])
def test_large_pages_take_seconds(source):
    start = time.perf_counter()
    page = html_text.Page(source)
    texts, spans = page.blocks(page.main())
    page.subtrees(page.main(), spans)
    assert time.perf_counter() - start < 30 and sum(map(len, texts)) == sum(source.count(c) for c in (">x", ">y", ">t"))


def test_templates_equal_a_plain_count(spark):
    rng = random.Random(12)
    boxes = [f"<div class='b{k}'><p>box {k}</p></div>" for k in range(12)]
    rows = []
    for i in range(300):
        inside = "".join(boxes[k] for k in range(12) if rng.random() < (k + 1) / 60)
        rows.append((i, f"http://h{i % 2}/{i}", f"<body><article><p>own {rng.randrange(40)}</p>{inside}</article></body>"))
    pages = html_text.parsed(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.key for r in html_text.templates(pages, 5, 0.1).collect()}
    on, texts = {}, {0: set(), 1: set()}
    for r in pages.collect():
        texts[r.page.page_id % 2].add(tuple(r.blocks))
        for s in r.subtrees:
            on.setdefault((r.page.page_id % 2, s.key), set()).add(tuple(r.blocks))
    assert got == {key for (host, key), seen in on.items() if len(seen) >= max(5, 0.1 * len(texts[host]))} and 0 < len(got) < 24
    out = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), 5, 0.1).collect()}
    for r in pages.collect():
        gone = {i for s in r.subtrees if s.key in got for i in range(s.a, s.b)}
        assert out[r.page.page_id] == "\n".join(b for i, b in enumerate(r.blocks) if i not in gone)


def labelled(n, seed, bad):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = words(rng, rng.randrange(20, 200), 3000).split()
        y = i % 3 == 0
        out.append((i, " ".join(bad(rng, w) if y else w), int(y)))
    return out


def split(rows):
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    return [r for r in rows if r not in held], held


def slur(rng, w):
    w.insert(rng.randrange(len(w)), rng.choice(["vile", "scummy", "rottenest", "rottens"]))
    return w


def junk(rng, w):
    k = rng.randrange(max(1, len(w) - 15))
    return w[:k] + [f"{x}###" for x in w[k : k + 40]] + w[k + 40 :]


@pytest.mark.parametrize(("module", "bad"), [(toxicity, slur), (quality_classifier, junk)])
def test_held_out_accuracy(spark, module, bad):
    up = module is toxicity
    every = [(i, t, y if up else 1 - y) for i, t, y in labelled(1500, 6, bad)]
    held = split(every)[1]
    labels = spark.createDataFrame([(i, y, y) for i, _, y in every], "doc_id long, toxic int, quality int")
    got = {r.doc_id: r.predicted for r in module.scored(docs(spark, [(i, t) for i, t, _ in every]), labels).collect()}
    assert np.mean([got[i] == y for i, _, y in held]) > 0.95


def plain_toxicity(model, text):
    """The score of one text, word by word."""
    words = [w for _, _, ws, _ in word_runs(pa.array([text], pa.string())) for w in zip(*toxicity.buckets(ws), strict=True)]
    x = [model.words[a] + model.starts[b] for a, b in words] + [np.zeros(toxicity.DIM)] * toxicity.PAD
    pooled, k = [], 0
    for width in toxicity.WIDTHS:
        parts = [model.filters[:, (k + j) * toxicity.FILTERS : (k + j + 1) * toxicity.FILTERS] for j in range(width)]
        k += width
        places = [sum(x[i + j] @ parts[j] for j in range(width) if i + j < len(x)) for i in range(len(x))]
        f = toxicity.WIDTHS.index(width) * toxicity.FILTERS
        pooled += list(np.maximum(np.max(places, axis=0) + model.bias[f : f + toxicity.FILTERS], 0))
    return 1 / (1 + np.exp(-(np.dot(pooled, model.out) + model.base[0])))


def plain_quality(model, text):
    """The score of one text, passage by passage."""
    (_, _, ws, _), size = next(iter(word_runs(pa.array([text], pa.string())))), quality_classifier.PASSAGE
    hidden, gates = [], []
    for i in range(0, max(1, len(ws.word)), size):
        some, end = (x[i : i + size] % np.uint64(quality_classifier.BUCKETS) for x in (ws.word, ws.suffix))
        n, stats = len(some), ws.stats[i : i + size].sum(axis=0)
        own = ws.word[i : i + size].tolist()
        form = [stats[0] / max(n, 1) / 10, *(stats[1:] / max(stats[0], 1)), sum(a == b for a, b in zip(own, own[1:], strict=False)) / max(n, 1), (n - len(set(own))) / max(n, 1), n / size]
        mean = lambda t, at: t[at].mean(axis=0) if n else np.zeros(t.shape[1])
        h = np.tanh(np.concatenate([mean(model.words, some), mean(model.ends, end), form]) @ model.encode + model.bias)
        hidden.append(h)
        gates.append((np.tanh(h @ model.gate_v) / (1 + np.exp(-(h @ model.gate_u)))) @ model.gate_w)
    a = np.exp(gates - np.max(gates))
    return 1 / (1 + np.exp(-((a / a.sum()) @ np.array(hidden) @ model.out + model.base[0])))


@pytest.mark.parametrize(("module", "bad", "plain"), [(toxicity, slur, plain_toxicity), (quality_classifier, junk, plain_quality)])
def test_scores_equal_a_plain_computation(module, bad, plain):
    rows = labelled(120, 7, bad)
    model = module.fit(pa.array([r[1] for r in rows]), [r[2] for r in rows])
    texts = [None, "", "one", "Two words", *(r[1] for r in rows[:25]), " ".join(r[1] for r in rows)]
    got = model.uncalibrated(pa.array(texts, pa.string()))
    assert (got if module is quality_classifier else got[0]) == pytest.approx([plain(model, t or "") for t in texts], abs=2e-5)


@pytest.mark.parametrize("module", [toxicity, quality_classifier])
def test_gradients_equal_finite_differences(module):
    rows = labelled(12, 9, slur if module is toxicity else junk)
    column, y = pa.array([r[1] for r in rows] + [""]), np.array([r[2] for r in rows] + [1.0])
    model, weight, rng = module.fit(column, y.astype(int).tolist()), np.linspace(0.5, 2, len(y)), np.random.default_rng(3)
    for k, v in vars(model).items():
        if isinstance(v, np.ndarray):
            setattr(model, k, v.astype(np.float64))
    if module is toxicity:
        data = module.flat(column)
        loss = lambda: -np.mean(weight * (y * np.log(q := model.raw(*data)) + (1 - y) * np.log(1 - q)))
        grads, names = module.gradients(model, *data, y, weight), ["words", "starts", "filters", "bias", "out", "base"]
    else:
        data = module.joined([module.passages(ws, cuts) for _, _, ws, cuts in word_runs(column)])
        loss = lambda: -np.mean(weight * (y * np.log(q := model.forward(data)[-1]) + (1 - y) * np.log(1 - q)))
        grads, names = module.gradients(model, data, y, weight), ["words", "ends", "encode", "bias", "gate_v", "gate_u", "gate_w", "out", "base"]
    for name, g in zip(names, grads, strict=True):
        param = getattr(model, name)
        if isinstance(g, tuple):
            whole = np.zeros_like(param)
            np.add.at(whole, g[0], g[1])
            g = whole
        busy = np.argsort(-np.abs(g).ravel())[:400]
        for i in rng.choice(busy, min(6, len(busy)), replace=False):
            old, step = param.ravel()[i], 1e-5
            param.ravel()[i] = old + step
            up = loss()
            param.ravel()[i] = old - step
            down = loss()
            param.ravel()[i] = old
            assert g.ravel()[i] == pytest.approx((up - down) / (2 * step), rel=2e-2, abs=2e-6), name


def test_threshold_of_counts():
    rng = np.random.default_rng(4)
    for _ in range(20):
        neg, pos = np.histogram(rng.beta(2, 4, 300), sampling.BINS, (0, 1))[0], np.histogram(rng.beta(4, 2, 80), sampling.BINS, (0, 1))[0]
        cut = sampling.threshold(np.array([neg, pos]), 0.5)
        right = [neg[:k].sum() / 300 + pos[k:].sum() / 80 for k in range(sampling.BINS + 1)]
        k = int(np.clip(cut, 0.3, 0.9) * sampling.BINS + 1e-6)
        assert cut in (0.3, 0.9) or right[k] == pytest.approx(max(right))
    assert sampling.threshold(np.array([neg, 0 * pos]), 0.4) == 0.4


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality_classifier, "quality")])
def test_scores_of_edge_cases(spark, module, label):
    rows = labelled(200, 8, slur if module is toxicity else junk)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], f"doc_id long, {label} int")
    every = docs(spark, [(r[0], r[1]) for r in rows] + [(1000, None), (1001, ""), (1, rows[1][1]), (None, "x"), (1002, "y" * 3_000_000), (1003, "y " * 1_500_000)])
    out = module.scored(every, labels).collect()
    assert len(out) == 206 and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id for r in out if r.held_out} == {i for i in [*range(200), 1000, 1001, 1002, 1003] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len({r.score for r in out if r.doc_id == 1}) == 1
    assert module.scored(docs(spark, []), labels).count() == 0
    none = module.scored(every.limit(5), labels.limit(0)).collect()
    assert len({r.score for r in none}) == 1


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    d = tmp_path / "d"
    d.mkdir()
    rng = random.Random(9)
    rows = [(i, words(rng, 90, 5000)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[7][1] + " and then the benchmark sentence that nobody should train on stands here"), (300, "short"), (301, None)]
    docs(spark, rows).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, "the benchmark sentence that nobody should train on")], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(d / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(d)).collect()
    assert {r.doc_id for r in out} == set(range(60)) and len(out) == 60
    df = spark.read.parquet(str(d / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(d)).columns == df.columns
        assert stage(spark, df.limit(0), str(d)).count() == 0


_LONG = "<p>" + "The treatment was stopped after several weeks because patients reported problems with sleep. " * 4 + "</p>"


@pytest.mark.parametrize(
    ("inside", "stays"),
    [
        (f'<div class="side-effects">{_LONG}</div>', True),
        ('<div class="search-algorithms"><p>Short.</p></div>', True),
        ('<div class="form-factor"><p>Short.</p></div>', True),
        ('<div class="menu-of-the-day"><p>Soup.</p></div>', True),
        ('<div class="alert-free"><p>Short.</p></div>', True),
        (f'<section class="discussion"><h2>Discussion</h2>{_LONG}</section>', True),
        (f'<div id="discussion">{_LONG}</div>', True),
        ("<header><h3>A heading</h3><p>Its text.</p></header>", True),
        ('<div class="comment-list"><p>I like it.</p></div>', False),
        ('<div class="site-footer">Foot</div>', False),
        ('<div class="side-bar"><p>Links</p></div>', False),
        ('<div class="cookie-banner">We use cookies</div>', False),
        (f'<section class="discussion"><div class="comment">{_LONG}</div></section>', False),
        (f'<div class="user-comments">{_LONG}</div>', False),
        ('<div class="related-posts"><a>More</a></div>', False),
        ('<div class="ad">Buy</div>', False),
    ],
)
def test_whole_names_mark_furniture(inside, stays):
    def text(x):
        page = html_text.Page(f"<body><nav>Menu</nav><article><h1>Title</h1><p>The first words.</p>{x}</article></body>")
        return page.blocks(page.main())[0]

    assert (text(inside) != text("")) == stays


def test_menus_of_pages_without_an_article_go():
    page = html_text.Page('<body><div class="hdr"><a>Home</a> <a>About</a></div><p>Prose with a <a>link</a>.</p><ul><li><a>One</a></li></ul></body>')
    assert page.blocks(page.main())[0] == ["Prose with a link."]


def test_nested_templates_count_once(spark):
    deep = "<div class='x'>" * 60 + "<div>same on all</div>" + "</div>" * 60
    rows = [(i, "http://h/", f"<body><p>page {i} alone</p>{deep}</body>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"page {i} alone" for i in range(8)}
